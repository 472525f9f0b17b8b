"""Every operator on the odd table and on an empty one."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from shelfwright.llm import decontaminate, exact, langid, lm, mixing, pii, simhash, sstable, subword
from shelfwright.llm.common import texts

from .brute import components_of, fingerprint, repeated
from .conftest import CLASH

N = 16


def test_simhash(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    want = components_of(odd.select("doc_id", "text").collect())
    assert len(rows) == N and sorted((r.doc_id, r.fp, r.component_id) for r in rows if r.doc_id) == sorted(want)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 9)} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5, 8)} == {4}
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == N and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size and sum(r.taken for r in own) == round(own[0].target)
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    out = mixing.repeat(odd)
    assert out.dtypes == odd.dtypes and all(tuple(r[c] for c in CLASH) == (1, 2, "x", 3, 4, 5, 6, "k", 7, 8, "w", 9, 10, 11, "mine", 12, 13, 14, 15, 16, 17) for r in out.collect())


def test_exact(odd, empty):
    rows = exact.deduplicate(odd, block=3000, shard=2000, hot=1).collect()
    want = repeated([(r.doc_id, (r.text or "").encode()) for r in odd.collect()])
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows))
    assert got == sorted(want)
    assert exact.deduplicate(empty).count() == 0


def test_sstable(spark, odd, empty):
    path = sstable.default_tokenizer()
    plain = Tokenizer.from_file(path)
    more = [(60, "hello <|endoftext|> world"), (61, "a<|endoftext|>"), (62, "<|endoftext|>"), (63, "tab\there  two\u00a0 non \u3000wide"), (60, "again"), (64, "don't can't we'll 'tis 12'3 ''")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    shards = sstable.write_shards(docs, path, shard_bytes=4000)
    rows = sorted(sstable.documents_of(shards).collect(), key=lambda r: r.start)
    want = {}
    for r in docs.collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert shards.where(f"section = {sstable.FOOTER}").count() > 1
    for i in (10, 60, 62):
        assert sorted(len(r.ids) for r in sstable.lookup(shards, [i, 999]).collect()) == sorted(n for n, _ in want[i])
    many = [i for i in want if i is not None]
    assert sorted((r.doc_id, len(r.ids)) for r in sstable.lookup(shards, many + many + list(range(10**6, 10**6 + 500))).collect()) == sorted((i, n) for i in many for n, _ in want[i])
    assert sstable.lookup(shards, []).count() == 0
    assert sstable.documents_of(sstable.write_shards(empty, path)).count() == 0


def test_encoder_against_the_library():
    """Texts of words, marks, white space and the special string, with a small cache."""
    path = sstable.default_tokenizer()
    plain, encoder = Tokenizer.from_file(path), sstable.Encoder(path)
    rng = np.random.default_rng(6)
    parts = ["the", "Über", "naïve", "x1", "漢字", "...", "!?", "<|endoftext|>", "<|endof", "text|>", "don't", "'s", "\u2019ll", "a\u0301", "\U0001f600", "-", "1234567", "\x00", "\u0085", "\u00a0"]
    gaps = [" ", " ", " ", "", "  ", "\n", "\t", "\u3000", " \n"]
    texts_ = ["".join(parts[i] + gaps[j] for i, j in zip(rng.integers(0, len(parts), 12), rng.integers(0, len(gaps), 12))) for _ in range(3000)]
    got = encoder.encode(pa.array(texts_)).to_pylist()
    for t, ids in zip(texts_, got):
        assert np.frombuffer(ids, "<u2").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t


def test_decontaminate(spark, odd, empty):
    texts_ = [r.text for r in odd.collect() if r.doc_id == 10]
    items = [(1, " ".join(texts_[0].split()[5:20])), (2, "x"), (3, None), (4, " , "), (None, texts_[1]), (5, "not there at all"), (1, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for kw in ({}, {"block_bytes": 60}):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, sum(r.ends) - sum(r.starts), tuple(r["items"])) for r in decontaminate.hits(odd, bench, **kw).collect())
        assert got == sorted(_hits([(r.doc_id, r.text) for r in odd.collect()], items))
    clean = decontaminate.keep_clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(1 for x in got if x[3] == 0) == decontaminate.keep_clean(odd, bench, block_bytes=60).count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.starts for r in decontaminate.hits(odd, none).collect()) and decontaminate.hits(empty, bench).count() == 0


def _hits(docs, items):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).update([] if i is None else [str(i)])
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        yield (doc is not None, doc or 0, len(w), len(hit), tuple(sorted(found)))


def test_pii(spark, odd, empty):
    more = "mail a.b@c-d.example.org, 10.0.0.1 or 999.1.1.1, card 4539 1488 0343 6467, +1 (603) 555-8791 4485275742308327 end 38.211.12.42 4539148803436467"
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, more)], "doc_id long, text string"))
    rows = pii.detect(docs).collect()
    assert len(rows) == N + 1
    r = next(r for r in rows if r.doc_id == 50)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in pii.base(more)) for i in range(4))
    spans = {more[int(s) : int(e)] for _, s, e in (x.split(":") for x in r.spans.split(","))}
    assert {"a.b@c-d.example.org", "10.0.0.1", "4539 1488 0343 6467", "38.211.12.42"} <= spans
    assert "[email]" in pii.redact(more, r.spans) and pii.redact(None, "") is None
    assert pii.detect(empty).count() == 0
    e = next(r for r in rows if r.doc_id == 5)
    assert e.spans == "" and e.base_sha256 == hashlib.sha256(b"").hexdigest()


def _base(text):
    """The base spans by the patterns of the contract."""
    luhn = lambda d: sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    patterns = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    )
    return [(k, *m.span()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_against_the_patterns(spark):
    rng = np.random.default_rng(9)
    parts = ["a.b@c-d.org", "x@y", "@", ".", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "0000001.1.1.1", "4539 1488 0343 6467", "4539148803436467", "-", "+1 (603) 555-8791", "+", "(", ")", " ", " ", "7", "text", "é", "４", "\n", "1-2-3", "%_+"]
    every = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 14))) for _ in range(4000)]
    assert all(pii.base(t) == _base(t) for t in every)
    rows = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(every[:300])), "doc_id long, text string")).collect()}
    for i, t in enumerate(every[:300]):
        want = _base(t)
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in range(4))
        text = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest() and set(text) <= set(r.spans.split(",")) | {""}


def test_pii_of_a_long_list():
    text = "\n".join(f"user{i}@example{i % 50}.com, 10.{i % 256}.0.1, 555 {i % 1000:03d} {i % 10000:04d}" for i in range(60000))
    began = time.process_time()
    found = pii.candidates(text)
    assert len(found) >= 120000 and time.process_time() - began < 120


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (12, 0), (12, 0), (99, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = subword.fit(odd, labels)
    rows = subword.score(odd, model).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 for r in rows) and subword.score(empty, model).count() == 0
    assert subword.keep(odd, model, 0.5).columns == odd.columns
    one = subword.fit(odd, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in subword.score(odd, one).collect())
    assert subword.score(odd, subword.fit(empty, labels)).count() == N
    long = subword.fit(odd, labels, sample=2)
    assert isinstance(long.bias, float)
    tight = subword.fit(odd, labels, room=8 * 1000)  # the long documents are not learned from
    assert all(0 <= r.score <= 1 for r in subword.score(odd, tight).collect())


def test_quality_scores_against_plain_vectors(monkeypatch):
    """Scores by words' cached numbers are those of averaged vectors and a softmax, for words of any length."""
    rng = np.random.default_rng(3)
    model = subword.Model(rng.normal(size=subword.BUCKETS), 0.25)

    def word(w):
        text, rows = b"<" + w + b">", [zlib.crc32(w)]
        for n in subword.GRAMS:
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * 0x100000001B3 + c + 1) % 2**64
                h = (h * 0x9E3779B97F4A7C15 + n) % 2**64
                rows.append(h ^ h >> 29)
        return np.mean([model.activation[r % subword.BUCKETS] for r in rows])

    texts = ["a", "the the end", "ein Überraschungsei " + "x" * 300 + " x x", " ".join(f"w{i % 7}" for i in range(50)), "", "q" * 131]
    for long in (1 << 16, 16):
        monkeypatch.setattr(subword, "LONG", long)
        scorer = subword.Scorer(model)
        for t in texts:
            w = t.encode().split()
            every = [word(x) for x in w] + [word(subword.REPEAT)] * sum(x == y for x, y in zip(w, w[1:]))
            assert abs(scorer.logit(t) - (np.mean(every) if every else 0) - 0.25) < 1e-9


def test_quality_batches_are_averages():
    bags = [([b"ab", b"abc"], np.array([1.0, 3.0])), ([], np.zeros(0)), ([b"abc"], np.array([2.0]))]
    rows, doc, place, weight = subword._sparse(bags)
    dense = np.zeros((3, subword.BUCKETS))
    np.add.at(dense, (doc, rows[place]), weight)
    want = np.zeros_like(dense)
    for k, (words, times) in enumerate(bags):
        for w, n in zip(words, times):
            own = subword.subwords([w])[0]
            np.add.at(want[k], own, n / times.sum() / len(own))
    assert np.allclose(dense, want, atol=1e-6)


def test_langid(odd, empty):
    samples = langid.fit(odd)
    rows = langid.predict(odd, samples).collect()
    assert len(rows) == N and all(r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 8)} == {"und"}
    assert langid.predict(empty, samples).count() == 0 and {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_lm(odd, empty):
    docs = texts(odd)
    counts = lm.count(docs)
    vocab = lm.vocabulary(counts, head=8, symbols=5, buckets=7)  # so small that words are joined
    rows = lm.score(docs, counts, vocab, lm.train(docs, vocab, rounds=1)).collect()
    assert len(rows) == N and all(r.n_known == r.n_tokens for r in rows) and all(r.score < 0 for r in rows)
    other = {r.doc_id: r.base_score for r in lm.score(docs, counts, lm.vocabulary(counts), lm.train(docs, lm.vocabulary(counts), rounds=1)).collect() if r.doc_id in (1, 6, 7)}
    assert all(abs(other[r.doc_id] - r.base_score) < 1e-6 for r in rows if r.doc_id in other)
    none = lm.count(texts(empty))
    v = lm.vocabulary(none)
    assert {(r.n_known, r.train_tokens) for r in lm.score(docs, none, v, lm.train(texts(empty), v)).collect()} == {(0, 0)}
    assert lm.score(texts(empty), counts, vocab, lm.train(docs, vocab, rounds=1)).count() == 0


def test_fingerprints():
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \t") and simhash.fingerprint("A b") == fingerprint("a B")


def test_decontaminate_digests(spark, tmp_path):
    """What the query returns, against a plain version of the contract."""
    rng = np.random.default_rng(12)
    word = lambda: ["a", "B", "c", "d1", "é", "漢", "x_y"][int(rng.integers(0, 7))]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 25))))) for i in range(40)] + [(3, "a b c d1"), (None, "c c c"), (7, None)]
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 120))))) for i in range(60)] + [(5, None), (None, "c-c,c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((*x[:4], len(x[4]), hashlib.sha256(",".join(x[4]).encode()).hexdigest(), x[3] > 0) for x in _hits(rows, items))
    got = decontaminate.op4_decontaminate(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
