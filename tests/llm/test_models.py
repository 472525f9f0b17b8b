"""Held-out results and exact answers on a generated corpus, and the whole pipeline on it."""

import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwright.llm import exact, langid, lattice, lm, registry, simhash, sstable, suffix
from shelfwright.llm.common import draw, fold_col, texts
from shelfwright.llm.components import components

from .brute import similar

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ei ung ch ie ver ge auf ein lich".split(), "fr": "eau ou oi ai tre ment que le on eux".split()}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4)))


def corpus():
    rng = np.random.default_rng(5)
    items = [" ".join(word(rng, "en") for _ in range(15)) for _ in range(4)]
    rows, labels = [], []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        w = [word(rng, lang) for _ in range(int(rng.integers(20, 80)))]
        bad = i % 7 == 0
        if bad:
            w = [x + "###" for x in w]
        if i % 23 == 5:
            w += items[i % 4].split()
        rows.append((i, " ".join(w), lang, f"s{0 if i % 3 else i % 5}", len(w)))
        labels.append((i, 0 if bad else 1, 0))
    for k in range(40):  # copies, exact and near
        i, t, lang, s, n = rows[3 * k + 1]
        rows.append((1000 + k, t if k % 2 else t + " end", lang, s, n))
        labels.append((1000 + k, labels[i][1], 0))
    return rows, labels, list(enumerate(items))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 24))
    v[100:200] = v[:100] + rng.normal(size=(100, 24)) * rng.uniform(0.02, 0.12, (100, 1))
    v[200:240] = v[0]
    v[240] = 0
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v.astype(np.float32))]
    rows[250] = (250, None, 0)
    rows[251] = (251, [float("nan")] * 24, 0)
    rows[252] = (252, [1.0, None], 0)
    rows[253] = (253, [], 0)
    rows += [(5, rows[7][1], 1), (None, rows[9][1], 1), (400, [2.0, 2.0], 1), (401, [1.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def test_quality_held_out(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = registry.QUERIES["op7_quality"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_language_held_out(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in registry.QUERIES["op8_langid"](spark, sf_dir).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.97


def test_language_phrases(monkeypatch):
    own = {"a": "abcab bca cab", "b": "xyz", "ü": "漢字 üben", "z": ""}
    m = langid.Model([(x, langid._flat(langid.normal(t).astype(np.int32)), np.zeros(0, np.uint32)) for x, t in own.items()])

    def plain(s, of):
        at, n = 0, 0
        while at < len(s):
            size = 1
            while at + size <= len(s) and s[at : at + size] in of:
                size += 1
            at, n = at + max(1, size - 1), n + 1
        return n

    texts = ["abcab", "bca  CAB!bca", "zzz", "a", "éa bca xyz", "", "Üben 漢字 ab", "x-y z ab", "bca cab bca cab bca cab bca"]
    norm = lambda t: "".join(map(chr, langid.normal(t)))
    assert [norm(t) for t in texts[:2]] == [" abcab ", " bca cab bca "]
    for stretch in (1024, 7):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        want = [[sum(plain(norm(t)[k : k + stretch], norm(own[x])) for k in range(0, len(norm(t)), stretch)) for x in m.languages] for t in texts]
        assert m.phrases([langid.normal(t) for t in texts]).tolist() == want


def test_language_choice_and_score():
    """Phrases a letter, against what the language needs for text of its own; the score is the share of the likelihoods."""
    own = {"a": ("the sea and the land and the sky", "the land and the sea"), "b": ("la mer et la terre et le ciel", "la terre et la mer"), "c": ("das meer und das land", "das land")}
    code = lambda t: langid.normal(t).astype(np.int32)
    m = langid.Model([(x, langid._flat(code(t)), code(o)) for x, (t, o) in own.items()])
    norm = lambda t: "".join(map(chr, langid.normal(t)))

    def need(text, of):
        at, n = 0, 0
        while at < len(text):
            size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in of), 1)
            at, n = at + size, n + 1
        return n

    letters = lambda t: sum(unicodedata.category(c)[0] == "L" for c in norm(t))
    usual = {x: need(norm(o), norm(t)) / max(1, letters(o)) for x, (t, o) in own.items()}
    texts_ = ["the terre und sky", "la mer la mer", "Das Land, das Meer!", "zzz", "and", "7 -", "et le land das ciel the"]
    for t, (lang, score) in zip(texts_, m.predict(texts_)):
        if not letters(t):
            assert (lang, score) == ("und", 0.0)
            continue
        cost = {x: need(norm(t), norm(own[x][0])) / letters(t) / usual[x] for x in own}
        assert lang == min(cost, key=lambda x: (cost[x], x))
        assert abs(score - 1 / sum(np.exp(-8 * (c - min(cost.values()))) for c in cost.values())) < 1e-9


def test_language_of_marks_and_signs(spark):
    docs = spark.createDataFrame([(i, ("the sea and the land " if i % 2 else "la mer et la terre ") * 9, ("en", "fr")[i % 2 == 0]) for i in range(20)] + [(90, "½ ² ① ...", "en"), (91, "the sea", None), (92, "ⓐⓑ", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[90] == got[92] == "und" and got[91] == "en"
    assert not langid.fit(docs.where("doc_id = 90")) and {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_language_model(spark, sf_dir):
    rows = registry.QUERIES["op1_lm"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts: dict = {}
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in [*t.lower().split(), ""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*docs[r.doc_id].lower().split(), ""]
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n) and abs(base - r.base_score) < 1e-6


def test_language_model_is_a_distribution(spark, sf_dir):
    """After any two words, the probabilities of all words and of one unknown word in each class add up to 1."""
    learn = texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(fold_col() != 1)
    counts = lm.count(learn)
    vocab = lm.vocabulary(counts, symbols=50, buckets=30)
    scorer = lm.Scorer(vocab, lm.train(learn, vocab, rounds=1))
    words = [w.decode() for w in vocab.words if w]
    for before in ([], [words[3]], [words[0], words[70]], ["never", words[1]]):
        code = lambda w: int(vocab.code([w.encode()], scorer.vocab.codes())[0])
        h = [scorer.start, scorer.start, *map(code, before)]
        symbols = np.arange(vocab.symbols + vocab.buckets)
        p = np.exp(scorer.model.log_probabilities(np.full(len(symbols), h[-1]), np.full(len(symbols), h[-2]), symbols))
        assert abs(p.sum() - 1) < 1e-4
    # the words of a class and one unknown word share what falls to it
    for k in range(vocab.buckets):
        own = [c for w, c in zip(vocab.words[vocab.symbols :], vocab.counts[vocab.symbols :]) if lm.bucket(w, vocab.buckets) == k]
        assert abs(sum(c + 0.5 for c in own) + 0.5 - 10 ** vocab.log_bucket[k]) < 1e-6


def test_language_model_against_plain_sums(spark, sf_dir):
    """Scores of whole texts are those of the formula, position by position."""
    learn = texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(fold_col() != 1)
    counts = lm.count(learn)
    vocab = lm.vocabulary(counts, symbols=40, buckets=20, head=200)
    model = lm.train(learn, vocab, rounds=1)
    every = {bytes(r["word"]): r["c"] for r in counts.collect()}
    top = {w: i for i, w in enumerate(vocab.words[:40])}
    symbol = lambda w: top.get(w, 40 + lm.bucket(w, 20))

    def plain(text):
        h1 = h2 = symbol(b"")
        total = 0.0
        for w in lm.tokens(text):
            a, s = (model.a1[h1] + model.a2[h2])[:-1].astype(float), symbol(w)
            own = [x for x in range(model.size) if x % lm.GROUPS == s % lm.GROUPS]
            soft = lambda rows, pick: rows[pick] - np.log(np.exp(rows).sum())
            total += soft(model.r[:, :-1] @ a + model.r[:, -1], s % lm.GROUPS) + soft(model.q[own, :-1] @ a + model.q[own, -1], own.index(s))
            if s >= 40:
                mates = [c for x, c in every.items() if x not in top and 40 + lm.bucket(x, 20) == s]
                total += np.log((every.get(w, 0) + 0.5) / (sum(mates) + 0.5 * (len(mates) + 1)))
            h1, h2 = s, h1
        return total / np.log(10)

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12).collect()
    more = [(1000, ""), (1001, "Never Seen before"), (1002, rows[0].text.split()[0])]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + more, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, counts, vocab, model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-3 * max(1, abs(got[i])) for i, t in [(r.doc_id, r.text) for r in rows] + more)


def test_embeddings_against_brute_force(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = [None if not r.embedding or None in r.embedding or not np.isfinite(r.embedding).all() or not np.any(r.embedding) else np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in source]
    n, root = [0] * len(x), {r.vec_id: r.vec_id for r in source if r.vec_id is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(x):
        for j, b in enumerate(x):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95:
                n[i] += 1
                if source[i].vec_id is not None and source[j].vec_id is not None:
                    p, q = find(source[i].vec_id), find(source[j].vec_id)
                    root[max(p, q)] = min(p, q)
    for kw in ({}, {"large": 40}):
        got = lattice.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), **kw).collect()
        assert sorted((r.vec_id is not None, r.vec_id or 0, r.n_links) for r in got) == sorted((s.vec_id is not None, s.vec_id or 0, k) for s, k in zip(source, n))
        assert all(r.component_id == find(r.vec_id) and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_lattice_of_very_large_and_small_components(spark):
    rows = [(i, [float(x) * s for x in (1, 2, 3, 4)]) for i, s in enumerate((1, 1e200, 1e-200, -1))] + [(9, [1e308, -1e308, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 9: (0, 9)}


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    e = lattice.entries(a).reshape(2000, -1)
    far = lattice.entries(np.roll(a, 1, axis=0)).reshape(2000, -1)
    meet = lambda f: np.mean([bool(set(x) & set(y)) for x, y in zip(e.tolist(), f.tolist())])
    assert meet(lattice.entries(0.95 * a + np.sqrt(1 - 0.95**2) * z).reshape(2000, -1)) > 0.95 and meet(far) < 0.001
    points = lattice.decode(rng.normal(size=(500, 8)) * 3)
    assert np.allclose((points * 2) % 1, 0) and ((points.sum(axis=1) % 2) == 0).all()


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for k in range(300):
        x = [*rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)).tolist(), 0]
        if k % 3 == 0:  # runs of one symbol
            x = [c for c in x[:-1] for _ in range(int(rng.integers(1, 9)))] + [0]
        sa = suffix.suffix_array(np.array(x))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = [0] * len(x)
        for a, b in zip(sa.tolist(), sa[1:].tolist()):
            common[b] = next(n for n in range(len(x)) if x[a + n] != x[b + n])
        assert suffix.permuted_prefixes(np.array(x, np.uint16), sa).tolist() == common


def test_suffix_arrays_of_long_runs():
    x = np.concatenate([np.full(400_000, 7), [3], np.full(300_000, 7), [9], np.full(200_000, 5), [0]]).astype(np.uint16)
    began = time.process_time()
    sa = suffix.suffix_array(x)
    common = suffix.permuted_prefixes(x, sa)
    assert time.process_time() - began < 60 and sorted(sa.tolist()) == list(range(len(x)))
    at = np.flatnonzero(sa == 100_000)[0]
    assert common[100_000] == 299_999 and sa[at - 1] == 100_001


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 5), (7, 8), (8, 7), (None, 1), (12, 11), (11, 10)], "a long, b long")
    assert sorted((r.id, r.component) for r in components(e).collect()) == [(2, 1), (3, 1), (8, 7), (9, 1), (11, 10), (12, 10)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0} and components(e.limit(0)).count() == 0


def test_forest_of_a_large_cell():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64).astype(np.uint64)
    fp = np.unique(np.concatenate([base[rng.integers(0, 40, 9000)] ^ (np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64)), base]))
    label = lambda pairs: _labels(len(fp), pairs)
    assert len(fp) > simhash.LARGE and label(simhash.forest(fp, 2)) == label(simhash._walk(fp, 2))


def _labels(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_draw(spark):
    df = spark.range(1000)
    assert draw(df, 50, "id", seed=1).count() == 50 and draw(df, 5000, "id", seed=1).count() == 1000
    h = F.xxhash64("id", F.lit(1))
    assert [r.id for r in draw(df, 50, "id", seed=1).collect()] == [r.id for r in df.orderBy(h, "id").limit(50).collect()]


def test_shard_lookup_and_export(spark, sf_dir, tmp_path):
    shards = sstable.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), sstable.default_tokenizer(), shard_bytes=8000)
    names = sstable.export(shards, str(tmp_path / "x"))
    readers = [sstable.Reader(open(n, "rb").read()) for n in names]
    assert len(readers) > 2 and sum(r.n_docs for r in readers) == 340
    every = {i: ids for r in readers for i, ids in r}
    for i in (0, 17, 299, 1003):
        assert [x.tolist() for r in readers for x in r.get(i)] == [every[i].tolist()]
    assert not any(r.get(5000) for r in readers)
    data = bytearray(open(names[0], "rb").read())
    data[10] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Reader(bytes(data)))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, labels, items = corpus()
    quality, text = {i: q for i, q, _ in labels}, {r[0]: r[1] for r in rows}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], sf_dir).cache()
        assert name == "tokens" or out.columns == docs.columns
        steps.append(out)
    ids = [[r.doc_id for r in s.collect()] for s in steps]
    assert np.mean([quality[i] == (i in set(ids[1])) for i in text]) > 0.97
    own = sorted(ids[1])
    label = _labels(len(own), [(x, y) for x in range(len(own)) for y in range(x) if similar(text[own[x]], text[own[y]]) >= 0.8])
    assert sorted(ids[2]) == sorted({own[c] for c in label})
    leaks = {i for i in ids[2] if any(" ".join(t.split()[k : k + 10]) in text[i] for _, t in items for k in range(6))}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks) and leaks
    words = lambda own: sum(len(text[i].split()) for i in own)
    assert abs(words(ids[4]) - 1.5 * words(ids[3])) < 0.05 * words(ids[3]) and max(map(ids[4].count, ids[4])) <= 2
    assert sorted(ids[5]) == sorted(ids[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(ids[4])


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs, labels in (("odd", odd, []), ("empty", empty, [(1, 1)]), ("one", odd, [(1, 1), (2, 1)])):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, d).collect()
        assert [r.start for r in sorted(rows, key=lambda r: r.start)] == [sum(x.n_tokens for x in rows if x.start < r.start) for r in sorted(rows, key=lambda r: r.start)]
        assert (len(rows) > 0) == (name != "empty") and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}


def test_windows_of_pieces_in_portions(monkeypatch):
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 4000).astype(np.uint8))
    pieces = list(dict.fromkeys(text[i : i + 30] for i in rng.integers(0, 3970, 300)))
    key = np.array([min(hash(p[i : i + 8]) for i in range(3)) for p in pieces], np.int64).view(np.uint64)
    key = key % np.uint64(7)
    lo = rng.integers(0, 50, len(pieces))
    plain = {}
    for p, k, d in zip(pieces, key.tolist(), lo.tolist()):
        for i in range(len(p) - 9):
            plain[k, p[i : i + 10]] = min(plain.get((k, p[i : i + 10]), 99), d)
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(exact, "TEXT", size)
        got = {}
        for p, at, n, d in zip(*(c.tolist() for c in exact.first_documents(pieces, key, lo, 10, 4))):
            got |= {(p, i): d for i in range(at, at + n)}
        # pieces of one key share windows; other keys may be compared too, as all windows of real pieces have one key
        assert len(got) == sum(len(p) - 9 for p in pieces)
        if size == 1:
            assert all(got[i, j] == plain[key.tolist()[i], p[j : j + 10]] for i, p in enumerate(pieces) for j in range(len(p) - 9))


def _pieces_of(texts, width, gram):
    """Distinct pieces of the texts: minimizer, smallest and largest document."""
    pieces = {}
    for d, t in enumerate(texts):
        least = exact.minimizers(np.frombuffer(t, np.uint8), width, gram)
        edge = np.flatnonzero(np.append(True, least[1:] != least[:-1])).tolist() + [len(least)] if len(least) else []
        for s, e in zip(edge[:-1], edge[1:]):
            k, lo, hi = pieces.get(t[s : e + width - 1], (least[s], d, d))
            pieces[t[s : e + width - 1]] = k, min(lo, d), max(hi, d)
    return pieces


def _copied(rng, letters, n=60):
    base = rng.integers(97, 97 + letters, 6000).astype(np.uint8).tobytes()
    cut = lambda k: base[(s := int(rng.integers(0, 5900 - k))) : s + k]
    return [cut(120) + rng.integers(97, 97 + letters, 150).astype(np.uint8).tobytes() + cut(300) + b"z" * int(rng.integers(0, 80)) for _ in range(n)]


def test_arrays_hold_what_stands_before_the_minimizers(monkeypatch):
    sorted_ = []
    whole = exact.suffix_array
    monkeypatch.setattr(exact, "suffix_array", lambda t: sorted_.append(len(t)) or whole(t))
    for letters in (20, 2):
        pieces = _pieces_of(_copied(np.random.default_rng(letters), letters), 50, 16)
        least = {}
        for p, (_, lo, _) in pieces.items():
            for i in range(len(p) - 49):
                least[p[i : i + 50]] = min(least.get(p[i : i + 50], lo), lo)
        sorted_.clear()
        found = exact.first_documents(list(pieces), np.array([k for k, _, _ in pieces.values()]), np.array([lo for _, lo, _ in pieces.values()]), 50, 16)
        got = {(p, i): d for p, at, n, d in zip(*(c.tolist() for c in found)) for i in range(at, at + n)}
        assert got == {(k, i): least[p[i : i + 50]] for k, p in enumerate(pieces) for i in range(len(p) - 49)}
        assert letters == 2 or sum(sorted_) < sum(map(len, pieces)) / 2


def test_a_task_works_through_its_shards():
    texts = _copied(np.random.default_rng(3), 20)
    rows = []
    for block, own in enumerate((range(0, 20), range(20, 40), range(40, 60))):
        pieces = _pieces_of([texts[d] for d in own], 50, 16)
        lo, hi = (np.array([v[k] + own[0] for v in pieces.values()]) for k in (1, 2))
        rows.append((0, block, exact._tight(np.arange(len(pieces))), exact._tight(np.array(list(map(len, pieces)))), exact._zip(b"".join(pieces)), exact._tight(lo), exact._tight(hi)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdefg"))
    found = []
    for shard in (1 << 20, 2000):
        out = list(exact._resolve(iter([batch]), shard, 50, 16))
        assert [b.num_rows for b in out] == [1] * len(out) and len(out) <= 3  # a row for each block, however many shards
        found.append(sorted((b["block"][0].as_py(), *x) for b in out for x in zip(*(exact._loose(b[k][0].as_py()).tolist() for k in ("piece", "offset", "n", "first")))))
    assert found[0] == found[1] and found[0]
    # rows grow with blocks and tasks: 6 GB of pieces go to no more tasks than this, and small inputs to enough
    assert exact._tasks(6 << 30, exact.FEW, exact.PART) == 128 and exact._tasks(200 << 20, exact.FEW, exact.PART) == 96 and exact._tasks(0, exact.FEW, exact.PART) == 1
