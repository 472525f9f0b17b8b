"""What the language model computes in arrays: against plain sums, and without work in Python on each word."""

import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from shelfwright.llm import lm


def small(texts, symbols=40, buckets=20, head=200):
    """A vocabulary of all the texts' words, without Spark."""
    counts: dict = {}
    for t in texts:
        for w in lm.tokens(t):
            counts[w] = counts.get(w, 0) + 1
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:head]
    classes: dict = {}
    for w, n in counts.items():
        k = lm.bucket(w, buckets)
        classes[k] = (classes.get(k, (0, 0))[0] + n, classes.get(k, (0, 0))[1] + 1)
    return lm.Vocabulary([w for w, _ in top], [n for _, n in top], sum(counts.values()), len(counts), classes, symbols, buckets), counts


def batches(texts, *names):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)][-len(names) :], names=list(names))])


ODD = ["", " ", "A", " Ab\tc\n", "\x0b\x0c a \r", "\x1cx\x85y z 　Ü漢Ａ", "\x00 a\x00b", "".join(map(chr, range(300))), "w" * 5000] + [" ".join(f"w{i * j % 53}" for j in range(i * 9)) for i in range(40)]


def test_words_of_texts():
    for texts in (ODD, ODD[:1], ODD[:2]):
        vocab, counts = small(texts, 5, 7, 3)  # the end may be none of the commonest
        words, n = lm.split(pa.array(texts))
        assert n.tolist() == [len(lm.tokens(t)) - 1 for t in texts] and words.to_pylist() == [w for t in texts for w in lm.tokens(t)[:-1]]
        found: dict = {}
        for b in lm._count(batches(texts, "text")):
            for w, k in zip(*(c.to_pylist() for c in b.columns)):
                found[w] = found.get(w, 0) + k
        assert found == counts
        for v in (vocab, small([], 5, 7)[0], small(texts)[0]):
            begin, place, symbols, text, others = lm.Lexicon(v).read(pa.array(["x", *texts]).slice(1))
            every = [w for t in texts for w in lm.tokens(t)]
            index = {w: i for i, w in enumerate(v.words)}
            assert place.tolist() == [index.get(w, len(index)) for w in every] and symbols.tolist() == v.code(every, v.codes()).tolist()
            assert list(zip(text.tolist(), others.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in lm.tokens(t) if w not in index]
            h1, h2 = lm.contexts(symbols, begin)
            own = [np.append([symbols[-1]] * 2, x) for x in np.split(symbols, begin[1:])]
            assert h1.tolist() == [x for o in own for x in o[1:-1].tolist()] and h2.tolist() == [x for o in own for x in o[:-2].tolist()]


def test_pieces_hold_all_texts():
    texts = ["a" * 100] * 10 + ["b" * 5000] + [""] * 30
    for room in (1, 400, 1 << 20):
        out = list(lm._pieces(pa.array(["x", *texts]).slice(1), room))
        assert [t for _, p in out for t in p.to_pylist()] == texts and [at for at, _ in out] == np.cumsum([0, *(len(p) for _, p in out)])[:-1].tolist()


def plain_step(t, h1, h2, w):
    """One step pair by pair, in double precision."""
    m, size, slots = t.m, t.m.size, t.m.size // lm.GROUPS
    rows = m.rows.astype(float)
    there = np.unique(w % lm.GROUPS)
    noise = np.minimum(np.searchsorted(t.groups, t.rng.random(lm.NOISE) * t.groups[-1]), lm.GROUPS - 1)
    drawn = t.begin[there][:, None] + t.rng.random((len(there), lm.NOISE)) * t.mass[there][:, None]
    drawn = np.minimum(np.searchsorted(t.words, drawn), len(t.words) - 1)
    drawn = drawn % slots * lm.GROUPS + drawn // slots
    grad, met = np.zeros_like(rows), np.zeros(len(rows), int)
    met[3 * size + np.arange(lm.GROUPS)] += np.bincount(noise, minlength=lm.GROUPS)
    np.add.at(met, 2 * size + drawn.ravel(), 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for x, y, z in zip(h1, h2, w):
        a, g = rows[x] + rows[size + y], z % lm.GROUPS
        a[-1] = 1
        back = np.zeros_like(a)
        pairs = [(2 * size + z, t.log_word[z], 1), (3 * size + g, t.log_group[g], 1)]
        pairs += [(3 * size + k, t.log_group[k], 0) for k in noise] + [(2 * size + k, t.log_word[k], 0) for k in drawn[np.searchsorted(there, g)]]
        for at, log, own in pairs:
            f = sigmoid(a @ rows[at] - log) - own
            grad[at] += f * a
            back += f * rows[at]
        back[-1] = 0
        grad[x] += back
        grad[size + y] += back
        for at in (x, size + y, 2 * size + z, 3 * size + g):
            met[at] += 1
    used = met > 0
    sums = t.sums + (grad * grad).mean(axis=1)
    rows[used] -= t.rate * grad[used] / np.sqrt(sums[used])[:, None]
    return rows, np.where(used, sums, t.sums), t.met + met


def test_a_step_against_plain_sums():
    vocab, _ = small([" ".join(f"w{i * j % 331}" for j in range(i)) for i in range(90)], 150, 40, 400)
    rng = np.random.default_rng(5)
    model = lm.Model.start(vocab.unigram)
    one, two = (lm.Trainer(model, vocab.unigram, 3, 0.15) for _ in range(2))
    for n in (1, 7, 300):
        h1, h2, w = (rng.choice(np.flatnonzero(vocab.unigram > 0), n) for _ in range(3))
        w[: n // 2] = w[0]  # one word that is met again and again
        rows, sums, met = plain_step(two, h1, h2, w)
        one.step(*(x.astype(np.int32) for x in (h1, h2, w)))
        there = np.isfinite(rows)
        assert (np.isfinite(one.m.rows) == there).all() and np.abs(one.m.rows[there] - rows[there]).max() < 1e-4
        assert np.allclose(one.sums, sums, rtol=1e-3) and (one.met == met).all()
        two.m.rows[:], two.sums[:], two.met[:] = one.m.rows, one.sums, one.met


def test_probabilities_far_apart():
    """Scores of the groups that either word puts far apart: products of exponentials would be nothing."""
    vocab, _ = small(ODD)
    model = lm.Model.start(vocab.unigram)
    model.rows[:, :-1] *= 60
    s = np.random.default_rng(1).integers(0, vocab.symbols + vocab.buckets, (3, 500))
    got, r = model.log_probabilities(*s), model.rows.astype(float)
    a1, a2, q, g = (r[k * model.size : (k + 1) * model.size] for k in range(4))
    log = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    with np.errstate(invalid="ignore"):
        for p, h1, h2, w in zip(got, *s):
            a, own = (a1[h1] + a2[h2])[:-1], np.arange(w % lm.GROUPS, model.size, lm.GROUPS)
            want = log(g[:, :-1] @ a + g[:, -1])[w % lm.GROUPS] + log(q[own, :-1] @ a + q[own, -1])[w // lm.GROUPS]
            assert abs(p - want) < 1e-3 * max(1, abs(want))


def test_no_calls_for_single_words(monkeypatch):
    """Python is called by text and by batch, not for each word that is counted, learned from or scored."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"{'the' if j % 2 else zlib.crc32(b'%d %d' % (i, j))}" for j in range(2500)) for i in range(80)]
    vocab, counts = small(texts, 400, 200, 2000)
    model, n, calls = lm.Model.start(vocab.unigram), sum(counts.values()), 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    for work in (
        lambda: list(lm._train(batches(texts, "text"), model, vocab, 0, lm.STEP)),
        lambda: list(lm._score(batches(texts, "doc_id", "text"), vocab, model)),
    ):
        calls = 0
        sys.setprofile(called)
        try:
            work()
        finally:
            sys.setprofile(None)
        assert calls < n / 4
