"""op5: counts and base scores against plain Python; the model is a distribution and beats the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import DOCS, clashing, odd_docs, table_at, words
from tidelog.llm import op05_lm as op

SF = "/root/testdata/sf0.001"


def brute(docs):
    held = [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in docs]
    c = Counter()
    for (_, t), h in zip(docs, held, strict=True):
        if not h:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (k, t), h in zip(docs, held, strict=True):
        tokens = [*words(t), None]
        out.append((k, h, len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return sorted(out, key=str)


def check(spark, d, docs):
    got = op.op5_lm(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: str((*r[:5], round(r[5], 6)))
    want = sorted(brute(docs), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-6)
    return got


def test_whole_table_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, SF, rows)
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)
    assert all(r[6] < 0 for r in got)


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    check(spark, table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS))), [d[:2] for d in docs])


def test_rare_words_meet_their_counts_in_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "TOP_WORDS", 20)
    docs = odd_docs()
    got = check(spark, table_at(spark, tmp_path, documents=spark.createDataFrame(docs, DOCS)), [d[:2] for d in docs])
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)


def test_empty_and_untrained(spark, tmp_path):
    assert op.op5_lm(spark, table_at(spark, tmp_path / "a", documents=spark.createDataFrame([], DOCS))).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = [(i, "some text", None, None, 1) for i in held]
    check(spark, table_at(spark, tmp_path / "b", documents=spark.createDataFrame(docs, DOCS)), [d[:2] for d in docs])


@pytest.mark.parametrize("seen", [[0, 1], []])
def test_distribution_sums_to_one(spark, seen):
    """All known words, one unknown word and the end, after the same start, have probabilities that add up to 1."""
    train = spark.createDataFrame([(i, "a b c a b d e f g a a b " * 3 + f"w{i}") for i in range(40)], "doc_id long, text string")
    counts = op.stored(op.word_counts(train), "counts")
    m = op.train(train, counts, op.tokenizer_path())
    vocabulary = [*m.index, "neverseen"]
    start = ["a", "b"][: len(seen)]
    texts = [(" ".join([*start, w])) for w in vocabulary]
    x = np.array([[op.START, *(m.enters[m.index[w]] for w in start)]])
    # first place after the start: read the class distribution of the net
    n = len(start)
    pad, ok = np.full((1, 2 * op.HOP), op.START), np.zeros((1, 2 * op.HOP), dtype=bool)
    pad[0, op.HOP : op.HOP + n + 1], ok[0, op.HOP : op.HOP + n + 1] = x[0], True
    z = op._forward(m.net, pad, ok)[0, n]
    p = np.exp(z - z.max())
    p /= p.sum()
    total = sum(p[m.cls[i]] * math.exp(m.share[i]) for i in m.index.values()) + p[op.RARE] + p[op.END] + p[op.UNSEEN]
    empty = 1 - sum(p[c] for c in set(m.cls.tolist())) - p[op.RARE] - p[op.END] - p[op.UNSEEN]
    assert abs(total + empty - 1) < 1e-6 and empty < 0.05 and len(texts) == len(vocabulary)


def test_gradients():
    """The hand-written backward pass lowers the loss to that of the pattern."""
    rng = np.random.default_rng(0)
    seqs = [(np.tile([1, 2, 3, 4], 12), np.tile([1, 2, 3, 0], 12)) for _ in range(30)]
    laid = [op._laid(x, y) for x, y in seqs]
    xs, oks, ys = (np.concatenate([q[i] for q in laid]) for i in range(3))
    net = op._train(xs, oks, ys, 6, 4)
    z = op._forward(net, xs, oks)
    p = np.exp(z - z.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    here = ys >= 0
    assert -np.log(np.take_along_axis(p, np.maximum(ys, 0)[..., None], -1)[..., 0][here]).mean() < 0.05 and rng is not None


def test_causal():
    """Later tokens never change a place's logits."""
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 5, (1, 2 * op.HOP))
    ok = np.ones_like(xs, dtype=bool)
    net = op._train(xs, ok, rng.integers(0, 3, (1, op.HOP)), 6, 3)
    a = op._forward(net, xs, ok)
    ys = xs.copy()
    ys[0, -1] = (ys[0, -1] + 1) % 5
    b = op._forward(net, ys, ok)
    assert np.allclose(a[0, :-1], b[0, :-1], atol=1e-5) and not np.allclose(a[0, -1], b[0, -1], atol=1e-5)


def test_every_training_document_reaches_the_network(spark):
    """Each of 5,000 documents has a word with a subword of its own, whose vector is trained; tasks share the rows."""
    chars = set("abcdefghijklmnopqrstuvwxyz")
    vocabulary = sorted(t[:-4] for t in op.bpe.WordTokenizer(op.tokenizer_path()).merges.text.values() if t.endswith("</w>") and len(t) > 6 and set(t[:-4]) <= chars)[:5000]
    docs = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(vocabulary)], "doc_id long, text string").repartition(3)
    m = op.train(docs, op.stored(op.word_counts(docs), "counts"), op.tokenizer_path())
    start = (np.random.default_rng(2).standard_normal(m.net["E"].shape) * 0.2).astype(np.float32)
    own = m.enters[[m.index[w] for w in vocabulary]]
    assert len(set(own.tolist())) == 5000 and (m.net["E"][own] != start[own]).any(axis=1).all()


def test_rounds_share_out_all_documents(spark, monkeypatch):
    """Every window of every training document is trained on once where there are enough; held-out ones never."""
    monkeypatch.setattr(op, "STEPS", 1)
    monkeypatch.setattr(op, "BATCH", 8)
    docs = spark.createDataFrame([(i, f"some text number {i} " * 20) for i in range(700)], "doc_id long, text string").repartition(3)
    codes = op.stored(op.coded(docs, op.held_out(op.F.col("doc_id"))), "codes")
    windows = sum(-(-(len(words(f"some text number {i} " * 20)) + 1) // op.HOP) for i in range(700) if zlib.crc32(str(i).encode()) % 10)
    seen, summed = [], op.summed

    def watched(codes, run):
        got = summed(codes, run)
        seen.append(got)
        return got

    monkeypatch.setattr(op, "summed", watched)
    op.train(docs, op.stored(op.counted(codes), "counts"), op.tokenizer_path(), codes)
    places = sum(float(got[-1][-1]) for got in seen if -1 in got)
    assert len([1 for got in seen if -1 in got]) == len(op.ROUNDS) and places == windows * 2 * op.HOP


def test_words_are_looked_up_once(spark, monkeypatch):
    """Places and first subwords come with the rows, so that neither training nor scoring opens a tokenizer."""
    monkeypatch.setattr(op, "TOP_WORDS", 20)
    docs = spark.createDataFrame(odd_docs(), DOCS)
    codes = op.stored(op.coded(docs, op.held_out(op.F.col("doc_id"))), "codes")
    model, rows = op.fitted(codes, op.stored(op.counted(codes), "counts"), op.tokenizer_path())
    library, beyond = op.first_ids(op.tokenizer_path()).tokenizer.model, 0
    for r in rows.join(codes.select("row", "words"), "row").collect():
        place, sub, listed = np.frombuffer(r.place, "<i4"), np.frombuffer(r.sub, "<i4"), r.words.split(" ")
        assert place.tolist() == [model.index.get(w, -1) for w in listed]
        assert r.rare.split(" ") == [w for w in listed if w not in model.index]
        plain = ["".join(op.bpe.byte_chars()[b] for b in w.encode()) for w in listed]
        assert sub.tolist() == [library.tokenize(w)[0].id for w in plain]
        beyond += sum(place < 0)
    assert beyond
    model.tokenizer = "/none"
    assert op.scored(rows, model).count() == docs.count()


def test_windows_of_joined_texts():
    rng, sizes = np.random.default_rng(5), np.array([0, 1, 31, 32, 33, 0, 100])
    sub, cls, n, each = rng.integers(0, 99, sizes.sum()), rng.integers(0, 30, sizes.sum()), 0, []
    for k in sizes:
        each.append(op._laid(np.concatenate([[op.START], sub[n : n + k]]), np.concatenate([cls[n : n + k], [op.END]])))
        n += k
    for got, want in zip(op._windowed(sub, cls, sizes), zip(*each, strict=True), strict=True):
        assert (got == np.concatenate(want)).all()


def plain_logits(net, x, ok):
    """A place after the other, in double precision."""
    net, out, most = {k: v.astype(float) for k, v in net.items()}, [], 0
    for ids, inside in zip(x, ok, strict=True):
        h = net["E"][ids] + net["P"]
        for t in range(op.HOP, 2 * op.HOP):
            at = [j for j in range(t + 1) if inside[j] or j >= op.HOP]
            s = h[at] @ net["K"] @ (h[t] @ net["Q"]) / math.sqrt(op.WIDTH)
            p, most = np.exp(s - s.max()), max(most, np.abs(s).max())
            out.append((h[t] + p / p.sum() @ (h[at] @ net["V"]) @ net["O"]) @ net["W"] + net["b"])
    return np.array(out).reshape(len(x), op.HOP, -1), most


@pytest.mark.parametrize("size", [1, 9])
def test_hops_and_windows_against_plain_attention(size):
    """Also with weights whose exponentials need their maximum taken off; a hop is seen as in its window."""
    rng, sizes = np.random.default_rng(6), np.array([0, 1, 31, 32, 33, 100])
    net = op._fresh(50_000, np.log(np.arange(1, 8) / 28))
    net |= {k: net[k] * np.float32(size) for k in ("E", "P", "Q", "K")}
    sub = rng.integers(0, 49_000, sizes.sum())
    x, ok, _ = op._windowed(sub, sub % 7, sizes)
    (want, most), got = plain_logits(net, x, ok), op._forward(net, x, ok)
    assert (most > op.SAFE) == (size > 1)
    inside = ok[:, op.HOP :]
    assert np.allclose(got[inside], want[inside], rtol=1e-4, atol=1e-4 * size)
    hops, begins = np.where(ok, x, 0)[:, op.HOP :], ~ok[:, 0]
    got = op._hops(net, np.concatenate([hops[:1], hops]), begins).reshape(-1, len(x), op.HOP).transpose(1, 2, 0)
    assert np.allclose(got[inside], want[inside], rtol=1e-4, atol=1e-4 * size)


def test_class_sums_against_plain_python(spark, monkeypatch):
    """The first pass: of each word, the mean of its documents' words, whatever the number of documents; held-out ones give nothing."""
    monkeypatch.setattr(op, "TOP_WORDS", 300)
    docs = odd_docs()
    codes = op.stored(op.coded(spark.createDataFrame(docs, DOCS), op.held_out(op.F.col("doc_id"))), "codes")
    seen, summed = [], op.summed
    monkeypatch.setattr(op, "summed", lambda rows, run: seen.append(summed(rows, run)) or seen[-1])
    model, _ = op.fitted(codes, op.stored(op.counted(codes), "counts"), op.tokenizer_path())
    n = len(model.index)
    z = (np.random.default_rng(1).standard_normal((n, op.SKETCH)) / np.sqrt(model.count.astype(float) + 1)[:, None]).astype(np.float32)
    want, times = np.zeros((n, op.SKETCH)), np.zeros(n)
    for k, t, *_ in docs:
        here = sorted({model.index[w] for w in words(t) if w in model.index})
        if here and not (k is not None and zlib.crc32(str(k).encode()) % 10 == 0):
            want[here] += z[here].sum(0) / (len(here) + 1)
            times[here] += 1
    got = seen[0][0].reshape(-1, op.SKETCH + 1)[:n]
    assert times.max() > 3 and (got[:, op.SKETCH] == times).all() and np.allclose(got[:, : op.SKETCH], want, rtol=1e-4, atol=1e-5)
