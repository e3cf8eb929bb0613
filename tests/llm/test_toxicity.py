"""op6: segments against all intervals; held-out quality; what may and may not reach a score."""

import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, odd_docs, table_at
from tidelog.llm import op06_toxicity as op

SF = "/root/testdata/sf0.01"


def maximal(values):
    """By definition: the best interval (shortest among equals), then those to its left and right."""
    def rec(a, b):
        best, at = 0, None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += values[j]
                if s > best + 1e-12:
                    best, at = s, (i, j)
        if at is None:
            return []
        return [*rec(a, at[0]), (round(best, 9), *at), *rec(at[1] + 1, b)]

    return rec(0, len(values))


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 40)
        drift = rng.choice([0.1, 0.5, 1.0]) + rng.random() / 1000
        hits = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        w = [rng.random() * 3 + 0.01 for _ in hits]
        values = [-drift] * n
        for h, x in zip(hits, w, strict=True):
            values[h] = x
        got = [(round(s, 9), a, b) for s, a, b in op.segments(hits, w, drift)]
        assert got == maximal(values)


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in op.op6_toxicity(spark, SF).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[k].score, y) for k, y in truth.items() if zlib.crc32(str(k).encode()) % 4 == 2]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert pos and sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)) > 0.9
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_scores_depend_on_the_text_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = op.train(docs, labels)
    a = {r.text: r.score for r in op.scored(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit("z").alias("source"))
    b = {r.text: r.score for r in op.scored(other, model).join(other.select("doc_id", "text"), "doc_id").collect()}
    assert a == b
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = op.train(docs, flipped)
    assert again.listed == model.listed and (again.curve == model.curve).all()


def test_odd_rows(spark, tmp_path):
    docs, labels = odd_docs(), [(None, None, 1), (3, 1, None), (4, None, 1), (4, 0, 0), (8, 1, 0), (999, 1, 1), *((i, 1, i % 2) for i in range(10, 25))]
    tables = {"documents": clashing(spark.createDataFrame(docs, DOCS)), "labels": clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))}
    got = op.op6_toxicity(spark, table_at(spark, tmp_path, **tables)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in docs)
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[8]) == 1


def test_without_labels_or_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op.op6_toxicity(spark, table_at(spark, tmp_path / "a", documents=spark.createDataFrame(odd_docs(), DOCS), labels=empty)).collect()
    assert {r.score for r in got} == {0.0} and len(got) == len(odd_docs())
    assert op.op6_toxicity(spark, table_at(spark, tmp_path / "b", documents=spark.createDataFrame([], DOCS), labels=empty)).count() == 0


def test_spans_name_the_passage():
    listed = {"vile$": 3.0, "rotten$": 3.0}
    text = "one two three " * 20 + "vile rotten vile rotten" + " four five" * 30
    spans = []
    op.features(pa.array([text, "", "one two"]), listed, 0.1, spans=spans)
    assert [(d, a, b) for d, _, a, b in spans] == [(0, 60, 63)]


def test_filter(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    model = op.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = op.filter_toxic(docs, model)
    bad = {r.doc_id for r in op.scored(docs, model).filter("predicted = 1").collect()}
    assert out.columns == docs.columns and bad
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_scan_is_linear():
    """Declining sums, where a search of the whole stack takes n steps for each hit."""
    import time

    def took(n):
        t = time.process_time()
        op.segments(list(range(0, 60 * n, 60)), [1.0] * n, 0.5)
        return time.process_time() - t

    took(1000)
    assert took(64_000) < 40 * took(4000) + 0.2
    assert op.segments(list(range(0, 6000, 60)), [1.0] * 100, 0.5) == [(1.0, i, i) for i in range(0, 6000, 60)]


def test_calibration_finds_the_parameters():
    import numpy as np

    rng = np.random.default_rng(1)
    n = rng.integers(50, 2000, 20_000).astype(float)
    s = (np.log(0.02 * n) - np.log(rng.exponential(size=len(n)))) / 0.8
    lam, ln_k = op.calibrated(np.maximum(s, 0), n)
    assert abs(lam - 0.8) < 0.05 and abs(ln_k - np.log(0.02)) < 0.2
    assert op.calibrated(np.zeros(100), np.ones(100)) == (1.0, 0.0)


def test_scores_by_the_definition(spark):
    """Every score of a table from segments by all intervals, the calibration and the curve."""
    import math
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 1200").limit(120)
    model = op.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in op.scored(docs, model).collect()}
    for r in docs.collect():
        values = []
        for chunk in r.text.split(" "):
            w = 0.0
            for t in re.findall(r"[^\W_]+", chunk.lower()):
                w += max([model.listed.get(t + "$", 0.0), *(model.listed.get(t[:k], 0.0) for k in range(3, 8) if len(t) > k)])
            values.append(w if w > 0 else -model.drift)
        lam, ln_k = model.ev
        segs = [(sum(values[a : b + 1]), a, b) for _, a, b in maximal(values)]
        sig = [lam * s - ln_k - math.log(max(1, len(values))) for s, _, _ in segs]
        total, best = sum(x for x in sig if x > 0), max([0.0, *sig])
        dense = max((s / math.sqrt(b - a + 1) for s, a, b in segs), default=0.0)
        z = sum(x * c for x, c in zip((1, math.log1p(total), math.log1p(best), dense, total > 0), model.curve, strict=True))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9
