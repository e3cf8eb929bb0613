"""Toxicity: maximum-scoring segments of token log-odds.

Features are a document's distinct tokens, whole, and their beginnings of PREFIXES letters. Their weights are log-odds of toxic against
other labelled documents, with Dirichlet priors in proportion to the features' overall rates, less `SHRINK`
standard errors; features with z >= LEAST_Z are listed (at most MAX_TOKENS). A token has the largest weight of its
listed features, and one small negative weight without any. A linear-time scan finds all maximal scoring segments of a text. By
extreme-value theory the best segment of a clean text of n tokens scores S or more with probability
1 - exp(-K n exp(-lambda S)); lambda and K are fitted on the clean training texts. A segment is significant by
lambda S - ln K n; significant segments add up, and a logistic curve fitted on the training rows turns the sum, the
best and the best for its length into a probability.

Fitting uses labels of rows with crc32(doc_id) mod 4 <> 2 only, MAX_TRAIN of them at most (by hash of doc_id,
the same rows for any partitioning). Scoring is one pass without a shuffle: distinct words of a batch are
looked up once, and only listed tokens are visited.

Defined results: null or empty text has no segment and the lowest score; of equal segments (ties) the shortest, then
the first counts; texts of any length are scanned whole, in linear time; an empty table gives an empty result; extra
columns of any name change nothing; documents with several labels count as
toxic if any says so; without toxic labels all scores are 0; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import forget, mapped, stored, table, text_of

MAX_TRAIN, MAX_TOKENS, PRIOR, SHRINK, LEAST_Z, LEAST_DRIFT, CUT = 40_000, 50_000, 500.0, 1.0, 4.0, 0.02, 0.3
PREFIXES = range(3, 8)
#: Clean texts with a segment that a calibration takes, and the values of lambda that it tries.
LEAST_BEST, LAMBDAS = 20, np.exp(np.linspace(np.log(0.05), np.log(5), 120))
TOKEN = re.compile(r"[^\W_]+")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, toxic. The labels' sample has a bound and is broadcast; texts are not shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id IS NOT NULL AND toxic IS NOT NULL").filter(~F.coalesce(held_out(F.col("_id")), F.lit(False)))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).limit(2 * most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def weights(train: DataFrame) -> tuple[dict[str, float], float]:
    """Listed tokens' weights, and the others' (positive) loss."""
    words = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("token")).filter("token <> ''")
    tokens = stored(words.groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("x")), "tokens")
    features = F.array(F.concat("token", F.lit("$")), *[F.when(F.length("token") > n, F.substring("token", 1, n)) for n in PREFIXES])
    counts = stored(tokens.select(F.explode(F.array_compact(features)).alias("token"), "y", "x").groupBy("token").agg(F.sum("y").alias("y"), F.sum("x").alias("x")).filter("y >= 3"), "features")
    t = tokens.agg(F.sum("y").alias("y"), F.sum("x").alias("x")).first()
    ny, nx = float(t.y or 0), float(t.x or 0)
    if not ny or not nx:
        forget(tokens, counts)
        return {}, LEAST_DRIFT
    a = 0.5 + PRIOR * (F.col("x") + F.col("y")) / F.lit(nx + ny)
    odds = lambda c, n: F.log((F.col(c) + a) / (F.lit(n + PRIOR) - F.col(c) - a))
    se = F.sqrt(1 / (F.col("y") + a) + 1 / (F.col("x") + a))
    scored = counts.withColumn("d", odds("y", ny) - odds("x", nx)).withColumn("se", se).filter(F.col("d") >= LEAST_Z * F.col("se"))
    top = scored.orderBy((F.col("d") / F.col("se")).desc(), "token").limit(MAX_TOKENS).select("token", (F.col("d") - SHRINK * F.col("se")).alias("w"), "y", "x").collect()
    forget(tokens, counts)
    listed = {r.token: float(r.w) for r in top if r.w > 0}
    q, p = min(0.5, sum(r.y for r in top) / ny), min(0.5, sum(r.x for r in top) / nx)
    return listed, max(LEAST_DRIFT, float(np.log((1 - p) / max(1e-9, 1 - q))))


def segments(hits: list[int], w: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a text where token hits[i] has weight w[i] > 0 and
    every other one -drift: Ruzzo and Tompa's stack, over hits. Each item knows the nearest one below it with a lower
    sum before it, so that a search passes over an item once: linear time. Of equal segments the shortest counts."""
    stack: list[tuple[float, float, int, int, int]] = []  # sums before and after, first, last, nearest lower item
    total, before = 0.0, -1
    for at, x in zip(hits, w, strict=True):
        total -= drift * (at - before - 1)
        before = at
        low, high, first = total, total + x, at
        total = high
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                break
            low, _, first, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((low, high, first, at, j))
    return [(h - x, a, b) for x, h, a, b, _ in stack]


def found(texts: pa.Array, listed: dict[str, float], drift: float) -> tuple[np.ndarray, list[list[tuple[float, int, int]]]]:
    """Per text: the number of its tokens, and its maximal segments."""
    out: list[list[tuple[float, int, int]]] = [[] for _ in range(len(texts))]
    at, chunks, bounds = bpe.chunked(texts)
    w, get = np.zeros(len(chunks)), listed.get
    for i, c in enumerate(chunks):
        s = 0.0
        for t in TOKEN.findall(c.lower()):
            s += max([get(t + "$", 0.0), *(get(t[:k], 0.0) for k in PREFIXES if len(t) > k)])
        w[i] = s
    hit = np.flatnonzero(w[at] > 0) if len(at) else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(bounds, hit, "right") - 1
    val = w[at[hit]] if len(hit) else np.zeros(0)
    for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(doc)) + 1) if len(hit) else []:
        d = doc[part[0]]
        out[d] = segments((hit[part] - bounds[d]).tolist(), val[part].tolist(), drift)
    return np.maximum(1, np.diff(bounds)), out


def calibrated(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, ln K) of the best segments of clean texts of n tokens: P(S >= s) = 1 - exp(-K n exp(-lambda s)), by
    maximum likelihood; texts without a segment are censored at 0. (1, 0), the values of log-likelihood ratios, where
    fewer than LEAST_BEST texts have a segment."""
    some = best > 0
    if some.sum() < LEAST_BEST:
        return 1.0, 0.0
    like = []
    for lam in LAMBDAS:
        k = some.sum() / (n * np.exp(-lam * best)).sum()
        like.append(some.sum() * (np.log(k) + np.log(lam)) - lam * best.sum() - some.sum())
    lam = float(LAMBDAS[int(np.argmax(like))])
    return lam, float(np.log(some.sum() / (n * np.exp(-lam * best)).sum()))


def features(texts: pa.Array, listed: dict[str, float], drift: float, ev: tuple[float, float] = (1.0, 0.0), spans: list | None = None) -> np.ndarray:
    """Per text, of segments alone: sum of the significant ones' log odds against chance (lambda s - ln K n), the best
    one's, and the best score for its length. spans: gets (text, score, first word, last word) of each significant one."""
    n, segs = found(texts, listed, drift)
    out = np.zeros((len(texts), 3))
    chance = ev[1] + np.log(n)
    for d, own in enumerate(segs):
        for s, a, b in own:
            sig = ev[0] * s - chance[d]
            if sig > 0:
                out[d, 0] += sig
                out[d, 1] = max(out[d, 1], sig)
                if spans is not None:
                    spans.append((d, s, a, b))
            out[d, 2] = max(out[d, 2], s / np.sqrt(b - a + 1))
    return out


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), np.log1p(f[:, 0]), np.log1p(f[:, 1]), f[:, 2], f[:, 0] > 0])


def fit(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge."""
    x, b = _design(f), np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - 0.1 * b
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(5), g)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, listed: dict[str, float], drift: float, curve: np.ndarray | None, ev: tuple[float, float] = (1.0, 0.0)):
        self.listed, self.drift, self.curve, self.ev = listed, drift, curve, ev

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(_design(features(texts, self.listed, self.drift, self.ev)) @ self.curve, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    listed, drift = weights(rows)
    if not listed:
        return Model({}, drift, None)

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, segs = found(b.column(0), listed, drift)
            yield pa.RecordBatch.from_arrays([pa.array([max((x[0] for x in own), default=0.0) for own in segs], pa.float64()), pa.array(n.astype(float)), b.column(1)], ["best", "n", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(b.column(0), listed, drift, ev)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(3)), b.column(1)], ["a", "b", "c", "y"])

    # a row for each training text, 2 * MAX_TRAIN at most
    ev = calibrated(*rows.filter("toxic = 0").select("text", "toxic").transform(mapped, bests, "best double, n double, y int").toPandas().to_numpy(dtype=float).T[:2])
    got = rows.select("text", "toxic").transform(mapped, run, "a double, b double, c double, y int").toPandas().to_numpy(dtype=float)
    return Model(listed, drift, fit(got[:, :3], got[:, 3]), ev)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TOKENS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_of().alias("text"))
    return rows.transform(mapped, run, "doc_id long, held_out boolean, score double, predicted int")


def filter_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.score(b.column(at).fill_null("")) < CUT))

    return docs.transform(mapped, run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES, ORACLE = {"op6_toxicity": op6_toxicity}, {}
