"""Document fingerprints: content-defined chunks and the likeness of their digest sets.

A gear hash over the last 64 bytes marks cut points; cuts are rarer before a chunk's normal size and more
frequent after it (normalised chunking), with a least and a greatest size. An edit moves the cuts near it
only. A fingerprint is the set of chunk digests with their lengths, and likeness is containment: the bytes of
shared chunks, over those of the smaller set. Two empty sets are alike (1), an empty and another are not (0).

The next document in descending doc_id comes with one shuffle: ids are cut into ranges at sampled quantiles,
each range is sorted, and the first document of a range is also sent, as a ghost row, to the range before it
(the first of all to the last range). Rows with one doc_id are ordered by text; null ids come last.

Defined results: null text is empty; a table of one row has itself as the next document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import mapped, table, text_of

LEAST, NORMAL, MOST = 24, 64, 256
STRICT, LOOSE = np.uint64(0xFE << 56), np.uint64(0xF0 << 56)
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:8], "little") for i in range(256)], dtype=np.uint64)
LAST = -(1 << 63)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for m in (1, 2, 4, 8, 16, 32):  # windows of 2, 4 ... 64 bytes
        if n > m:
            h[m:] += h[:-m] << np.uint64(m)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    out, s = [], 0
    strict.append(n + MOST)
    loose.append(n + MOST)
    while n - s > LEAST:
        e = strict[bisect_left(strict, s + LEAST)]
        if e > s + NORMAL:
            e = min(loose[bisect_left(loose, s + NORMAL)], s + MOST, n)
        out.append(e := min(e, n))
        s = e
    if s < n:
        out.append(n)
    return out


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest to length of each distinct chunk."""
    out, s, digest = {}, 0, xxhash.xxh64_intdigest
    for e in cuts(data):
        out[digest(data[s:e])] = e - s
        s = e
    return out


def shown(fp: dict[int, int]) -> str:
    return ",".join(["%016x.%x" % x for x in sorted(fp.items())])


def parsed(s: str) -> dict[int, int]:
    return {int(a, 16): int(b, 16) for a, _, b in (x.partition(".") for x in s.split(",") if x)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum([n for d, n in a.items() if d in b]) / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text), sorted in its partitions: each bucket's rows by descending id, then the
    rows that follow its last one."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    marks = base.agg(F.percentile_approx(key, [(i + 1) / n for i in range(n - 1)] or [0.5], 10000)).first()[0] or []
    marks = np.array(sorted(set(marks), reverse=True)[: max(n - 1, 0)], dtype=np.int64)

    def bucket(ids: np.ndarray) -> np.ndarray:  # descending ids have ascending buckets; ~ turns the order round, and never overflows
        return np.searchsorted(~marks, ~ids, "right") if len(marks) else np.zeros(len(ids), dtype=np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            for k, v in zip(bucket(ids).tolist(), ids.tolist(), strict=True):
                best[k] = max(best.get(k, v), v)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["b", "top"])

    top = sorted(tuple(r) for r in base.select(key.alias("k")).transform(mapped, tops, "b long, top long").groupBy("b").agg(F.max("top").alias("top")).collect())  # one row per range
    ghosts = {t: top[i - 1][0] for i, (_, t) in enumerate(top)}  # the first of all follows the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(LAST).to_numpy()
            again = np.flatnonzero(np.isin(ids, np.array(list(ghosts), dtype=np.int64)))
            rows = np.concatenate([np.arange(len(ids)), again])
            where = np.concatenate([bucket(ids), [ghosts[i] for i in ids[again].tolist()]]).astype(np.int64)
            take = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.arange(len(rows)) >= len(ids)), *take.columns], ["bucket", "ghost", "doc_id", "text"])

    dealt = base.transform(mapped, deal, "bucket long, ghost boolean, doc_id long, text string").repartitionByRange(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for the next; the bucket that is complete
        rows: list[tuple] = []
        for b in batches:
            for bucket, ghost, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket == done:
                    continue
                data = text.encode()
                fp = chunk_set(data)
                if held is not None:
                    i, t, f = held
                    e = edited(t, text).encode()
                    g = chunk_set(e)
                    rows.append((i, len(t), hashlib.sha256(e).hexdigest(), shown(f), shown(g), containment(f, g), containment(f, fp)))
                held = None if ghost else (doc_id, text, fp)
                done = bucket if ghost else done
            if rows:
                yield _batch(rows)
                rows = []

    return with_next(docs).transform(mapped, run, SCHEMA)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op3_chunks": op3_chunks}, {}
