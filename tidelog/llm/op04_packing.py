"""Packing: concatenate all documents' ids and cut every `length` of them.

First pass: each partition tokenizes its documents and writes, once, the ids with their offset within the
partition. Then partition totals (one number each) give each partition's global offset by prefix sums, and
the second pass cuts: a document's first id has global offset g = base[partition] + local, and its pieces end
where g is a multiple of `length`. Only the last sequence is not full; no row is shuffled.

Defined results: null or empty text is one piece of the end id; repeated rows are packed as often as they
stand; an empty table gives no piece. Order is that of the stored partitions; any order is right.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import mapped, stored, table, text_of

LENGTH, END_ID = 2048, 1
#: One long per partition goes to the driver and back.
MAX_PARTITIONS = 2_000_000
BATCH_BYTES = 8 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKENIZED = "doc_id long, part int, at long, doc_tokens long, ids binary"


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """docs: doc_id, text. One row per document: ids, packed as little-endian integers, with the end id."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, at = bpe.ByteTokenizer(path), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], dtype=tok.kind).tobytes(), np.dtype(tok.kind).itemsize

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "part", "at", "doc_tokens", "ids"])

        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), tok.encode_batch(b.column(1)), strict=True):
                ids = text + end
                n = len(ids) // width
                rows.append((doc_id, at, n, ids))
                at, size = at + n, size + len(ids)
                if size > BATCH_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(mapped, run, TOKENIZED)


def packed(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """tokens: a stored table of TOKENIZED. One row per piece, and with with_ids its ids as array<int>."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()
    if len(totals) > MAX_PARTITIONS:
        raise ValueError(f"{len(totals)} partitions; coalesce to at most {MAX_PARTITIONS}")
    base, g = {}, 0
    for r in sorted(totals):
        base[r.part] = g
        g += r.n
    sent = tokens.sparkSession.sparkContext.broadcast(base)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, part, at, n, blob in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                raw = blob.as_buffer()
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                g = base[part] + at
                start = 0
                while start < n:
                    size = min(n - start, length - (g + start) % length)
                    piece = ids[start : start + size]
                    for c, v in zip(cols, (doc_id, start, size, zlib.crc32(piece), n, (g + start) // length, (g + start) % length, piece.astype("int32") if with_ids else None), strict=True):
                        c.append(v)
                    start += size
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    return tokens.transform(mapped, run, schema)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    return packed(stored(tokenized(docs, path, end_id), "tokens"), length, with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op4_packing": op4_packing}, {}
