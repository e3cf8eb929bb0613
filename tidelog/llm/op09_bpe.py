"""BPE encoding and decoding: see `bpe` for the transducer, its lookahead, and the decoder.

One pass without a shuffle; memory is a batch of texts, bounded memos and, for a word of any length, the ends
since the last stable token. Texts of any length are encoded whole.

Defined results: null or empty text has no ids and an empty decoded text; rows that repeat give rows that repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import mapped, table, text_of


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> bpe.WordTokenizer:
    """One for each worker, whose memos the next task finds."""
    return bpe.WordTokenizer(path)


def round_trip(docs: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """docs: doc_id, text. Digests of ids and decoded text; with keep_text also both themselves."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for b in batches:
            n, ids, decoded = tok.summaries(b.column(1))
            digest = lambda a: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in a], pa.string())
            arrays = [b.column(0), pa.array(n, pa.int64()), digest(ids), digest(decoded), *([ids.cast(pa.string()), decoded.cast(pa.string())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep_text else ""))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op9_bpe": op9_bpe}, {}
