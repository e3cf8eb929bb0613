"""What the operators share: the shared folder, tables written once, files any executor can open."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_BYTE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors, and keeps what
    depends on the partitioning (numbers of partitions, offsets) as it was. The write's shuffle files go with it."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch between Spark and Python, where the session has Spark's own 64 MB.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in little memory: batches have some BATCH_BYTES however long their rows are (one row at least), and
    a worker that waits for its next task holds no memory of the last one."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if str(spark.conf.get(key)).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of `least` rows or more that never part the rows of a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held, rows = [*held, b], rows + b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        n = rows - 1  # the last key may go on in the next batch
        new = None
        for k in keys:
            c = t[k].combine_chunks()
            x = pc.not_equal(c.slice(1), c.slice(0, n))
            new = x if new is None else pc.or_(new, x)
        at = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        if len(at):
            n = int(at[-1]) + 1
            yield t.slice(0, n)
            held, rows = t.slice(n).to_batches(), rows - n
    if held:
        yield pa.Table.from_batches(held)


def let(x: Column, f) -> Column:
    """f of a value that is computed once, even where f uses it in a lambda."""
    return F.transform(F.array(x), f)[0]


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def open_fs(uri: str):
    """(file system, path) for Python code on any machine."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)
