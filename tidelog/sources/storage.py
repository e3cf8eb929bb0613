"""Levelled Parquet runs: append, flush, read, compact, drop old tombstones, vacuum, parity.

A batch is on disk, and published, before its writer gets a seq: as a run of level 0, or, where batches are gathered,
as a log run (level -1); a flush writes the log runs as one run of level 0. A run that a flush or a compaction
replaces stays for `retain_s` seconds, for readers that have listed it, and goes with a vacuum.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import parity
from tidelog.operators.schema import Entity, Options
from tidelog.plans import resolve
from tidelog.plans.resolve import DELETED_AT, META, ORD, SEQ, TOMB
from tidelog.sources.fs import Files
from tidelog.sources.manifest import Manifest, State

META_FIELDS = [T.StructField(SEQ, T.LongType()), T.StructField(TOMB, T.BooleanType()), T.StructField(ORD, T.LongType()), T.StructField(DELETED_AT, T.TimestampType())]


def log_schema(entity: Entity) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in entity.schema.fields] + META_FIELDS)


class Store:
    def __init__(self, spark: SparkSession, base: str, entity: Entity, options: Options):
        self.spark, self.entity, self.options = spark, entity, options
        self.base = f"{base.rstrip('/')}/{entity.name}"
        self.files, self.manifest = Files(spark, self.base), Manifest(spark, self.base)
        self.state: State = self.manifest.load()

    # reading

    def log(self, state: State | None = None) -> DataFrame:
        """All versions in the live runs; a run is read with the declared schema, never inferred."""
        runs = sorted((state or self.state).live)
        return self.read_runs(runs) if runs else self.spark.createDataFrame([], log_schema(self.entity))

    def one_per_key(self) -> bool:
        """A single compacted run needs no resolution."""
        live = list(self.state.live.values())
        return len(live) == 1 and live[0]["level"] > 0

    # writing

    def write_run(self, df: DataFrame, level: int) -> str:  # level -1: a log run
        """Rows sorted by key in each file, so that row groups have narrow key ranges; a bloom filter on the key."""
        rel, key = f"{'log' if level < 0 else f'L{level}'}/{uuid.uuid4().hex}", self.entity.id_col
        # A level above 0 is dealt by key range: each file then has a range of its own, and a key filter skips files.
        n = self.options.target_partitions
        df = (df.repartitionByRange(n, key) if n else df.repartitionByRange(key)) if level > 0 else df
        (df.select(*log_schema(self.entity).fieldNames()).sortWithinPartitions(key, F.col(SEQ).desc()).write
         .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.fpp", str(self.options.bloom_fpp)).option("parquet.bloom.filter.adaptive.enabled", "true")
         .parquet(self.files.uri(rel)))
        return rel

    def append(self, df: DataFrame, last_seq: int) -> None:
        """A batch: durable once this returns."""
        if self.options.flush_every <= 1:
            return self.seal(df, last_seq)
        rel = self.write_run(df, -1)
        self.state = self.manifest.append(self.state, {"type": "Append", "run": rel, "level": -1, "last_seq": last_seq})
        if len(self.levels()[-1]) >= self.options.flush_every:
            self.flush()

    def seal(self, df: DataFrame, last_seq: int, inputs: list[str] | None = None) -> None:
        rel = self.write_run(df, 0)
        self.state = self.manifest.append(self.state, {"type": "Seal", "run": rel, "level": 0, "last_seq": last_seq, "inputs": inputs or []}, {"type": "Checkpoint", "last_seq": last_seq})
        if self.options.compact_on_flush:
            self.compact_if_due()

    def flush(self) -> None:
        """Log runs become one run of level 0."""
        if runs := self.levels().get(-1):
            self.seal(self.read_runs(runs), self.state.last_seq, runs)

    def retire(self, rel: str) -> None:
        """Files beside the runs that go with the vacuum after next."""
        self.state = self.manifest.append(self.state, {"type": "CompactionEnd", "inputs": [rel], "output": None})

    def truncate(self) -> None:
        """All rows go; seqs go on."""
        self.state = self.manifest.append(self.state, {"type": "Truncate", "last_seq": self.state.last_seq})

    def read_runs(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(log_schema(self.entity)).parquet(*(self.files.uri(r) for r in runs))

    # maintenance

    def levels(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for r, e in self.state.live.items():
            out.setdefault(e["level"], []).append(r)
        return out

    def compact_if_due(self) -> int:
        """Merge each level that has too many runs into the next; returns the number of merges."""
        done, level = 0, 0
        while level <= max(self.levels(), default=-1):
            if len(self.levels().get(level, [])) > self.options.max_files_per_level:
                self.compact(level)
                done += 1
            level += 1
        return done

    def compact(self, level: int, now: float | None = None) -> str | None:
        """All of a level and of the next to one run there. The inputs stay readable for `retain_s`."""
        by = self.levels()
        inputs = by.get(level, []) + by.get(level + 1, [])
        if not inputs:
            return None
        bottom = not any(k > level + 1 for k in by)
        kept = merge_runs([self.read_runs(inputs)], self.entity.id_col)
        if bottom:
            kept = drop_tombstones(kept, self.options.tombstone_ttl_s, now)
        out = self.write_run(kept, level + 1)
        self.state = self.manifest.append(self.state, {"type": "CompactionStart", "inputs": inputs, "level": level + 1}, {"type": "CompactionEnd", "inputs": inputs, "output": out, "level": level + 1, "last_seq": self.state.last_seq})
        self.vacuum()
        return out

    def vacuum(self, retain_s: float | None = None, now: float | None = None) -> list[str]:
        """Deletes the files of runs that were replaced over retain_s ago; the runs."""
        limit = (time.time() if now is None else now) - (self.options.retain_s if retain_s is None else retain_s)
        old = [r for r, ts in self.state.retired.items() if ts / 1000 <= limit]
        for r in old:
            self.files.delete(r)
            self.files.delete(f"parity/{r}")
        if old:
            self.state = self.manifest.append(self.state, *({"type": "Delete", "run": r} for r in old))
        return old

    # parity

    def protect(self, run: str, k: int = 4, m: int = 2, block: int = 1 << 16) -> None:
        """Parity lanes for a run's files, in stripes of k blocks, each with its checksum."""
        full = parity.encode_stripes(self._blocks(run, k, block), k, m)
        full.write.parquet(self.files.uri(f"parity/{run}"))
        self.state = self.manifest.append(self.state, {"type": "StripeCommit", "run": run, "k": k, "m": m, "block": block})

    def _blocks(self, run: str, k: int, block: int) -> DataFrame:
        def cut(parts):
            for p in parts:
                rows = [(f"{path.rsplit('/', 1)[-1]}:{i // k:09d}", i % k, bytes(data[i * block : (i + 1) * block]).ljust(block, b"\0")) for path, data in zip(p["path"], p["content"], strict=True) for i in range(-(-len(data) // (k * block)) * k)]
                yield pd.DataFrame(rows, columns=["stripe", "lane", "block"])

        import pandas as pd

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.files.uri(run))
        return files.select("path", "content").mapInPandas(cut, "stripe string, lane int, block binary")

    def damaged(self, run: str) -> DataFrame:
        """Blocks of a protected run that are lost or not as they were: stripe, lane, and the block as it should be."""
        e = self.state.striped[run]
        want = self.spark.read.parquet(self.files.uri(f"parity/{run}"))
        now = self._blocks(run, e["k"], e["block"]).withColumnRenamed("block", "now")
        seen = want.join(now, ["stripe", "lane"], "left").select("stripe", "lane", F.when(F.col("lane") < e["k"], F.col("now")).otherwise(F.col("block")).alias("block"), "crc")
        bad = seen.filter(F.col("block").isNull() | (F.crc32("block") != F.col("crc"))).select("stripe", "lane")
        # stripes without damage need no work
        hurt = seen.join(bad.select("stripe").distinct(), "stripe", "left_semi")
        return parity.recover_stripes(hurt, e["k"], e["m"]).join(bad, ["stripe", "lane"], "left_semi")


def merge_runs(runs: list[DataFrame], key: str) -> DataFrame:
    """Level merge: the winner of each key, tombstones kept."""
    return resolve.winners(reduce(DataFrame.unionByName, runs), key)


def drop_tombstones(df: DataFrame, ttl_s: int, now: float | None = None) -> DataFrame:
    """Only right for the bottom level: nothing older is left for the tombstone to hide."""
    limit = F.timestamp_seconds(F.lit((time.time() if now is None else now) - ttl_s))
    return df.filter(~F.col(TOMB) | F.col(DELETED_AT).isNull() | (F.col(DELETED_AT) > limit))


__all__ = ["META", "Store", "drop_tombstones", "log_schema", "merge_runs"]
