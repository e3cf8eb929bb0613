"""Event log of live and deleted runs: numbered JSON-lines files, each published by one rename.

The manifest, not a directory listing, says which runs a table has. A writer that loses the race for the
next number must load again and retry.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.fs import Files

KINDS = ("Append", "Seal", "CompactionStart", "CompactionEnd", "Delete", "Checkpoint", "Truncate", "FormatBump", "Rotate", "StripeCommit")
EVENT = T.StructType([T.StructField("ord", T.LongType()), T.StructField("type", T.StringType()), T.StructField("run", T.StringType()), T.StructField("inputs", T.ArrayType(T.StringType())), T.StructField("output", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("ts", T.LongType())])


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass
class State:
    live: dict[str, dict] = field(default_factory=dict)
    retired: dict[str, int] = field(default_factory=dict)  # runs that nothing names any more, with the time (ms) since when
    striped: dict[str, dict] = field(default_factory=dict)  # runs with parity
    deleted: set[str] = field(default_factory=set)
    last_seq: int = 0
    checkpoint: dict | None = None
    version: int = 0
    events: list[dict] = field(default_factory=list)


def fold(events: list[dict]) -> State:
    """Events in order to the live set."""
    s = State()
    for e in events:
        kind = e["type"]
        if kind not in KINDS:
            raise ValueError(f"manifest: unknown event {kind!r}")
        gone: list[str] = []
        if kind in ("Append", "Seal"):
            gone = e.get("inputs") or []
            s.live[e["run"]] = e
        elif kind == "CompactionEnd":
            gone = e["inputs"]
            if e.get("output"):
                s.live[e["output"]] = e | {"run": e["output"]}
        elif kind == "Delete":
            s.live.pop(e["run"], None)
            s.retired.pop(e["run"], None)
            s.striped.pop(e["run"], None)
            s.deleted.add(e["run"])
        elif kind == "Truncate":
            gone = list(s.live)
        elif kind == "StripeCommit":
            s.striped[e["run"]] = e
        elif kind == "Checkpoint":
            s.checkpoint = e
        for r in gone:
            s.live.pop(r, None)
            s.retired[r] = e.get("ts") or 0
        s.last_seq = max(s.last_seq, e.get("last_seq") or 0)
    s.events = events
    return s


class Manifest:
    ROTATE = 64  # files folded into a snapshot file after so many

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.files = spark, Files(spark, f"{base.rstrip('/')}/_manifest")

    def _names(self) -> list[str]:
        return [n for n in self.files.list("") if n.endswith(".jsonl")]

    def load(self) -> State:
        names = self._names()
        start = max((i for i, n in enumerate(names) if n.startswith("s")), default=None)
        # a snapshot s<version> replaces all numbered files up to that version
        snap = names[start] if start is not None else None
        upto = int(snap[1:-6]) if snap else 0
        numbered = [n for n in names if n.startswith("n") and int(n[1:-6]) > upto]
        events = [json.loads(line) for n in ([snap] if snap else []) + numbered for line in self.files.read(n).splitlines() if line]
        s = fold(events)
        s.version = max([upto, *(int(n[1:-6]) for n in numbered)])
        return s

    def append(self, state: State, *events: dict) -> State:
        """Publish events on top of the state that the writer has seen."""
        version = state.version + 1
        stamped = [{"ts": int(time.time() * 1000)} | e for e in events]
        if not self.files.create(f"n{version:012d}.jsonl", "\n".join(map(json.dumps, stamped)) + "\n"):
            raise Conflict(f"manifest version {version} was published by another writer")
        out = fold([*state.events, *stamped])
        out.version = version
        if version % self.ROTATE == 0:
            self.rotate(out)
        return out

    def rotate(self, state: State) -> None:
        keep = [{"type": "Rotate", "last_seq": state.last_seq}, *({"type": "Seal", "run": r, "level": e["level"], "rows": e.get("rows"), "last_seq": e.get("last_seq"), "ts": e.get("ts")} for r, e in state.live.items()), *state.striped.values(), *({"type": "CompactionEnd", "inputs": [r], "output": None, "ts": ts} for r, ts in state.retired.items())]
        if self.files.create(f"s{state.version:012d}.jsonl", "\n".join(map(json.dumps, keep)) + "\n"):
            for n in self._names():
                if n < f"n{state.version:012d}.jsonl":
                    self.files.delete(n)

    def describe(self) -> DataFrame:
        """Snapshot of live runs."""
        s = self.load()
        return self.spark.createDataFrame([(r, e["level"], e.get("rows"), e.get("last_seq")) for r, e in sorted(s.live.items())], "run string, level int, n_rows long, last_seq long")


def live_set(events: DataFrame) -> DataFrame:
    """The fold as SQL: the last event that names a run decides. Compactions name inputs and output."""
    named = events.select("ord", F.explode(F.array_compact(F.concat(
        F.array(F.when(F.col("type").isin("Seal", "Delete"), F.struct(F.col("run").alias("run"), (F.col("type") == "Seal").alias("up")))),
        F.transform(F.when(F.col("type") == "CompactionEnd", F.col("inputs")).otherwise(F.array().cast("array<string>")), lambda r: F.struct(r.alias("run"), F.lit(False).alias("up"))),
        F.array(F.when((F.col("type") == "CompactionEnd") & F.col("output").isNotNull(), F.struct(F.col("output").alias("run"), F.lit(True).alias("up")))),
    ))).alias("e")).select("ord", "e.*")
    return named.groupBy("run").agg(F.max_by("up", "ord").alias("up")).filter("up").select("run")
