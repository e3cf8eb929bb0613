"""Entity specs and engine options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans.resolve import META


@dataclass(frozen=True)
class Entity:
    """A table's row type: an explicit schema, one id column, and defaults for upsert."""

    name: str
    schema: T.StructType
    id_col: str
    defaults: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        names = self.schema.fieldNames()
        if names.count(self.id_col) != 1:
            raise ValueError(f"{self.name}: exactly one id column {self.id_col!r} is needed, schema has {names}")
        if bad := [n for n in names if n in META]:
            raise ValueError(f"{self.name}: reserved column names {bad}")
        if unknown := [n for n in self.defaults if n not in names]:
            raise ValueError(f"{self.name}: defaults for unknown columns {unknown}")
        if isinstance(self.schema[self.id_col].dataType, (T.MapType, T.ArrayType)):
            raise ValueError(f"{self.name}: the id cannot be an array or a map")

    @property
    def value_cols(self) -> list[str]:
        return [n for n in self.schema.fieldNames() if n != self.id_col]

    def default(self, name: str) -> Column:
        return F.lit(self.defaults.get(name)).cast(self.schema[name].dataType)


@dataclass(frozen=True)
class Options:
    """What is kept of the tuning knobs; durability is the atomic commit of each batch."""

    max_files_per_level: int = 4
    tombstone_ttl_s: int = 24 * 3600
    bloom_fpp: float = 0.01
    target_partitions: int | None = None
    compact_on_flush: bool = True
    flush_every: int = 1  # batches that may stay in the log before they are one run
    retain_s: float = 3600  # for how long replaced runs can still be read

    def __post_init__(self):
        for ok, what in ((self.max_files_per_level >= 1, "max_files_per_level >= 1"), (self.tombstone_ttl_s >= 0, "tombstone_ttl_s >= 0"), (1e-9 <= self.bloom_fpp <= 0.5, "bloom_fpp in [1e-9, 0.5]"), (self.flush_every >= 1, "flush_every >= 1"), (self.retain_s >= 0, "retain_s >= 0"), (self.target_partitions is None or self.target_partitions >= 1, "target_partitions >= 1")):
            if not ok:
                raise ValueError(f"options: {what} is required")


PRESETS = {
    "ULTRA_FAST": Options(flush_every=64, max_files_per_level=16, bloom_fpp=0.05),
    "FAST": Options(flush_every=16, max_files_per_level=8),
    "NORMAL": Options(),
    "DURABLE": Options(flush_every=1, bloom_fpp=0.001),
}


def preset(name: str, **changes) -> Options:
    if name == "CUSTOM":
        return Options(**changes)
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; one of {[*PRESETS, 'CUSTOM']}")
    return replace(PRESETS[name], **changes)
