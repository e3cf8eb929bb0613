"""Tables of an engine: batch put, get, delete, upsert, compare-and-swap, ranges and queries."""

from __future__ import annotations

import uuid
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.schema import Entity, Options, preset
from tidelog.plans import expr, resolve
from tidelog.plans.resolve import DELETED_AT, META, ORD, SEQ, TOMB
from tidelog.sources.storage import Store, log_schema

KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])


class Query:
    """A filtered table: nothing runs until a terminal operation."""

    def __init__(self, table: "Table", df: DataFrame):
        self.table, self.df = table, df

    def run_to_list(self) -> list[Row]:
        return self.df.collect()

    def first_or_null(self) -> Row | None:
        return next(iter(self.df.limit(1).collect()), None)

    def exists(self) -> bool:
        return not self.df.limit(1).isEmpty()

    def count(self) -> int:
        return self.df.count()


class Table:
    def __init__(self, spark: SparkSession, base: str, entity: Entity, options: Options):
        self.spark, self.base, self.entity, self.options = spark, base, entity, options
        self.store = Store(spark, base, entity, options)
        self.seq = self.store.state.last_seq

    @classmethod
    def open(cls, spark: SparkSession, base: str, entity: Entity, mode: str = "NORMAL", **changes) -> "Table":
        return cls(spark, base, entity, preset(mode, **changes))

    # reading

    def log(self) -> DataFrame:
        return self.store.log()

    def live(self, where: Column | None = None) -> DataFrame:
        """Visible rows; `where` may only name the key and goes below the resolution."""
        log = self.log()
        log = log if where is None else log.filter(where)
        out = log.filter(~F.col(TOMB)) if self.store.one_per_key() else resolve.live(log, self.entity.id_col)
        return out.drop(*META)

    def get(self, key: Any) -> Row | None:
        return next(iter(self.live(F.col(self.entity.id_col) == self._lit(key)).collect()), None)

    def get_all(self, keys: DataFrame) -> DataFrame:
        """Batch get: the live rows of the given keys. The resolution sees only rows of these keys."""
        k = self.entity.id_col
        log = self.log().join(keys.select(k).distinct(), k, "left_semi")
        return resolve.live(log, k).drop(*META)

    def range(self, start: Any = None, end: Any = None, ordered: bool = True) -> DataFrame:
        return resolve.key_range(self.live(), self.entity.id_col, start, end, ordered)

    def query(self, where: expr.Expr | Callable, **params) -> Query:
        """`where`: an expression, or a function of the columns: ``t.query(lambda c: c("age") > 18)``."""
        e = where(expr.Col) if callable(where) and not isinstance(where, expr.Expr) else where
        return Query(self, self.live().filter(expr.to_filter(e, params)))

    def run_to_list(self, where, **params) -> list[Row]:
        return self.query(where, **params).run_to_list()

    def first_or_null(self, where, **params) -> Row | None:
        return self.query(where, **params).first_or_null()

    def exists(self, where, **params) -> bool:
        return self.query(where, **params).exists()

    def count(self, where, **params) -> int:
        return self.query(where, **params).count()

    def last_seq(self) -> int:
        return self.seq

    # writing

    def _lit(self, v: Any) -> Column:
        return F.lit(v).cast(self.entity.schema[self.entity.id_col].dataType)

    def _append(self, rows: DataFrame) -> int:
        """The batch is one atomic unit with the next seq. It is computed once, and on disk when this returns."""
        self.store.append(rows.select(*log_schema(self.entity).fieldNames()), self.seq + 1)
        self.seq += 1
        return self.seq

    def put_all(self, df: DataFrame, order_by: str | Column | None = None) -> int:
        """Append a batch; all rows get one seq. Of rows with the same key the last one wins: the last of the frame, or
        the greatest by `order_by`."""
        if order_by is not None:
            df = self._last(df, order_by)
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.entity.schema.fields])
        # within a seq the least place wins
        return self._append(rows.withColumns({SEQ: F.lit(self.seq + 1).cast("long"), TOMB: F.lit(False), ORD: -F.monotonically_increasing_id(), DELETED_AT: F.lit(None).cast("timestamp")}))

    def _last(self, df: DataFrame, order_by: str | Column | None) -> DataFrame:
        """The last row of each key."""
        o = F.monotonically_increasing_id() if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
        df = df.withColumn("_o", o)
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(self.entity.id_col).orderBy(F.col("_o").desc()))).filter("_rn = 1").drop("_rn", "_o")

    def apply_all(self, df: DataFrame, delete_col: str, order_by: str | Column | None = None) -> int:
        """Puts and deletes (where `delete_col` is true) in one batch; the last row of each key counts, whichever it is."""
        gone = F.coalesce(F.col(delete_col), F.lit(False))
        rows = self._last(df, order_by).select(*[(F.col(f.name) if f.name == self.entity.id_col else F.when(~gone, F.col(f.name))).cast(f.dataType).alias(f.name) for f in self.entity.schema.fields], gone.alias(TOMB))
        return self._append(rows.withColumns({SEQ: F.lit(self.seq + 1).cast("long"), ORD: F.lit(0).cast("long"), DELETED_AT: F.when(F.col(TOMB), F.current_timestamp())}))

    def put(self, entity: dict | Row, key: Any = None) -> int:
        row = entity.asDict() if isinstance(entity, Row) else dict(entity)
        if key is not None:
            row[self.entity.id_col] = key
        if row.get(self.entity.id_col) is None:
            raise ValueError("put: the id is missing")
        return self.put_all(self.spark.createDataFrame([tuple(row.get(n) for n in self.entity.schema.fieldNames())], T.StructType([T.StructField(f.name, f.dataType, True) for f in self.entity.schema.fields])))

    def delete_all(self, keys: DataFrame) -> int:
        k = self.entity.id_col
        rows = keys.select(F.col(k).cast(self.entity.schema[k].dataType).alias(k)).distinct()
        rows = rows.withColumns({n: F.lit(None).cast(self.entity.schema[n].dataType) for n in self.entity.value_cols})
        return self._append(rows.withColumns({SEQ: F.lit(self.seq + 1).cast("long"), TOMB: F.lit(True), ORD: F.monotonically_increasing_id(), DELETED_AT: F.current_timestamp()}))

    def delete(self, key: Any) -> int:
        return self.delete_all(self.spark.range(1).select(self._lit(key).alias(self.entity.id_col)))

    def upsert_all(self, keys: DataFrame, changes: dict[str, Column]) -> int:
        """Get or default, apply the column expressions, put."""
        return self.put_all(upserted(keys, self.live(), self.entity, changes))

    def upsert(self, key: Any, changes: dict[str, Column]) -> Row:
        self.upsert_all(self.spark.range(1).select(self._lit(key).alias(self.entity.id_col)), changes)
        return self.get(key)

    def compare_and_swap_all(self, requests: DataFrame) -> DataFrame:
        """Requests: id, expected_seq, delete, value columns; the ones whose expected_seq is the key's current
        seq apply (null or -1: the key must be absent). Returns id and applied; at most one request per key."""
        k = self.entity.id_col
        # decided once: the table that is returned does not change when the log does
        rel = f"cas/{uuid.uuid4().hex}"
        cas_decisions(requests, resolve.live(self.log(), k), k).write.parquet(self.store.files.uri(rel))
        decided = self.spark.read.parquet(self.store.files.uri(rel))
        hit = decided.filter("applied")
        rows = hit.select(k, *[F.when(~F.col("delete"), F.col(n)).cast(self.entity.schema[n].dataType).alias(n) for n in self.entity.value_cols], F.lit(self.seq + 1).cast("long").alias(SEQ), F.col("delete").alias(TOMB), F.monotonically_increasing_id().alias(ORD), F.when(F.col("delete"), F.current_timestamp()).alias(DELETED_AT))
        self._append(rows)
        self.flush()
        self.store.retire(rel)
        return decided.select(k, "applied")

    def compare_and_swap(self, key: Any, expected_seq: int | None, new: dict | None) -> bool:
        s = T.StructType([T.StructField(self.entity.id_col, self.entity.schema[self.entity.id_col].dataType), T.StructField("expected_seq", T.LongType()), T.StructField("delete", T.BooleanType()), *[T.StructField(n, self.entity.schema[n].dataType) for n in self.entity.value_cols]])
        req = self.spark.createDataFrame([(key, expected_seq, new is None, *[(new or {}).get(n) for n in self.entity.value_cols])], s)
        return self.compare_and_swap_all(req).first()["applied"]

    def seq_of(self, key: Any) -> int | None:
        r = resolve.live(self.log().filter(F.col(self.entity.id_col) == self._lit(key)), self.entity.id_col).select(SEQ).first()
        return r[0] if r else None

    def flush(self) -> None:
        """Batches of the log become one run of level 0."""
        self.store.flush()

    def truncate(self) -> None:
        self.store.truncate()

    def compact(self, level: int = 0, now: float | None = None) -> None:
        self.flush()
        self.store.compact(level, now)

    def close(self) -> None:
        self.flush()


class Engine:
    """Several tables below one folder, and a byte table for raw keys and values."""

    def __init__(self, spark: SparkSession, base: str, options: Options | None = None):
        self.spark, self.base, self.options = spark, base, options or Options()
        self.tables: dict[str, Table] = {}

    @classmethod
    def open(cls, spark: SparkSession, base: str, mode: str = "NORMAL", **changes) -> "Engine":
        return cls(spark, base, preset(mode, **changes))

    def table(self, entity: Entity) -> Table:
        if entity.name not in self.tables:
            self.tables[entity.name] = Table(self.spark, self.base, entity, self.options)
        return self.tables[entity.name]

    def kv(self) -> Table:
        """Opaque bytes by opaque bytes, in unsigned byte order."""
        return self.table(Entity("kv", KV, "key"))

    def flush(self) -> None:
        for t in self.tables.values():
            t.flush()

    def last_seq(self) -> int:
        return max((t.last_seq() for t in self.tables.values()), default=0)

    def close(self) -> None:
        self.flush()
        self.tables.clear()


def upserted(keys: DataFrame, live: DataFrame, entity: Entity, changes: dict[str, Column]) -> DataFrame:
    """The rows that an upsert of these keys puts. Column expressions see the existing or default values."""
    k = entity.id_col
    base = keys.select(k).distinct().join(live.withColumn("_there", F.lit(True)), k, "left")
    base = base.select(k, *[F.when(F.col("_there"), F.col(n)).otherwise(entity.default(n)).alias(n) for n in entity.value_cols])
    return base.select(k, *[changes[n].cast(entity.schema[n].dataType).alias(n) if n in changes else F.col(n) for n in entity.value_cols])


def cas_decisions(requests: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Each request with `applied`: its expected seq is the current one, or both say that the key is absent."""
    cur = current.select(F.col(key).alias("_k"), F.col(SEQ).alias("_cur"))
    expected = F.when(F.col("expected_seq") != -1, F.col("expected_seq"))
    return requests.join(cur, requests[key].eqNullSafe(F.col("_k")), "left").withColumn("applied", expected.eqNullSafe(F.col("_cur"))).drop("_k", "_cur")
