"""Queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import decimal
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import codec, parity
from tidelog.operators import table as ops
from tidelog.operators.schema import Entity
from tidelog.plans import expr as X
from tidelog.plans import resolve
from tidelog.sources import fs, manifest, storage

C = X.Col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY0 = "timestamp_ntz'2024-01-01 00:00:00'"


def add(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return deco


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


# event log: key user_id, seq event_id, tombstone = error events


def log(spark, d, seq: str = "event_id") -> DataFrame:
    e = read(spark, d, "events")
    return e.select("user_id", F.expr(seq).cast("long").alias(resolve.SEQ), (F.col("event_type") == "error").alias(resolve.TOMB), F.col("event_id").alias(resolve.ORD), F.lit(None).cast("timestamp").alias(resolve.DELETED_AT), "event_type", "value")


def live(spark, d, seq: str = "event_id") -> DataFrame:
    return resolve.live(log(spark, d, seq), "user_id")


OUT = ("user_id", f"{resolve.SEQ} AS seq", "event_type", "value")
WIN = "SELECT user_id, {seq} AS seq, event_type, value FROM events {where} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {seq} DESC, event_type = 'error' DESC, event_id) = 1"
DAYS = f"datediff(ts, {DAY0})"
SQL_DAYS = "date_diff('day', TIMESTAMP '2024-01-01', ts)"


def live_sql(seq="event_id", where="") -> str:
    return f"SELECT * FROM ({WIN.format(seq=seq, where=where)}) WHERE event_type <> 'error'"


add("latest_wins", live_sql())(lambda s, d: live(s, d).selectExpr(*OUT))
add("tombstone_and_first_applied_ties", live_sql(f"CAST({SQL_DAYS} AS BIGINT)"))(lambda s, d: live(s, d, DAYS).selectExpr(*OUT))
add("scan_resolve_filter", f"SELECT count(*) AS n, sum(value) AS total FROM ({live_sql()}) WHERE value > 5")(lambda s, d: live(s, d).filter(X.to_filter(C("value") > 5)).agg(F.count("*").alias("n"), F.sum("value").alias("total")))
for name, key in (("point_get", 7), ("point_get_missing", 10**9), ("get_or_deleted", 0)):
    add(name, live_sql(where=f"WHERE user_id = {key}"))(lambda s, d, key=key: live(s, d).filter(F.col("user_id") == key).selectExpr(*OUT))
add("batch_get", live_sql(where="WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"))(
    lambda s, d: resolve.live(log(s, d).join(read(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi"), "user_id").selectExpr(*OUT))
add("range_unbounded", f"SELECT * FROM ({live_sql()}) WHERE user_id >= 100")(lambda s, d: resolve.key_range(live(s, d), "user_id", 100, None).selectExpr(*OUT))
add("last_seq", "SELECT max(event_id) AS last_seq FROM events")(lambda s, d: log(s, d).agg(F.max(resolve.SEQ).alias("last_seq")))


# orders as three runs that overlap


def runs(spark, d) -> list[DataFrame]:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")

    def run(where, seq, price, tomb):
        return o.filter(where).select("o_orderkey", F.expr(price).alias("price"), F.lit(seq).cast("long").alias(resolve.SEQ), F.lit(tomb).alias(resolve.TOMB), F.col("o_orderkey").alias(resolve.ORD), F.when(F.lit(tomb), F.timestamp_seconds(F.lit(0))).alias(resolve.DELETED_AT))

    return [run("true", 1, "o_totalprice", False), run("o_orderkey % 3 = 0", 2, "o_totalprice * 2", False), run("o_orderkey % 9 = 0", 3, "cast(null as double)", True)]


MERGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 9 <> 0"


def merged(s, d):
    return resolve.live(reduce(DataFrame.unionByName, runs(s, d)), "o_orderkey").select("o_orderkey", "price")


add("level_merge", MERGED)(merged)
add("range_half_open", f"SELECT * FROM ({MERGED}) WHERE o_orderkey >= 100 AND o_orderkey < 200")(lambda s, d: resolve.key_range(merged(s, d), "o_orderkey", 100, 200))


@add("compact_preserves_view", MERGED)
def _(s, d):
    a, b, c = runs(s, d)
    lower = storage.merge_runs([a, b], "o_orderkey")
    return resolve.live(storage.merge_runs([lower, c], "o_orderkey"), "o_orderkey").select("o_orderkey", "price")


@add("tombstone_gc", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS seq, o_orderkey % 9 = 0 AS tombstone FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderkey > 700")
def _(s, d):
    """Tombstones were written at second o_orderkey; those of more than a day ago go."""
    rows = storage.merge_runs(runs(s, d), "o_orderkey").withColumn(resolve.DELETED_AT, F.when(F.col(resolve.TOMB), F.timestamp_seconds("o_orderkey")))
    return storage.drop_tombstones(rows, 24 * 3600, now=24 * 3600 + 700).select("o_orderkey", F.col(resolve.SEQ).cast("int").alias("seq"), F.col(resolve.TOMB).alias("tombstone"))


@add("wal_replay", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _(s, d):
    w = read(s, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value", F.col("event_id").alias("at"))
    return resolve.live(w, "user_id", "seq", F.col("op") == "delete", "at").select("user_id", "value")


@add("manifest_live_set", "WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run, event_type FROM events), last AS (SELECT run, arg_max(event_type, event_id) AS t FROM e WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY run) SELECT run FROM last WHERE t <> 'error'")
def _(s, d):
    e = read(s, d, "events")
    run, kind = F.col("user_id").cast("string"), F.col("event_type")
    return manifest.live_set(e.select(F.col("event_id").alias("ord"), F.when(kind == "signup", "Seal").when(kind == "purchase", "CompactionEnd").when(kind == "error", "Delete").otherwise("Checkpoint").alias("type"), run.alias("run"), F.array().cast("array<string>").alias("inputs"), run.alias("output")))


# predicates over columns with nulls

N = "(SELECT event_id, nullif(event_type, 'error') AS et, CASE WHEN value > 100 THEN NULL ELSE value END AS v, CASE WHEN event_type <> 'error' THEN user_id % 100 END AS w, value FROM events)"


def nulls(s, d) -> DataFrame:
    return read(s, d, "events").select("event_id", (F.when(F.col("event_type") != "error", F.col("user_id") % 100).cast("decimal(10,2)") / 2).alias("dec"), F.nullif(F.col("event_type"), F.lit("error")).alias("et"), F.when(~(F.col("value") > 100), F.col("value")).alias("v"), "value", "event_type", F.when(F.col("event_type") != "error", F.col("user_id") % 100).alias("w"))


def predicate(name: str, e: X.Expr, sql: str, **params):
    add(name, f"SELECT event_id FROM {N} WHERE {sql}")(lambda s, d: nulls(s, d).filter(X.to_filter(e, params)).select("event_id"))


predicate("scan_filter_eq", C("et") == "click", "et IS NOT DISTINCT FROM 'click'")
predicate("scan_filter_eq_null", X.Bin("EQ", C("et"), X.Lit(None)), "et IS NOT DISTINCT FROM NULL")
predicate("scan_filter_neq", C("et") != "click", "et IS DISTINCT FROM 'click'")
for op, sym in (("GT", ">"), ("GE", ">="), ("LT", "<"), ("LE", "<=")):
    predicate(f"scan_filter_{op.lower()}", X.Bin(op, C("w"), X.Lit(7)), f"w {sym} 7")  # many rows have 7
    predicate(f"not_{op.lower()}", ~X.Bin(op, C("w"), X.Lit(7)), f"NOT coalesce(w {sym} 7, false)")
    predicate(f"compare_columns_{op.lower()}", X.Bin(op, C("w"), C("value")), f"w {sym} value")
predicate("compare_columns", C("v") < C("w"), "v < w")
predicate("compare_decimals", X.Bin("EQ", C("dec"), X.Lit(decimal.Decimal("2.50"))), "CAST(w AS DECIMAL(10, 2)) / 2 IS NOT DISTINCT FROM 2.5")
predicate("logic_and", (C("v") > 50) & (C("et") == "click"), "coalesce(v > 50, false) AND et IS NOT DISTINCT FROM 'click'")
predicate("logic_or", (C("v") > 50) | (C("et") == "click"), "coalesce(v > 50, false) OR et IS NOT DISTINCT FROM 'click'")
predicate("logic_not", ~((C("v") > 50) & ~(C("et") == "click")), "NOT (coalesce(v > 50, false) AND NOT (et IS NOT DISTINCT FROM 'click'))")
predicate("is_null", C("et").is_null(), "et IS NULL")
predicate("is_not_null", C("et").is_not_null(), "et IS NOT NULL")
predicate("in_list", C("et").isin(["click", "view"]), "coalesce(et IN ('click', 'view'), false)")
predicate("in_list_with_null", C("et").isin(["click", None]), "et IS NULL OR et = 'click'")
predicate("in_set", C("et").isin({"click", "view"}), "coalesce(et IN ('click', 'view'), false)")
predicate("in_empty", C("et").isin([]), "false")
predicate("in_null_container", C("et").isin(None), "false")
predicate("not_in", C("et").notin(["click", "view"]), "et IS NULL OR et NOT IN ('click', 'view')")
predicate("not_in_with_null", C("et").notin(["click", None]), "et IS NOT NULL AND et <> 'click'")
predicate("in_double_range", C("value").between(10.0, 20.0), "value BETWEEN 10.0 AND 20.0")
predicate("not_in_range", ~C("v").between(10.0, 20.0), "NOT coalesce(v BETWEEN 10.0 AND 20.0, false)")
predicate("in_int_range", C("event_id").isin(range(10, 20)), "event_id BETWEEN 10 AND 19")
predicate("capture_param", C("v") > X.Param("least"), "v > 42.5", least=42.5)
predicate("in_string_literal", C("et").isin("click or view"), "coalesce(contains('click or view', et), false)")
predicate("text_startswith", C("et").startswith("cl"), "starts_with(et, 'cl')")
predicate("text_not_endswith", ~C("et").endswith("ck"), "NOT coalesce(ends_with(et, 'ck'), false)")


@add("in_array", f"SELECT event_id FROM {N} JOIN (SELECT event_id, event_type FROM events) USING (event_id) WHERE event_type IS NOT DISTINCT FROM et OR event_type IS NOT DISTINCT FROM 'view' OR event_type IS NULL")
def _(s, d):
    return nulls(s, d).withColumn("arr", F.array("et", F.lit("view"), F.lit(None))).filter(X.to_filter(X.in_array(C("event_type"), C("arr")))).select("event_id")


@add("in_map_keys", "SELECT event_id FROM events WHERE event_type = 'view'")
def _(s, d):
    return nulls(s, d).withColumn("m", F.create_map("event_type", "value")).filter(X.to_filter(X.in_map_keys("view", C("m")))).select("event_id")


@add("in_string", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def _(s, d):
    return read(s, d, "documents").filter(X.to_filter(X.in_string("the", C("text")))).select("doc_id")


@add("nested_column", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def _(s, d):
    return read(s, d, "events").select("event_id", F.struct("event_type", "value").alias("e")).filter(X.to_filter((C("e.event_type") == "click") & (C("e.value") > 50))).select("event_id")


@add("project_bool", f"SELECT event_id, coalesce(v > 50, false) AS big, NOT coalesce(v > 50, false) AS not_big, coalesce(v > 50, false) AND et IS NOT DISTINCT FROM 'click' AS both_ FROM {N}")
def _(s, d):
    big = C("v") > 50
    return nulls(s, d).select("event_id", X.to_bool(big).alias("big"), X.to_bool(~big).alias("not_big"), X.to_bool(big & (C("et") == "click")).alias("both_"))


# terminal operations

PRED = (C("value") > 20) & (C("event_type") == "click")
NEVER = (C("value") > 10**6) & (C("event_type") == "click")


@add("first_or_null", f"SELECT * FROM ({live_sql()}) WHERE value > 20 AND event_type = 'click' ORDER BY user_id LIMIT 1")
def _(s, d):
    return live(s, d).filter(X.to_filter(PRED)).orderBy("user_id").limit(1).selectExpr(*OUT)


@add("exists", f"SELECT 'some' AS what, count(*) > 0 AS found FROM ({live_sql()}) WHERE value > 20 AND event_type = 'click' UNION ALL SELECT 'none', count(*) > 0 FROM ({live_sql()}) WHERE value > 1000000 AND event_type = 'click'")
def _(s, d):
    found = lambda what, p: live(s, d).filter(X.to_filter(p)).limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(what).alias("what"), "found")
    return found("some", PRED).union(found("none", NEVER))


@add("count", f"SELECT count(*) AS n FROM ({live_sql()}) WHERE value > 20 AND event_type = 'click'")
def _(s, d):
    return live(s, d).filter(X.to_filter(PRED)).agg(F.count("*").alias("n"))


# writes

COUNTER = Entity("counters", T.StructType([T.StructField("user_id", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("top", T.DoubleType())]), "user_id", {"hits": 0})


@add("upsert_batch", "WITH c AS (SELECT user_id, count(*) AS hits, max(value) AS top FROM events GROUP BY user_id), k AS (SELECT c_custkey AS user_id FROM customer) SELECT k.user_id, coalesce(hits, 0) + 1 AS hits, top FROM k LEFT JOIN c USING (user_id)")
def _(s, d):
    have = read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("hits"), F.max("value").alias("top"))
    return ops.upserted(read(s, d, "customer").select(F.col("c_custkey").alias("user_id")), have, COUNTER, {"hits": F.col("hits") + 1})


@add("cas_batch", f"WITH cur AS ({live_sql()}), k AS (SELECT DISTINCT user_id FROM events), r AS (SELECT k.user_id, CASE k.user_id % 3 WHEN 0 THEN m.seq WHEN 1 THEN m.seq - 5 ELSE 0 END AS expected_seq FROM k JOIN (SELECT user_id, max(event_id) AS seq FROM events GROUP BY user_id) m USING (user_id) UNION ALL SELECT 1000000, NULL) SELECT r.user_id, r.expected_seq IS NOT DISTINCT FROM cur.seq AS applied FROM r LEFT JOIN cur USING (user_id)")
def _(s, d):
    req = log(s, d).groupBy("user_id").agg(F.max(resolve.SEQ).alias("m")).select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("m")).when(F.col("user_id") % 3 == 1, F.col("m") - 5).otherwise(0).alias("expected_seq"))
    req = req.union(s.range(1).select(F.lit(1000000).cast("long"), F.lit(None).cast("long")))
    return ops.cas_decisions(req, live(s, d), "user_id").select("user_id", "applied")


@add("batch_delete", f"SELECT * FROM ({live_sql()}) WHERE user_id % 2 <> 0")
def _(s, d):
    top = log(s, d)
    dead = top.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(2**40).alias(resolve.SEQ), F.lit(True).alias(resolve.TOMB), F.lit(0).cast("long").alias(resolve.ORD), F.lit(None).cast("timestamp").alias(resolve.DELETED_AT), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return resolve.live(top.unionByName(dead), "user_id").selectExpr(*OUT)


# functions


@add("key_hex", "SELECT o_orderkey, lower(hex(encode(substr(o_orderpriority || CAST(o_orderkey AS VARCHAR), 1, 16)))) AS key_hex FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", codec.key_hex(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary")).alias("key_hex"))


@add("size_estimate", "SELECT o_orderkey, CAST(48 + octet_length(encode(o_orderpriority)) + octet_length(encode(o_orderstatus)) AS INTEGER) AS bytes FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", codec.size_estimate(F.col("o_orderpriority").cast("binary"), F.col("o_orderstatus").cast("binary")).alias("bytes"))


def uuids(s, d):
    h = F.md5(F.col("o_orderkey").cast("string"))
    return read(s, d, "orders").select("o_orderkey", F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("u"))


_H = "substr(md5(CAST(o_orderkey AS VARCHAR)), {}, 2)"
_LE = " || ".join(_H.format(i) for i in [*range(15, 0, -2), *range(31, 16, -2)])


@add("short_uuid", f"SELECT o_orderkey, rtrim(replace(replace(to_base64(unhex({_LE})), '+', '-'), '/', '_'), '=') AS short_id FROM orders")
def _(s, d):
    return uuids(s, d).select("o_orderkey", codec.short_uuid(F.col("u")).alias("short_id"))


@add("short_uuid_decode", "SELECT o_orderkey, CAST(CAST(md5(CAST(o_orderkey AS VARCHAR)) AS UUID) AS VARCHAR) AS u FROM orders")
def _(s, d):
    return uuids(s, d).select("o_orderkey", codec.short_uuid_decode(codec.short_uuid(F.col("u"))).alias("u"))


@add("mini_key", "SELECT c_custkey, CAST(" + " + ".join(f"CAST(ascii(substr(c_name, {i + 1}, 1)) AS HUGEINT) * {256**i}" for i in range(8)) + " AS DECIMAL(20,0)) AS mini FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", codec.mini_key(F.col("c_name").cast("binary")).alias("mini"))


HASHES = {"fnv1a32": codec.fnv1a32, "crc32c": codec.crc32c, "siphash24": codec.siphash24, "murmur3": codec.murmur3, "mix64": codec.mix64}


_BYTES = "list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1)))"  # of ASCII text
_FNV = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), CAST({_BYTES.format('c_name')} AS BIGINT[])), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_CRC_BYTE = "list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 2197175160 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({_BYTES.format('c_name')} AS BIGINT[])), lambda h, b: {_CRC_BYTE}), 4294967295)"


@add("hash_fnv1a_crc32c", f"SELECT c_custkey, CAST({_FNV} AS BIGINT) AS fnv1a32, CAST({_CRC} AS BIGINT) AS crc32c FROM customer")
def _(s, d):
    k = F.col("c_name").cast("binary")
    return read(s, d, "customer").select("c_custkey", codec.fnv1a32(k).alias("fnv1a32"), codec.crc32c(k).alias("crc32c"))


#: Vectors of the hashes' public test suites (mix64: SplitMix64's finaliser).
VECTORS = [("crc32c", "313233343536373839", 3808858755), ("fnv1a32", "666f6f626172", 3214735720), ("murmur3", "", 0), ("mix64", "157c4a7fb979379e", -2152535657050944081)]


@add("hash_vectors", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', CAST({v} AS BIGINT))" for n, k, v in VECTORS) + ") t(name, key, hash)")
def _(s, d):
    return reduce(DataFrame.union, [s.createDataFrame([(n, k)], "name string, key string").select("name", "key", HASHES[n](F.unhex("key")).alias("hash")) for n, k, _ in VECTORS])


@add("hashes")
def _(s, d):
    k = F.col("c_name").cast("binary")
    return read(s, d, "customer").select("c_custkey", *[f(k).alias(n) for n, f in HASHES.items()])


@add("short_uuid_be", "SELECT o_orderkey, rtrim(replace(replace(to_base64(unhex(md5(CAST(o_orderkey AS VARCHAR)))), '+', '-'), '/', '_'), '=') AS short_id, CAST(CAST(md5(CAST(o_orderkey AS VARCHAR)) AS UUID) AS VARCHAR) AS u FROM orders")
def _(s, d):
    short = uuids(s, d).select("o_orderkey", codec.short_uuid_be(F.col("u")).alias("short_id"))
    return short.select("o_orderkey", "short_id", codec.short_uuid_be_decode(F.col("short_id")).alias("u"))


@add("short_uuid_valid", "SELECT o_orderkey, regexp_full_match(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 21) || substr('AQgwBx', CAST(o_orderkey % 6 AS INTEGER) + 1, 1), '[A-Za-z0-9_-]{21}[AQgw]') AS ok FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    text = F.concat(F.substring(F.md5(k.cast("string")), 1, 21), F.substring(F.lit("AQgwBx"), (k % 6).cast("int") + 1, F.lit(1)))
    return read(s, d, "orders").select("o_orderkey", codec.is_short_uuid(text).alias("ok"))


ROW = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderpriority", T.StringType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.TimestampNTZType())])


@add("row_codec", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, o_totalprice, o_orderdate, CAST(31 + CASE WHEN o_orderkey % 5 <> 0 THEN 4 + octet_length(encode(o_orderpriority)) ELSE 0 END AS INTEGER) AS bytes FROM orders")
def _(s, d):
    """Rows packed by the positional codec and unpacked again; every fifth has a null."""
    rows = read(s, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))).select(F.struct(*ROW.fieldNames()).alias("r"))
    packed = rows.select(codec.pack(F.col("r"), ROW).alias("b"))
    return packed.select(codec.unpack(F.col("b"), ROW).alias("r"), F.octet_length("b").alias("bytes")).select("r.*", "bytes")


@add("parity_repair", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(s, d):
    """Stripes of four orders with two parity lanes; a lane of each is lost, another is damaged, all come back."""
    k = F.col("o_orderkey")
    blocks = read(s, d, "orders").select(F.floor(k / 4).alias("stripe"), (k % 4).cast("int").alias("lane"), F.encode(F.rpad(F.concat(k.cast("string"), F.lit("|"), "o_orderpriority"), 40, " "), "utf-8").alias("block"))
    full = parity.encode_stripes(blocks, 4, 2)
    hurt = full.filter(F.col("lane") != F.col("stripe") % 6).withColumn("block", F.when(F.col("lane") == (F.col("stripe") + 3) % 6, F.unhex(F.lit("00" * 40))).otherwise(F.col("block")))
    text = F.split(F.rtrim(F.decode("block", "utf-8")), "[|]")
    back = parity.recover_stripes(hurt, 4, 2).select(text.alias("t")).filter(F.size("t") == 2)
    return back.select(F.element_at("t", 1).cast("long").alias("o_orderkey"), F.element_at("t", 2).alias("o_orderpriority"))


# tables on disk: each query writes its own below spark.checkpoint.dir, and reads it again as it was opened anew

ORDER = Entity("orders", T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType())]), "o_orderkey")


def opened(spark, d, mode: str = "NORMAL", base: str | None = None, **changes) -> ops.Table:
    return ops.Table.open(spark, base or f"{fs.shared_dir(spark)}/tables-{uuid.uuid4().hex}", ORDER, mode, **changes)


def again(t: ops.Table) -> ops.Table:
    """The same table as another process finds it."""
    t.close()
    return ops.Table.open(t.spark, t.base, ORDER)


def batches(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All orders; every third at twice its price; the keys of every ninth."""
    o = read(s, d, "orders").select(*ORDER.schema.fieldNames())
    return o, o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), o.filter("o_orderkey % 9 = 0").select("o_orderkey")


STORED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0"


def written(s, d, mode="NORMAL", **changes) -> ops.Table:
    t = opened(s, d, mode, **changes)
    a, b, c = batches(s, d)
    t.put_all(a)
    t.put_all(b)
    t.delete_all(c)
    return t


add("store_put_delete", STORED)(lambda s, d: written(s, d).live())
add("store_flush_reopen", STORED)(lambda s, d: again(written(s, d, "FAST")).live())
add("store_range", f"SELECT * FROM ({STORED}) WHERE o_orderkey >= 300 AND o_orderkey < 900")(lambda s, d: again(written(s, d)).range(300, 900))
add("store_query", f"SELECT * FROM ({STORED}) WHERE o_totalprice > 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")(lambda s, d: written(s, d).query((C("o_totalprice") > 250000) & C("o_orderpriority").isin(["1-URGENT", "2-HIGH"])).df)
add("store_get_all", f"SELECT * FROM ({STORED}) WHERE o_orderkey IN (SELECT c_custkey FROM customer)")(lambda s, d: again(written(s, d)).get_all(read(s, d, "customer").select(F.col("c_custkey").alias("o_orderkey"))))


@add("store_unflushed_log", STORED)
def _(s, d):
    """Batches that no flush has seen are on disk: a table that is opened anew without a close has them."""
    t = written(s, d, "ULTRA_FAST")
    return ops.Table.open(s, t.base, ORDER, "ULTRA_FAST").live()


@add("store_compact", STORED)
def _(s, d):
    t = written(s, d, max_files_per_level=1, retain_s=0)
    t.compact(0)
    return again(t).live()


@add("store_snapshot_read", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(s, d):
    """A frame that was taken before later batches and compactions still has its rows."""
    t = opened(s, d, max_files_per_level=1)
    a, b, c = batches(s, d)
    t.put_all(a)
    before = t.live()
    t.put_all(b)
    t.delete_all(c)
    t.compact(0)
    return before


@add("store_last_row_wins", "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderpriority FROM orders")
def _(s, d):
    """A batch with each key twice: the later row of the frame counts. A union's later frame has later places, however
    many partitions each has."""
    t, o = opened(s, d), batches(s, d)[0]
    t.put_all(o.union(o.withColumn("o_totalprice", F.col("o_totalprice") + 1)))
    return t.live()


@add("store_cas", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 1")
def _(s, d):
    """By the remainder: swapped, deleted, a stale seq, no request."""
    t, o = opened(s, d), batches(s, d)[0]
    seq, r = t.put_all(o), F.col("o_orderkey") % 4
    t.compare_and_swap_all(o.filter("o_orderkey % 4 < 3").select("o_orderkey", F.when(r < 2, seq).otherwise(seq + 7).cast("long").alias("expected_seq"), (r == 1).alias("delete"), F.lit(-1.0).alias("o_totalprice"), "o_orderpriority"))
    return again(t).live()


@add("store_cas_decisions", "SELECT o_orderkey, o_orderkey % 4 < 2 AS applied FROM orders WHERE o_orderkey % 4 < 3")
def _(s, d):
    t, o = opened(s, d), batches(s, d)[0]
    seq, r = t.put_all(o), F.col("o_orderkey") % 4
    return t.compare_and_swap_all(o.filter("o_orderkey % 4 < 3").select("o_orderkey", F.when(r < 2, seq).otherwise(seq + 7).cast("long").alias("expected_seq"), (r == 1).alias("delete"), F.lit(-1.0).alias("o_totalprice"), "o_orderpriority"))


@add("store_upsert", "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders")
def _(s, d):
    t = opened(s, d, "FAST")
    a, b, _ = batches(s, d)
    t.put_all(a)
    for _ in range(2):
        t.upsert_all(b.select("o_orderkey"), {"o_totalprice": F.col("o_totalprice") + 1})
    return again(t).live()


@add("store_apply", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0")
def _(s, d):
    """Puts and deletes in one batch."""
    t, o = opened(s, d), batches(s, d)[0]
    t.apply_all(o.withColumn("gone", F.col("o_orderkey") % 3 == 0), "gone")
    return t.live()


@add("store_truncate", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def _(s, d):
    t = written(s, d)
    t.truncate()
    t.put_all(batches(s, d)[1])
    return again(t).live()


@add("store_last_seq", "SELECT CAST(3 AS BIGINT) AS last_seq, CAST(1 AS BIGINT) AS seq_of_first")
def _(s, d):
    t = again(written(s, d, "FAST"))
    return s.createDataFrame([(t.last_seq(), t.seq_of(1))], "last_seq long, seq_of_first long")


@add("store_manifest", "SELECT * FROM (VALUES (1, CAST(1 AS BIGINT), CAST(4 AS BIGINT), CAST(0 AS BIGINT), CAST(4 AS BIGINT))) t(level, live_runs, retired_runs, deleted_runs, last_seq)")
def _(s, d):
    """Four batches, one compaction: the manifest as another process folds it."""
    t = written(s, d)
    t.put_all(batches(s, d)[1])
    t.compact(0)
    state = again(t).store.state
    return s.createDataFrame([(e["level"], len(state.live), len(state.retired), len(state.deleted), state.last_seq) for e in state.live.values()], "level int, live_runs long, retired_runs long, deleted_runs long, last_seq long")


@add("store_kv", "SELECT lower(hex(encode(c_name))) AS key, lower(hex(encode(c_mktsegment))) AS value FROM customer")
def _(s, d):
    """Opaque bytes by opaque bytes."""
    e = ops.Engine.open(s, f"{fs.shared_dir(s)}/tables-{uuid.uuid4().hex}", "FAST")
    e.kv().put_all(read(s, d, "customer").select(F.col("c_name").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value")))
    e.close()
    rows = ops.Engine.open(s, e.base).kv().range()
    return rows.select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"))
