"""The table API against a dict, and each rule of the version log."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import codec, parity
from tidelog.operators.schema import Entity, Options, preset
from tidelog.operators.table import Engine, Table
from tidelog.plans import expr as X
from tidelog.plans import resolve
from tidelog.sources import manifest
from tidelog.streaming.ingest import ingest

USER = Entity("users", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("active", T.BooleanType())]), "id", {"age": 0})


def users(spark, base, **kw):
    t = Table.open(spark, str(base), USER, "CUSTOM", **kw)
    t.put_all(spark.createDataFrame([("u001", "Taro", 30, True), ("u002", "Hanako", 25, True), ("u003", "Jiro", 18, False)], USER.schema))
    return t


def test_queries(spark, tmp_path):
    t = users(spark, tmp_path)
    assert [r.id for r in sorted(t.run_to_list(lambda c: (c("age") >= 25) & (c("active") == True)))] == ["u001", "u002"]  # noqa: E712
    assert t.first_or_null(lambda c: c("age") >= 30).id == "u001"
    assert t.first_or_null(lambda c: c("age") > 99) is None
    assert t.exists(lambda c: c("name") == X.Param("who"), who="Taro")
    assert t.count(lambda c: c("age") < 20) == 1
    with pytest.raises(KeyError):
        t.count(lambda c: c("name") == X.Param("who"))


def test_write_read_reopen(spark, tmp_path):
    t = users(spark, tmp_path)
    s1 = t.put({"id": "u001", "name": "T", "age": 31, "active": True})
    assert t.delete("u002") > s1 and t.get("u002") is None and t.get("u001").age == 31
    last = t.last_seq()
    t.close()
    t = Table.open(spark, str(tmp_path), USER)
    assert t.last_seq() == last and t.get("u002") is None and t.get("u001").age == 31
    assert t.put({"id": "u002", "name": "back", "age": 1, "active": True}) > last
    assert t.get("u002").name == "back"
    assert [r.id for r in t.range("u001", "u003").collect()] == ["u001", "u002"]
    assert t.upsert("u009", {"age": F.col("age") + 1}).age == 1
    assert t.upsert("u009", {"age": F.col("age") + 1}).age == 2
    assert {r.id for r in t.get_all(spark.createDataFrame([("u001",), ("zz",)], "id string")).collect()} == {"u001"}


def test_compare_and_swap(spark, tmp_path):
    t = users(spark, tmp_path)
    seq = t.seq_of("u001")
    new = {"name": "N", "age": 1, "active": False}
    assert not t.compare_and_swap("u001", seq + 1, new)
    assert t.compare_and_swap("u001", seq, new) and t.get("u001").name == "N"
    assert not t.compare_and_swap("u001", seq, new)
    assert t.compare_and_swap("new", -1, new) and t.get("new").age == 1
    assert not t.compare_and_swap("new", None, new)
    assert t.compare_and_swap("new", t.seq_of("new"), None) and t.get("new") is None
    assert t.compare_and_swap("new", None, new) and t.get("new").age == 1


def test_random_operations_against_a_dict(spark, tmp_path):
    rng, model = random.Random(5), {}
    t = Table.open(spark, str(tmp_path), USER, "CUSTOM", max_files_per_level=2, flush_every=2, tombstone_ttl_s=0)
    for i in range(14):
        k = [f"k{rng.randrange(6)}" for _ in range(3)]
        op = rng.choice(["put", "put", "delete", "flush", "compact"])
        if op == "put":
            rows = {x: (x, f"n{i}", i, None) for x in k}
            t.put_all(spark.createDataFrame(list(rows.values()), USER.schema))
            model |= rows
        elif op == "delete":
            t.delete_all(spark.createDataFrame([(x,) for x in k], "id string"))
            for x in k:
                model.pop(x, None)
        elif op == "flush":
            t.flush()
        else:
            t.compact(0)
        if i % 4 == 3:
            assert {r.id: tuple(r) for r in t.live().collect()} == model
    t.close()
    t = Table.open(spark, str(tmp_path), USER)
    assert {r.id: tuple(r) for r in t.live().collect()} == model
    assert len(t.store.levels().get(0, [])) <= 4


def test_kv_byte_order_and_conflict(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path))
    kv = e.kv()
    kv.put_all(spark.createDataFrame([(bytearray(k), bytearray(b"v")) for k in (b"\xff", b"\x01", b"\x7f\x00", b"\x7f")], "key binary, value binary"))
    assert [bytes(r.key) for r in kv.range().collect()] == [b"\x01", b"\x7f", b"\x7f\x00", b"\xff"]
    assert [bytes(r.key) for r in kv.range(bytearray(b"\x7f"), bytearray(b"\xff")).collect()] == [b"\x7f", b"\x7f\x00"]
    other = Table(spark, str(tmp_path), kv.entity, Options())
    kv.put({"key": bytearray(b"a"), "value": bytearray(b"1")})
    with pytest.raises(manifest.Conflict):
        other.put({"key": bytearray(b"a"), "value": bytearray(b"2")})
    assert e.last_seq() == 2
    e.close()


def test_last_row_of_a_batch(spark, tmp_path):
    t = Table.open(spark, str(tmp_path), USER)
    t.put_all(spark.createDataFrame([("a", "x", 1, True), ("a", "y", 2, True)], USER.schema), order_by="age")
    assert t.get("a").name == "y"


def test_ties(spark):
    log = spark.createDataFrame([("a", 1, False, 1, "x"), ("a", 1, False, 2, "y"), ("b", 1, False, 1, "x"), ("b", 1, True, 2, "y")], "k string, s long, t boolean, o long, v string")
    assert [(r.k, r.v) for r in resolve.live(log, "k", "s", "t", "o").collect()] == [("a", "x")]


def test_null_logic(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, 2.0), (3, 2.0, 2.0), (4, None, 3.0), (5, float("nan"), 1.0)], "id int, a double, b double")
    nan = lambda x: float("inf") if x is not None and x != x else x
    rows = [(r.id, nan(r.a), nan(r.b)) for r in df.collect()]
    cases = [(X.Bin(op, X.Col("a"), X.Col("b")), f) for op, f in {
        "EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "GT": lambda a, b: None not in (a, b) and a > b, "GE": lambda a, b: None not in (a, b) and a >= b,
        "LT": lambda a, b: None not in (a, b) and a < b, "LE": lambda a, b: None not in (a, b) and a <= b}.items()]
    for e, f in cases:
        for g, h in ((e, f), (~e, lambda a, b, f=f: not f(a, b)), (~~e, f), (e & ~e, lambda a, b: False), (e | ~e, lambda a, b: True)):
            want = [i for i, a, b in rows if h(a, b)]
            assert sorted(r.id for r in df.filter(X.to_filter(g)).collect()) == want
            assert sorted(r.id for r in df.select("id", X.to_bool(g).alias("x")).filter("x").collect()) == want
            assert df.select(X.to_bool(g).alias("x")).filter("x IS NULL").count() == 0
    with pytest.raises(TypeError):
        bool(X.Col("a") > 1)


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = df.filter(X.to_filter(~(X.Col("value") > 50) & X.Col("event_type").notin(["click"])))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(value" in plan and "PushedFilters: []" not in plan


def test_manifest_fold_and_rotation(spark, tmp_path):
    m = manifest.Manifest(spark, str(tmp_path))
    s = m.load()
    for r in "abc":
        s = m.append(s, {"type": "Seal", "run": r, "level": 0, "rows": 1, "last_seq": 1})
    s = m.append(s, {"type": "CompactionEnd", "inputs": ["a", "b"], "output": "d", "level": 1, "last_seq": 1}, {"type": "Delete", "run": "c"}, {"type": "Checkpoint", "last_seq": 7})
    assert set(s.live) == set(m.load().live) == {"d"} and m.load().last_seq == 7
    m.rotate(s)
    assert set(m.load().live) == {"d"} and m.load().last_seq == 7 and m.load().version == s.version
    s = m.append(m.load(), {"type": "Seal", "run": "e", "level": 0})
    assert {r.run for r in m.describe().collect()} == {"d", "e"}
    with pytest.raises(ValueError):
        manifest.fold([{"type": "?"}])


def test_checks(spark):
    for bad in ({"bloom_fpp": 0.9}, {"max_files_per_level": 0}, {"tombstone_ttl_s": -1}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        preset("SLOW")
    with pytest.raises(ValueError):
        Entity("x", T.StructType([T.StructField("a", T.LongType())]), "b")


def test_codec():
    s = T.StructType([T.StructField("i", T.IntegerType(), False), T.StructField("s", T.StringType()), T.StructField("d", T.DecimalType(20, 4)), T.StructField("l", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("t", T.TimestampNTZType()), T.StructField("day", T.DateType()), T.StructField("in", T.StructType([T.StructField("x", T.DoubleType())]))])
    v = {"i": -5, "s": "ひé", "d": decimal.Decimal("-12.3400"), "l": ["a", None], "m": {"k": 2}, "t": dt.datetime(2024, 1, 2, 3, 4, 5, 678000), "day": dt.date(1969, 12, 31), "in": {"x": 1.5}}
    assert codec.deep_copy(v, s) == v
    none = dict.fromkeys(v) | {"i": 1}
    assert codec.deep_copy(none, s) == none
    with pytest.raises(ValueError):
        codec.decode(codec.encode(v, s) + b"x", s)
    codec.register("upper", lambda x: x.upper().encode(), lambda b: b.decode())
    assert codec.deep_copy({"a": "q"}, T.StructType([T.StructField("a", T.StringType(), False, {"adapter": "upper"})])) == {"a": "Q"}
    assert codec.unregister("upper")


def test_hashes():
    assert codec.crc32c_np([b"123456789", b""]).tolist() == [0xE3069283, 0]
    assert codec.fnv1a32_np([b"a", b"foobar"]).tolist() == [0xE40C292C, 0xBF9CF968]
    key = bytes(range(16))
    k0, k1 = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
    assert int(codec.siphash24_np([bytes(range(15)), b"", bytes(8)], k0, k1)[0]) == 0xA129CA6149BE45E5
    assert int(codec.mix64_np(__import__("numpy").array([0x9E3779B97F4A7C15], dtype="uint64"))[0]) == 0xE220A8397B1DCDAF
    assert int(codec.murmur3_128_np([b""])[0]) == 0
    assert len(codec.new_short_uuid()) == 22


def test_parity(spark):
    rng = random.Random(1)
    for k, m in ((4, 0), (4, 1), (4, 2), (6, 3)):
        c, data = parity.Coder(k, m), [rng.randbytes(64) for _ in range(k)]
        lanes = data + c.encode(data)
        for _ in range(5):
            lost = rng.sample(range(k + m), m)
            assert c.reconstruct([None if i in lost else x for i, x in enumerate(lanes)]) == lanes
    with pytest.raises(ValueError):
        parity.Coder(2, 1).reconstruct([None, None, b"a"])
    df = spark.createDataFrame([(s, i, bytearray(rng.randbytes(32))) for s in range(3) for i in range(4)], "stripe long, lane int, block binary")
    full = parity.encode_stripes(df, 4, 2)
    back = parity.recover_stripes(full.filter("lane not in (0, 3)"), 4, 2)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "id string, name string, age int, active boolean, gone boolean"
    spark.createDataFrame([("a", "x", 1, True, False), ("a", "y", 2, True, False), ("b", "z", 1, True, False)], schema).coalesce(1).write.parquet(str(src))
    t = Table.open(spark, str(tmp_path / "t"), USER)
    run = lambda: ingest(spark.readStream.schema(schema).parquet(str(src)), t, str(tmp_path / "cp"), "age", "gone").awaitTermination()
    run()
    assert {(r.id, r.name) for r in t.live().collect()} == {("a", "y"), ("b", "z")}
    spark.createDataFrame([("b", None, 5, None, True)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert {(r.id, r.name) for r in t.live().collect()} == {("a", "y")}


def test_last_row_of_a_batch_without_an_order(spark, tmp_path):
    t = Table.open(spark, str(tmp_path), USER)
    t.put_all(spark.createDataFrame([("a", "x", 1, True), ("b", "x", 1, True), ("a", "y", 2, True)], USER.schema).coalesce(1))
    assert t.get("a").name == "y" and t.get("b").name == "x"
    t.apply_all(spark.createDataFrame([("a", "z", 3, True, True), ("a", "w", 4, True, False), ("b", "w", 4, True, False), ("b", None, None, None, True)], "id string, name string, age int, active boolean, gone boolean").coalesce(1), "gone")
    assert t.get("a").name == "w" and t.get("b") is None


def test_reads_survive_compaction_until_the_vacuum(spark, tmp_path):
    t = users(spark, tmp_path)
    before = t.live()
    t.delete("u001")
    t.compact(0)
    assert before.count() == 3 and t.live().count() == 2
    assert t.store.vacuum() == [] and len(t.store.state.retired) == 2
    gone = t.store.vacuum(0)
    assert len(gone) == 2 and not any(t.store.files.exists(r) for r in gone)
    s = Table.open(spark, str(tmp_path), USER).store.state
    assert not s.retired and s.deleted == set(gone)


def test_acknowledged_batches_are_on_disk(spark, tmp_path):
    t = Table.open(spark, str(tmp_path), USER, "ULTRA_FAST")
    seq = t.put({"id": "a", "name": "x", "age": 1, "active": True})
    other = Table.open(spark, str(tmp_path), USER, "ULTRA_FAST")  # the first writer is lost
    assert other.get("a").name == "x" and other.last_seq() == seq
    other.flush()
    assert [e["level"] for e in other.store.state.live.values()] == [0] and other.get("a").name == "x"


def test_many_upserts_have_small_plans(spark, tmp_path):
    t, size = Table.open(spark, str(tmp_path), USER, "ULTRA_FAST"), []
    for i in range(5):
        assert t.upsert("u", {"age": F.col("age") + 1}).age == i + 1
        size.append(len(t.live()._jdf.queryExecution().analyzed().toString()))
    assert size[-1] < 1.2 * size[0]


def test_resolution_has_one_exchange_and_an_early_limit(spark):
    log = spark.createDataFrame([("a", 1, False, 1)], "k string, s long, t boolean, o long")
    plan = resolve.live(log, "k", "s", "t", "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2


def test_truncate_rotation_and_parity_events(spark, tmp_path):
    t = users(spark, tmp_path)
    run = next(iter(t.store.state.live))
    t.store.protect(run)
    assert t.store.damaged(run).count() == 0
    parts = [p for p in (tmp_path / "users" / run).iterdir() if p.name.endswith(".parquet")]
    data = bytearray(parts[0].read_bytes())
    data[10] ^= 255
    parts[0].write_bytes(bytes(data))
    (parts[0].parent / f".{parts[0].name}.crc").unlink(missing_ok=True)
    (bad,) = t.store.damaged(run).collect()
    assert bad.lane == 0 and bad.block[10] == data[10] ^ 255
    t.truncate()
    assert t.live().count() == 0 and run in t.store.state.retired
    t.store.manifest.rotate(t.store.state)
    again = Table.open(spark, str(tmp_path), USER)
    assert set(again.store.state.retired) == {run} and set(again.store.state.striped) == {run} and again.last_seq() == 1


def test_one_of_two_writers_wins_a_name(spark, tmp_path):
    from tidelog.sources.fs import Files

    f = Files(spark, f"file://{tmp_path}")
    assert f.create("a", "1") and not f.create("a", "2") and f.read("a") == "1" and f.list("") == ["a"]


def test_adapters_and_short_ids(spark):
    codec.register("low", lambda x: x.lower().encode(), lambda b: b.decode())
    kind = T.StructType([T.StructField("a", T.StringType(), False, {"adapter": "low"})])
    assert codec.has_adapter("low") and not codec.has_adapter("high") and codec.deep_copy({"a": "Q"}, kind) == {"a": "q"}
    assert codec.adapter_stats()["low"] == {"encoded": 1, "decoded": 1}
    codec.clear_adapters()
    assert not codec.adapter_stats()
    rows = spark.createDataFrame([("AAAAAAAAAAAAAAAAAAAAAA",), ("AAAAAAAAAAAAAAAAAAAAAB",), ("short",), (None,)], "s string")
    got = rows.select(codec.is_short_uuid(F.col("s")).alias("ok"), codec.short_uuid_be_decode(F.col("s")).alias("u")).collect()
    assert [r.ok for r in got] == [True, False, False, False] and [r.u is None for r in got] == [False, True, True, True]


def test_parity_of_many_stripes_at_once(spark):
    """No Python call for each stripe; batches end within stripes, widths and losses differ, a missing CRC32 is no damage."""
    rng, key = random.Random(2), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(s, i, bytearray(rng.randbytes(w))) for s in range(300) for w in [rng.choice([0, 1, 40, rng.randrange(500)])] for i in range(4)]
    df = spark.createDataFrame(rows, "stripe long, lane int, block binary").repartition(3)
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        full = parity.encode_stripes(df, 4, 2)
        hurt = full.filter("lane <> stripe % 6").withColumn("crc", F.expr("if(lane % 2 = 0, crc, null)"))
        hurt = hurt.withColumn("block", F.expr("if(lane = (stripe + 2) % 6, if(lane % 2 = 0, concat(block, X'01'), null), block)"))
        back = parity.recover_stripes(hurt, 4, 2)
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()} and back.count() == 1200
        assert full.filter("crc = crc32(block)").count() == 1800
        for d in (full, back):
            assert "InPandas" not in d._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(Exception, match="3 lanes are lost; 2 is the most"):
            parity.recover_stripes(full.filter("stripe <> 7 or lane > 2"), 4, 2).collect()
        with pytest.raises(Exception, match="4 blocks at most"):
            parity.encode_stripes(full, 4, 2).collect()
    finally:
        spark.conf.set(key, before)
