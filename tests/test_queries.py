"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = core.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(core.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(norm(v) for v in r) for r in rel.select(*cols).fetchall())
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_last_row_wins_over_many_tasks(spark, tmp_path):
    """A table of four parts, each key twice in the batch: no task writes more than a part."""
    orders = spark.read.parquet(f"{D}/orders.parquet")
    orders.repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        df = core.QUERIES["store_last_row_wins"](spark, str(tmp_path))
        assert {(r.o_orderkey, r.o_totalprice) for r in df.collect()} == {(r.o_orderkey, r.o_totalprice + 1) for r in orders.collect()}
        run = df.inputFiles()
        assert len(run) == 8 and max(spark.read.parquet(f).count() for f in run) < orders.count() / 3
    finally:
        spark.conf.set(key, before)
