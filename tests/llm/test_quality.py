"""op10: the base counts against plain Python, the verdicts against SQL."""

import re

import duckdb

from tests.llm.helpers import DOCS, WORD, clashing, odd_docs, table_at
from tidelog.llm import op10_quality as op

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def sql_rows(d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return sorted(map(str, con.sql(op.ORACLE["op10_quality"]).select(*COLUMNS).fetchall()))


def test_odd_rows(spark, tmp_path):
    docs = odd_docs()
    d = table_at(spark, tmp_path, documents=clashing(spark.createDataFrame(docs, DOCS).repartition(3)))
    got = op.op10_quality(spark, d).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(str((k, *base(t))) for k, t, *_ in docs)
    assert not any(r.kept and r.base_failed for r in got)


def test_verdicts_like_sql(spark, tmp_path):
    """Enough documents for fences of groups, of languages, and of all."""
    import random

    rng = random.Random(3)
    docs = []
    for i in range(400):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(5, 80))]
        if i % 17 == 0:
            words += ["#$%|"] * rng.randrange(10, 90)
        if i % 19 == 0:
            words += ["same"] * rng.randrange(10, 30)
        docs.append((i if i % 50 else None, " ".join(words) + "\nline" * (i % 23 == 0) * rng.randrange(60), [None, "en", "de"][i % 7 % 3], ["web", f"rare{i % 40}", None][i % 3], 1))
    d = table_at(spark, tmp_path, documents=spark.createDataFrame(docs, DOCS))
    got = [tuple(r) for r in op.op10_quality(spark, d).select(*COLUMNS).collect()]
    assert sorted(map(str, got)) == sql_rows(d)
    assert 0 < sum(r[7] for r in got) < len(got) - sum(r[6] for r in got)


def test_filter_and_empty(spark, tmp_path):
    df = clashing(spark.createDataFrame(odd_docs(), DOCS))
    out = op.filter_quality(df)
    assert out.columns == df.columns
    d = table_at(spark, tmp_path, documents=df)
    want = sorted(str(r.doc_id) for r in op.op10_quality(spark, d).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == want
    assert op.op10_quality(spark, table_at(spark, tmp_path / "none", documents=spark.createDataFrame([], DOCS))).count() == 0


def test_sketches_merge(spark):
    """Sketches of two halves add up to that of the whole."""
    df = spark.createDataFrame([(i, "word " * (i % 30), "en", "web", 1) for i in range(200)], DOCS)
    m = op.measured(df, df.doc_id)
    whole = {tuple(r)[:4]: r.n for r in op.sketches(m).collect()}
    parts = {}
    for half in (0, 1):
        for r in op.sketches(m.filter(f"doc_id % 2 = {half}")).collect():
            parts[tuple(r)[:4]] = parts.get(tuple(r)[:4], 0) + r.n
    assert parts == whole


def test_no_python_in_the_plan(spark, tmp_path):
    d = table_at(spark, tmp_path, documents=spark.createDataFrame(odd_docs(), DOCS))
    plan = op.op10_quality(spark, d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
