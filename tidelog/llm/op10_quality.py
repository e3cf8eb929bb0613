"""Quality rules whose thresholds come from the data: one mergeable quantile sketch per language and source.

The sketch of a metric is a histogram over buckets of the metric's leading six bits (relative error below
1/32). Adding counts merges sketches, so partial sketches are combined before the one small shuffle, and a
language's or the corpus's sketch is the sum of its sources'. Counts do not depend on the order of rows:
the thresholds are the same for any partitioning, and SQL can repeat them.

A metric's upper fence is q50 + REACH * max(q75 - q50, floor); mean word length has a lower fence, too.
Groups of fewer than MIN_DOCS documents use the sketch of their language, then that of the corpus. Sketches
hold the documents that pass the base rules.

Defined results: null text is empty; null language or source is a group of its own; repeated rows count and
are judged alike; extra columns never matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE, WORD_BYTE, let, stored, table, text_of

BITS, REACH, MIN_DOCS, WINDOW = 6, 8, 50, 8
#: metric: (numerator, denominator, scale, floor of the spread, has a lower fence)
METRICS = {
    "sym": ("n_symbols", "n_words", 1000, 20, False),
    "dup": ("n_dup_lines", "n_lines", 1000, 50, False),
    "rep": ("n_repeat_words", "n_words", 1000, 40, False),
    "adj": ("n_stutters", "n_words", 1000, 50, False),
    "len": ("word_chars", "n_words", 100, 50, True),
}
#: Below so many groups the fences are sent to all executors; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _covered(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""

    def spread(h: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(s, j)["i"]))
            return let(at, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.coalesce(F.least(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW)), F.lit(WINDOW))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n >= WINDOW + 1, let(hashes, spread)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct with the base counts of a text."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_BYTE))
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda s: F.struct(
        F.size(s["w"]).cast("long").alias("n_words"),
        F.char_length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
        _covered(s["w"]).alias("n_repeat_words"),
        F.size(s["l"]).cast("long").alias("n_lines"),
        F.size(F.filter(F.zip_with(s["w"], F.slice(s["w"], 2, F.greatest(F.size(s["w"]), F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutters"),
    ))


def _ratio(m: str) -> Column:
    num, den, scale, _, _ = METRICS[m]
    return F.expr(f"CASE WHEN m.{den} > 0 THEN ({scale} * m.{num}) div m.{den} ELSE 0 END")


def _bucket(v: Column) -> Column:
    s = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, s), s)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable part; partial counts combine before the shuffle."""
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(_ratio(k)).alias("bucket")) for k in METRICS])
    return measured.filter("NOT base_failed").select("lang", "source", F.explode(entries).alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def fences(sk: DataFrame) -> DataFrame:
    """One row per (lang, source): lo_<metric> and hi_<metric>."""
    return sk.sparkSession.sql(FENCES_SQL.replace("SKETCH", "{sketch}"), sketch=sk)


def _case(col):
    return " ".join(f"WHEN metric = '{k}' THEN {v[col]}" for k, v in METRICS.items())


#: Runs in Spark and in DuckDB.
FENCES_SQL = f"""
WITH lv AS (
  SELECT 0 AS lvl, lang, source, metric, bucket, n FROM SKETCH
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM SKETCH GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM SKETCH GROUP BY metric, bucket),
cum AS (
  SELECT lvl, lang, source, metric, bucket,
    sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS c,
    sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS t FROM lv),
q AS (
  SELECT lvl, lang, source, metric, max(t) AS t,
    min(CASE WHEN 4 * c >= t THEN bucket END) AS q25, min(CASE WHEN 2 * c >= t THEN bucket END) AS q50, min(CASE WHEN 4 * c >= 3 * t THEN bucket END) AS q75
  FROM cum GROUP BY lvl, lang, source, metric),
f AS (
  SELECT lvl, lang, source, metric, t,
    q50 + {REACH} * greatest(q75 - q50, CASE {_case(3)} END) AS hi,
    CASE WHEN metric IN ({', '.join(repr(k) for k, v in METRICS.items() if v[4])}) THEN q50 - {REACH} * greatest(q50 - q25, CASE {_case(3)} END) ELSE -1 END AS lo
  FROM q),
pick AS (
  SELECT a.lang, a.source, a.metric,
    CASE WHEN a.t >= {MIN_DOCS} THEN a.hi WHEN b.t >= {MIN_DOCS} THEN b.hi ELSE c.hi END AS hi,
    CASE WHEN a.t >= {MIN_DOCS} THEN a.lo WHEN b.t >= {MIN_DOCS} THEN b.lo ELSE c.lo END AS lo
  FROM f a JOIN f b ON b.lvl = 1 AND b.metric = a.metric AND b.lang IS NOT DISTINCT FROM a.lang
  JOIN f c ON c.lvl = 2 AND c.metric = a.metric WHERE a.lvl = 0)
SELECT lang, source, {', '.join(f"max(CASE WHEN metric = '{k}' THEN {e} END) AS {e}_{k}" for k in METRICS for e in ('lo', 'hi'))}
FROM pick GROUP BY lang, source"""


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """One row per document: keep's columns, lang, source, m (counts), base_failed."""
    out = docs.select(*keep, F.col("lang"), F.col("source"), measures(text_of()).alias("m"))
    return out.withColumn("base_failed", (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words")))


def judge(m: DataFrame) -> DataFrame:
    """Adds `kept` to a measured and stored table: joined with the fences of its language and source."""
    f = stored(fences(sketches(m)), "fences")
    f = f.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in f.columns if c not in ("lang", "source")])
    if f.count() <= BROADCAST_GROUPS:
        f = F.broadcast(f)
    inside = [_ratio(k).between(F.col(f"lo_{k}"), F.col(f"hi_{k}")) for k in METRICS]
    ok = inside[0]
    for x in inside[1:]:
        ok = ok & x
    return m.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored(measured(table(spark, sf_dir, "documents"), F.col("doc_id")), "quality")
    return judge(m).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    m = stored(measured(docs, F.struct("*").alias("doc")), "quality")
    return judge(m).filter("kept").select("doc.*")


def _sql_bucket(v: str) -> str:
    s = f"greatest(length(bin(CAST({v} AS BIGINT))) - {BITS}, 0)"
    return f"((CAST({v} AS BIGINT) >> CAST({s} AS INTEGER)) << CAST({s} AS INTEGER))"


def _sql_ratio(k: str) -> str:
    num, den, scale, _, _ = METRICS[k]
    return f"CASE WHEN {den} > 0 THEN ({scale} * {num}) // {den} ELSE 0 END"


#: DuckDB; DOCS: the table. More columns of it pass through `measured`.
CTES = f"""
words AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM DOCS),
win AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS c FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
base AS (SELECT words.* EXCLUDE (ws, ls), CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stutters FROM words LEFT JOIN cover USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS metric, {_sql_bucket(_sql_ratio(k))} AS bucket FROM judged WHERE NOT base_failed" for k in METRICS)}) GROUP BY ALL),
fen AS ({FENCES_SQL.replace('SKETCH', 'sk')}),
verdicts AS (SELECT judged.*, NOT base_failed AND coalesce({' AND '.join(f"{_sql_ratio(k)} BETWEEN lo_{k} AND hi_{k}" for k in METRICS)}, false) AS kept
  FROM judged LEFT JOIN fen ON judged.lang IS NOT DISTINCT FROM fen.lang AND judged.source IS NOT DISTINCT FROM fen.source)"""

QUERIES = {"op10_quality": op10_quality}
ORACLE = {"op10_quality": f"WITH {CTES.replace('DOCS', 'documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"}
