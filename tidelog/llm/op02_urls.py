"""URL filter: allow and block rules by host and path prefix, tested through Bloom filter cascades.

A rule's key is its host and path joined. The keys of a url are all its host suffixes (at dots) times the
prefixes of its path that are as long as some rule's. The corpus's key universe is the set of all such keys.
A cascade holds the listed keys: level 1 is a Bloom filter of them; level 2 is one of the unlisted keys of
the universe that pass level 1; level 3 is one of the listed keys that pass level 2; and so on until no key
passes wrongly. Membership is then exact for every key of the universe, and no url is joined with anything.

Filters are built by aggregation (bit_or over 64-bit words) and kept as literals; `max_words` bounds them
and an error says so. Level 1 has a false positive rate of about listed / (sqrt 2 * unlisted), so that the
false positives are as few as the listed keys, however many the universe has; later levels have one half.

Defined results: null urls, and those without `://`, have empty host and path and fit no rule; repeated pages
are judged alike; a url that fits no rule is not listed, and so allowed. With rules of equal length, the one
with the longer host wins, then block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import stored, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@dataclass
class Level:
    bits: int
    k: int
    words: list[int]

    def has(self, key: Column, seed: int) -> Column:
        words, out = F.lit(self.words), None
        for i in range(self.k):
            at = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(self.bits).cast("long"))
            hit = F.bit_get(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


@dataclass
class Cascade:
    levels: list[Level]
    seed: int

    def has(self, key: Column) -> Column:
        """Exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].has(key, self.seed + i), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_level(keys: DataFrame, n: int, rate: float, seed: int, max_words: int) -> Level:
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    bits += -bits % 64
    if bits // 64 > max_words:
        raise ValueError(f"a filter of {n} keys needs {bits // 64} words, more than max_words = {max_words}")
    k = max(1, min(16, round(bits / max(n, 1) * math.log(2))))
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(k)]))
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(bits, k, words)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, seed: int, max_words: int = 1 << 20, max_levels: int = 40) -> Cascade:
    """listed, universe: DataFrames with `key`; the universe may repeat keys. Two passes over the universe:
    the caller's count, and the false positives of level 1, which are stored."""
    listed = listed.select("key").distinct()
    n = listed.count()
    if n == 0:
        return Cascade([], seed)
    rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(1, n_universe - n))))
    levels = [build_level(listed, n, rate, seed, max_words)]
    wrong = stored(universe.select("key").filter(levels[0].has(F.col("key"), seed)).distinct().join(listed, "key", "left_anti"), "cascade")
    sets = [listed, wrong]
    while (m := sets[1].count()) and len(levels) < max_levels:
        # sets[1] passes all levels wrongly and goes into the next one; what of the other set passes that is next
        levels.append(build_level(sets[1], m, 0.5, seed + len(levels), max_words))
        sets = [sets[1], sets[0].filter(levels[-1].has(F.col("key"), seed + len(levels) - 1))]
    if m:
        raise ValueError("the cascade does not end; are keys both listed and unlisted?")
    return Cascade(levels, seed)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct (size, host_size, key) of a url. A key's size is its number of characters."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.struct((F.length(s) + F.length(p)).alias("size"), F.length(s).alias("host_size"), F.concat(s, p).alias("key")))))
    return F.array_distinct(keys)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url: str = "url", max_words: int = 1 << 20) -> DataFrame:
    """keep's columns, host, path, rule, verdict. rules: a bounded list (host, path, allow or block)."""
    spark = pages.sparkSession
    bad = [r for r in rules if r[2] not in ("allow", "block") or not r[1].startswith("/") or r[0] != r[0].lower()]
    if bad:
        raise ValueError(f"bad rules: {bad}")
    lengths = sorted({len(p) for _, p, _ in rules}) or [1]
    host, path = host_path(F.col(url))
    base = pages.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"))
    universe = base.select(F.explode(url_keys(F.col("host"), F.col("path"), lengths)).alias("k")).select(F.col("k.key").alias("key"))
    n = universe.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    cascades = {}
    for i, verdict in enumerate(("block", "allow")):
        keys = [(h + p,) for h, p, v in rules if v == verdict]
        cascades[verdict] = build_cascade(spark.createDataFrame(keys, "key string"), universe, n, 1000 * i, max_words)
    hits = F.filter(url_keys(F.col("host"), F.col("path"), lengths), lambda k: cascades["block"].has(k["key"]) | cascades["allow"].has(k["key"]))
    out = base.withColumn("_hit", F.array_max(hits)["key"])
    verdict = F.when(F.col("_hit").isNotNull() & cascades["block"].has(F.col("_hit")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keep, "host", "path", F.col("_hit").alias("rule"), verdict.alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES, ["page_id"])


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERIES = {"op2_urls": op2_urls}
ORACLE = {
    "op2_urls": f"""WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_UP.lower()}') AS host,
      regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    r(h, p, v) AS (VALUES {', '.join(str(r) for r in RULES)}),
    hit AS (SELECT rid, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS v FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hit USING (rid)"""
}
