"""op2 against each rule tried on each url; filter cascades against sets."""

import random

import pytest

from tests.llm.helpers import clashing, low, table_at
from tidelog.llm import op02_urls as op

PAGES = "page_id long, url string, html string"
URLS = [None, "", "no scheme", "http://", "http:///x", "https://Example.ORG/es/a", "https://a.example.org/es", "https://example.org/en/12?x=/es/", "https://example.org/en/2", "https://notexample.org/es/", "ftp://x.y.com/fr/b#c", "http://com/de/", "http://com?/de/", "http://shop.com/de/index", "http://a.com/FR/", "HTTP://A.B.C.org", "http://org/", "x://y://example.org/es/", "http://example.org./es/", "http://..com/fr/", "http://é.org/ü", "http://a.org/" + "p" * 5000, "http://example.org/es/\nnew"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, path = low(rest[:cut]), rest[cut:]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_odd_urls(spark, tmp_path):
    rows = [(i if i % 5 else None, u, None) for i, u in enumerate([*URLS, *URLS[5:8]])]
    d = table_at(spark, tmp_path, pages=clashing(spark.createDataFrame(rows, PAGES)))
    got = op.op2_urls(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(u))) for i, u, _ in rows)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_empty(spark, tmp_path):
    assert op.op2_urls(spark, table_at(spark, tmp_path, pages=spark.createDataFrame([], PAGES))).count() == 0


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    keys = [f"k{rng.randrange(10**9)}" for _ in range(3000)]
    listed = keys[:900]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    c = op.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe, 3000, 7)
    assert len(c.levels) > 1
    got = {r.key for r in universe.filter(c.has(F.col("key"))).collect()}
    assert got == set(listed)
    # memory: far below a set of the listed keys, and the universe does not count
    assert sum(len(x.words) for x in c.levels) * 64 < 20 * len(listed)


def test_bounds(spark):
    u = spark.createDataFrame([(str(i),) for i in range(500)], "key string")
    with pytest.raises(ValueError):
        op.build_cascade(u, u, 500, 1, max_words=2)
    with pytest.raises(ValueError):
        op.judge_urls(spark.createDataFrame([], PAGES), [("org", "x", "allow")], ["page_id"])


def test_without_rules(spark):
    out = op.judge_urls(spark.createDataFrame([(1, "http://a.org/", None)], PAGES), [], ["page_id"]).collect()
    assert [(r.rule, r.verdict) for r in out] == [(None, "allow")]
