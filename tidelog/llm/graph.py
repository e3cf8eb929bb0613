"""Connected components of an edge table by alternating stars; nothing is collected.

Every round joins each node's edges to the least neighbour it has, first for larger neighbours, then for
smaller ones; components shrink to stars around their least node in a few rounds. Each round is stored in
the shared folder, so that lost executors cost one round at most. So are the least neighbours: a join of two
plain tables is one that Spark splits by itself where a node has very many edges. A round has as many tasks as its
edges need, a task for each EDGES of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import forget, stored

MAX_ROUNDS, EDGES, LEAST_TASKS = 60, 100_000, 12


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). One row (node, root) for each node but the roots; a root is its component's least."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        tasks = max(LEAST_TASKS, -(-seen[0] // EDGES))
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        # large star: larger neighbours go to the least one
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(tasks), "large")
        # small star: smaller neighbours and the node itself go to the least one
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        before, e = e, stored(small.coalesce(tasks), "edges")
        forget(before, least, large, low)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
