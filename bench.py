"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidelog import queries as core

HEAD = ["latest_wins", "scan_resolve_filter", "level_merge", "compact_preserves_view", "range_half_open", "scan_filter_gt", "not_in", "in_string", "upsert_batch", "cas_batch", "count", "short_uuid"]


def stored(spark: SparkSession, d: str, took: dict, rates: dict) -> None:
    """A table on disk: four batches of all orders, a flush, a scan after it is opened again, a compaction, a scan."""
    orders, noop = core.batches(spark, d)[0], lambda df: df.write.format("noop").mode("overwrite").save()
    n = orders.count()
    t = core.opened(spark, d, "FAST", compact_on_flush=False)

    def timed(name: str, rows: int, f) -> None:
        at = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - at, 4)
        rates[name] = round(rows / took[name])

    timed("store_ingest", 4 * n, lambda: [t.put_all(orders) for _ in range(4)])
    timed("store_flush", 4 * n, t.flush)
    timed("store_reopen_scan", 4 * n, lambda: noop(core.again(t).live()))
    timed("store_compaction", 4 * n, t.compact)
    timed("store_compacted_scan", n, lambda: noop(core.again(t).live()))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEAD:
        f = core.QUERIES[name]
        f(spark, d).write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        f(spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 4)
    rows = spark.read.parquet(f"{d}/events.parquet").count()
    rates = {"scan_resolve_filter": round(rows / took["scan_resolve_filter"])}
    stored(spark, d, {}, {})
    stored(spark, d, took, rates)
    print(json.dumps({"metric": "total seconds of the headline queries, second run", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1], "rows_per_sec": rates}))


if __name__ == "__main__":
    main()
