"""batch_delete on keys beyond those of the small tables."""

from tidelog import queries as core


def test_large_keys(spark, tmp_path):
    ids = [7, 8, 99_998, 100_000, 100_001, 2**33, 2**33 + 1]
    rows = [(i, k, "click", 1.0) for i, k in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.user_id for r in core.QUERIES["batch_delete"](spark, str(tmp_path)).collect()) == [7, 100_001, 2**33 + 1]
