"""What operators leave on disk: nothing that no later step reads."""

import os
import random
import time

from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, prose
from tidelog.llm import common
from tidelog.llm import op01_suffixes as op1
from tidelog.llm import op07_simhash as op7


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def on_disk(spark):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(common.shared_dir(spark).removeprefix("file:")))


def texts(spark):
    rng = random.Random(3)
    passage = prose(rng, 120, 5000)
    rows = [(i, f"{prose(rng, 60, 5000)} {passage if i % 3 else ''} {prose(rng, 60, 5000)}", "en", "web", 0) for i in range(40)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def test_shuffle_files_go_with_the_write(spark):
    before, asked = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    out = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # Spark removes them on its own thread
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP, None) == asked
    assert sorted(map(tuple, out.collect())) == sorted((k, len(range(k, 1000, 7))) for k in range(7))


def test_repeats_hold_one_step(spark, monkeypatch):
    """A step's tables go once the next one is written."""
    seen, started = {}, on_disk(spark)

    def noted(df, what, *more):
        out = common.stored(df, what, *more)
        here = on_disk(spark)
        for x in started:
            here.remove(x)
        seen[what] = here
        return out

    monkeypatch.setattr(op1, "stored", noted)
    spans = op1.repeated(texts(spark), 200, 64)
    assert spans.count() > 0
    assert "anchors" not in seen["spans"] and not {"anchors", "matched", "spans"} & set(seen["repeats"])
    here = on_disk(spark)
    for x in started:
        here.remove(x)
    assert here == ["repeats"]


def test_near_leaves_its_result(spark):
    started = on_disk(spark)
    out = op7.filter_near(texts(spark))
    assert out.count() == 40
    assert on_disk(spark).count("near") == started.count("near")
