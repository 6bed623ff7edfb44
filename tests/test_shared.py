"""Tables in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from graphloom.sources.shared import SWEEP, written


def test_a_written_table_leaves_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    set_before = spark.conf.get(SWEEP, None)
    table, path = written(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    assert tracker.shuffleStatuses().size() <= before
    assert table.count() == 7 and spark.conf.get(SWEEP, None) == set_before
    assert list(Path(path.removeprefix("file://")).glob("*.parquet"))
