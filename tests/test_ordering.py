"""The ordering core: one form for any size, type, direction, ties and nulls."""

import os
import re

import pytest
from pyspark.sql import Window, functions as F

from __spark_entry__ import queries
from cairn.operators import relational as rel, selection, series, signal
from cairn.plans.ordered import sequence
from cairn.plans.skew import split_join

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    names = [None, "a", "b", "c"]
    data = [(names[i % 4], f"s{i * 7919 % 1000:04d}" if i % 11 else None, i % 3, i) for i in range(900)]
    return spark.createDataFrame(data, "k string, s string, q int, id long")


@pytest.mark.parametrize("bound", ["40", "2000000"])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("order", [["s", "id"], [("s", "desc"), "id"], ["q", ("id", "desc")], [("q", "desc"), ("s", "desc"), "id"]])
def test_sequence_is_row_number(spark, rows, bound, keys, order):
    spark.conf.set("spark.cairn.taskRows", bound)
    try:
        got = {r.id: r.seq for r in sequence(rows, keys, order).collect()}
    finally:
        spark.conf.unset("spark.cairn.taskRows")
    ways = [F.asc(o) if isinstance(o, str) else F.desc(o[0]) for o in order]
    want = {r.id: r.n for r in rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ways))).collect()}
    assert got == want


@pytest.mark.parametrize("key, scans, exchanges", [("evt04_session_durations", 2, 6), ("evt14_npath", 4, 10), ("ts08_acf", 4, 7), ("ts24_change_point", 4, 10), ("fp09_train_test_split", 4, 4)])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_plans_stay_small(spark, key, scans, exchanges):
    """Ordered rows are written once: what is read again is that table, and never the source through further exchanges."""
    plan = queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= scans and len(re.findall(r"(?<!Broadcast)Exchange (hash|range|Single)", plan)) <= exchanges


def test_split_join_runs_no_job(spark, rows):
    spark.sparkContext.setJobGroup("cairn-build", "building")
    try:
        split_join(rows, rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("cairn-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_rows(spark, rows):
    assert sequence(rows.filter("false"), ["k"], ["s", "id"]).count() == 0
    assert rel.ntile(rows.filter("false"), [], ["id"], 4).count() == 0


@pytest.mark.parametrize("n", [10, 30, 170, 1000])
def test_exact_sizes_of_splits(spark, n):
    df = spark.range(1, n + 1).select(F.lit("x").alias("series_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    size = lambda d, c: {r[c]: r["count"] for r in d.groupBy(c).count().collect()}
    assert size(selection.time_split(df), "role") == {"train": n * 6 // 10, "validation": n * 8 // 10 - n * 6 // 10, "test": n - n * 8 // 10}
    got = size(series.lag_features(df), "split")
    assert got == {"train": n * 70 // 100, "validation": n * 85 // 100 - n * 70 // 100, "test": n - n * 85 // 100}


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([("x", 1, 1.0)], "series_id string, seq long, value double")
    for call in (lambda: signal.butterworth(df, 0.1, kind="notch"), lambda: signal.butterworth(df, 0.1, order=3), lambda: signal.spectral_density(df, kind="flat"),
                 lambda: signal.spectral_density(df, detrend="cubic")):
        with pytest.raises(ValueError):
            call()
