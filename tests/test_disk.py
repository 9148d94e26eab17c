"""What a large feature build leaves on disk: shuffle files, sorts after the gap rows."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from catalog import registry
from seriesloom.operators import cleaning, grid
from seriesloom.operators import features as ft
from seriesloom.plans import features_plan
from seriesloom.session import DROP_SHUFFLE, SMALL_TASKS, small_tasks

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def raw_rows(spark):
    rows = [
        (a, DAY + dt.timedelta(days=d) if d is not None else None, float(10 * i + (t or 0)), t, "xyz"[((t or 0) + i) % 3])
        for i, a in enumerate([None, *range(20)])
        for d in [None, *range(i % 5)]
        for t in (3, 1, None, 2)
    ]
    return spark.createDataFrame(rows + rows[::7], "asset_id long, ts date, price double, tie int, mark string")


@pytest.mark.parametrize("passes", [1, 3, 50])
def test_passes_keep_the_rows_of_one_pass(spark, passes):
    df = raw_rows(spark)
    whole = cleaning.first_per_timestamp(df, ["tie", "mark", "price"], keep=["price"])
    parts = cleaning.first_in_passes(df, ["tie", "mark", "price"], passes, keep=["price"])
    assert parts.schema.simpleString() == whole.schema.simpleString()
    key = lambda r: [(x is not None, x) if x is not None else (False, 0) for x in map(str, r)]
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key)


def test_no_pass_is_refused(spark):
    with pytest.raises(ValueError, match="passes"):
        cleaning.first_in_passes(raw_rows(spark), ["tie"], 0)


def test_passes_delete_their_shuffle_files(spark):
    before, setting = shuffles(spark), spark.conf.get(DROP_SHUFFLE)
    import __spark_entry__ as entry

    text = plan(entry.queries()["feature_table_suppliers"](spark, SF))
    for _ in range(50):  # executors delete in the background
        if shuffles(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffles(spark) <= before
    assert spark.conf.get(DROP_SHUFFLE) == setting
    # Raw rows with their nine order columns are on no shuffle of the table's own plan.
    assert "l_linenumber" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_gap_rows_are_sorted_once_and_without_texts(spark):
    text = plan(features_plan.prepare(registry.b(spark, SF), registry.B_ORDER).features)
    above = text[:text.index("Generate explode")]
    assert len(re.findall(r"Sort \[", above)) == 1
    assert "brand" not in above[above.index("Sort ["):]


def test_shared_sort_needs_the_grid_of_one_block(spark):
    rows = [(a, DAY + dt.timedelta(days=d), float((d * 7 + a) % 13 + 1)) for a in (1, 2) for d in range(900)]
    df = spark.createDataFrame(rows, "asset_id long, d date, price double")
    shared = ft.add_features(df).orderBy("asset_id", "d").collect()
    lags = ft.add_lags(df).orderBy("asset_id", "d").collect()
    ema = ft.add_ema(df).orderBy("asset_id", "d").collect()
    assert "_block" not in ft.add_features(df).columns + ft.add_ema(df).columns
    assert [r["price_lag_30"] for r in shared] == [r["price_lag_30"] for r in lags]
    assert [r["ema_20"] for r in shared] == [r["ema_20"] for r in ema]


def sparse_rows(spark):
    rows = [(a, DAY + dt.timedelta(days=100 * i), float(a + i + 1), i) for a in range(40) for i in range(30)]
    return spark.createDataFrame(rows, "asset_id long, ts date, price double, tie int")


def test_tasks_hold_a_bounded_part_of_the_grid(spark, monkeypatch):
    # 1200 rows read become 116 040 of the grid.
    monkeypatch.setattr(grid, "ROWS_A_TASK", 10_000)
    made = features_plan.daily_prices(sparse_rows(spark), ["tie"], passes=2)
    sizes = [r["count"] for r in made.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()]
    assert sum(sizes) == 40 * 2901 and max(sizes) <= 40_000
    whole = features_plan.daily_prices(sparse_rows(spark), ["tie"])
    assert sorted(made.collect()) == sorted(whole.collect())


def test_tasks_follow_the_grid_to_come(spark):
    df, least = sparse_rows(spark), spark.sparkContext.defaultParallelism
    assert grid.tasks_for(df, rows_a_task=5_802) == max(20, least)
    assert grid.tasks_for(df, "W", rows_a_task=829) == max(21, least)  # 415 weeks an asset
    assert grid.tasks_for(df, rows_a_task=1) == 40  # no more than assets
    assert grid.tasks_for(df, min_rows=31) == 1
    one = spark.createDataFrame([(None, None), (1, None), (2, DAY)], "asset_id long, ts date")
    assert grid.tasks_for(one, rows_a_task=1) == 3


def test_small_tasks_leave_smaller_settings(spark):
    files, merged = SMALL_TASKS
    before = spark.conf.get(files), spark.conf.get(merged)
    spark.conf.set(files, "1m")
    try:
        with small_tasks(spark):
            assert (spark.conf.get(files), spark.conf.get(merged)) == ("1048576b", f"{SMALL_TASKS[merged]}b")
        assert (spark.conf.get(files), spark.conf.get(merged)) == ("1m", before[1])
    finally:
        spark.conf.set(files, before[0])
