"""Shapes of physical plans: shuffles, pushdown, join choice."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import registry
from seriesloom.config import PrepConfig
from seriesloom.operators import cleaning, grid, splits, upsert
from seriesloom.operators import features as ft
from seriesloom.plans import features_plan

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_features_move_raw_rows_once_and_daily_rows_once(spark):
    raw = registry.b(spark, SF)
    keys = exchanges(features_plan.prepare(raw, registry.B_ORDER).features)
    assert len(keys) == 2
    assert sorted(k.count("asset_id") + k.count("ts") for k in keys) == [1, 2]


def test_summary_skips_the_feature_windows(spark):
    summary = features_plan.prepare(registry.b(spark, SF), registry.B_ORDER).summary
    text = plan(summary)
    assert "_lag_30" not in text and "_ret_0" not in text


def test_dedupe_reduces_before_the_shuffle(spark):
    text = plan(registry.observed(spark, SF))
    assert "partial_min_by" in text


def test_scan_reads_only_needed_columns(spark):
    df = registry.table(spark, SF, "lineitem").filter("l_extendedprice > 100000").groupBy("l_suppkey").count()
    text = plan(df)
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in text
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,100000.0)]" in text


def test_rank_limit_is_pushed_below_the_shuffle(spark):
    df = splits.last_rows(registry.p(spark, SF), 180, ts="ts")
    assert plan(df).count("WindowGroupLimit") >= 1


def test_latest_row_has_no_window(spark):
    assert "Window" not in plan(splits.latest_row(registry.p(spark, SF), tie=["tie"]))


def test_first_and_last_are_never_sorted(spark):
    p = registry.p(spark, SF).withColumn("day", F.col("ts"))
    halves = [p.filter("tie % 2 = 0"), p.filter("tie % 2 = 1")]
    frames = {
        "first": cleaning.first_per_timestamp(p, ["day", "tie"]),
        "latest": splits.latest_row(p, tie=["tie"]),
        "upsert": upsert.upsert(*halves, ["tie"]),
        "resample": grid.resample_last(p, "W", ["tie"]),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "partial_m" in text and "SortAggregate" not in text and "Sort [" not in text, name
        assert "ObjectHashAggregate" not in text, name


def test_no_cross_joins_or_python(spark):
    import __spark_entry__ as entry

    skip = {"flt4_outliers_isolation_forest"}
    cheap = [n for n in entry.oracle_sql() if n.startswith(("win", "jon", "flt", "agg", "set", "str", "mth", "dat")) and n not in skip]
    for name in cheap:
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


@pytest.mark.parametrize("frequency", ["D", "W"])
def test_ema_adds_no_shuffle(spark, frequency):
    base = features_plan.daily_prices(registry.b(spark, SF), registry.B_ORDER, PrepConfig(frequency=frequency, min_points=2))
    assert len(exchanges(ft.add_ema(base))) == len(exchanges(base))
