"""Cleaning, quantiles, splits, validation and upsert on small hand-written rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.config import PrepConfig, SplitConfig
from seriesloom.functions import labels, names, payloads
from seriesloom.operators import features as ft
from seriesloom.operators import cleaning, isolation, quantiles, splits, summaries, upsert, validation
from seriesloom.plans import features_plan

DAY = dt.date(2024, 1, 1)


def days(spark, values, asset="a"):
    rows = [(asset, DAY + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset_id string, ts date, price double")


def prices(df):
    return [r["price"] for r in df.orderBy("ts").collect()]


def test_quantiles_match_numpy_with_ties_and_signs(spark):
    rng = np.random.default_rng(1)
    groups = {
        "heavy": np.concatenate([np.full(5000, 3.25), rng.normal(0, 1e-6, 500)]),
        "wide": rng.lognormal(0, 8, 3000) * rng.choice([-1, 1], 3000),
        "one": np.array([42.0]), "two": np.array([-1.0, 4.0]), "flat": np.full(9, 0.0),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    for r in quantiles.exact_quantiles(df, ["g"], "v", qs).collect():
        np.testing.assert_allclose(r["q"], np.quantile(groups[r["g"]], qs), rtol=1e-12, atol=1e-15)


def test_iqr_bounds_are_inclusive(spark):
    assert prices(cleaning.outliers_iqr(days(spark, [1, 2, 3, 4, 100]), 1.0)) == [1.0, 2.0, 3.0, 4.0]


def test_zscore_drops_a_flat_asset(spark):
    assert prices(cleaning.outliers_zscore(days(spark, [5, 5, 5]), 3.0)) == []


def test_nan_prices_are_missing(spark):
    df = cleaning.nan_to_null(days(spark, [1, float("nan"), -2, 0, 3]), "price")
    assert prices(cleaning.positive_price(df)) == [1.0, 3.0]


@pytest.mark.parametrize("method,want", [
    ("linear", [1.0, 2.0, 3.0, 5.0, 5.0, 5.0]),
    ("forward", [1.0, 1.0, 1.0, 5.0, 5.0, 5.0]),
    ("backfill", [1.0, 1.0, 5.0, 5.0, 5.0]),
])
def test_limited_fill(spark, method, want):
    values = [None, 1, None, None, None, 5, None, None, None]
    assert prices(cleaning.fill_limited(days(spark, values), method, 2)) == want


@pytest.mark.parametrize("method", ["linear", "forward", "backfill"])
def test_limited_fill_across_blocks(spark, method):
    """Blocks of any length give what one block gives, gaps over several blocks and rows without a time included."""
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (a, start + dt.timedelta(hours=7 * i), float(rng.integers(1, 90)) if rng.random() < 0.25 else None)
        for a in ("a", "b", None) for i in range(120)
    ] + [("a", None, 5.0), ("c", start, None), ("d", start, 1.0)]
    df = spark.createDataFrame(rows, "asset_id STRING, ts TIMESTAMP, price DOUBLE")

    def filled(days):
        got = cleaning.fill_limited(df, method, 9, block_days=days).collect()
        return sorted(((r["asset_id"] or "", str(r["ts"]), round(r["price"], 9)) for r in got))

    assert filled(1) == filled(3) == filled(10_000) and len(filled(1)) > 200


def test_limited_fill_like_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.5 else float(v) for v in rng.normal(50, 9, 300)]
    s = pd.Series(values, dtype=float)
    for method, want in (
        ("linear", s.interpolate("linear", limit=2)), ("forward", s.ffill(limit=2)), ("backfill", s.bfill(limit=2)),
    ):
        np.testing.assert_allclose(prices(cleaning.fill_limited(days(spark, values), method, 2)), want.dropna(), rtol=1e-12)


def test_missing_share_is_checked_before_prices_are_dropped(spark):
    df = days(spark, [1, None, 3, 4]).unionByName(days(spark, [1, 2, 3, 4], "b"))
    kept = cleaning.max_missing_share(df, 20.0).select("asset_id").distinct().collect()
    assert [r[0] for r in kept] == ["b"]


def test_isolation_forest_drops_the_far_points(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(100, 1, 900), rng.uniform(300, 900, 50)])
    df = days(spark, values).unionByName(days(spark, [7.0], "single"))
    kept = isolation.outliers_isolation_forest(df)
    a = [r["price"] for r in kept.filter("asset_id = 'a'").collect()]
    assert 0.85 * len(values) <= len(a) <= 0.93 * len(values)
    assert sum(v > 299 for v in a) <= 2
    assert kept.filter("asset_id = 'single'").count() == 1


def test_isolation_scores_every_row_once(spark):
    df = days(spark, np.random.default_rng(4).lognormal(3, 2, 2000))
    assert isolation.isolation_scores(df).count() == 2000


def test_dedupe_keeps_the_first_and_drops_its_bad_price_with_it(spark):
    rows = [("a", DAY, 1, 5.0), ("a", DAY, 2, 6.0), ("a", DAY + dt.timedelta(days=1), 3, -1.0),
            ("a", DAY + dt.timedelta(days=1), 4, 8.0), ("a", DAY + dt.timedelta(days=2), 5, 9.0)]
    df = spark.createDataFrame(rows, "asset_id string, ts date, tie int, price double")
    out = features_plan.daily_prices(df, ["tie"], PrepConfig(min_points=1)).orderBy("d").collect()
    assert [r["price"] for r in out] == [5.0, 7.0, 9.0]


@pytest.mark.parametrize("cfg", [
    PrepConfig(min_points=3), PrepConfig(min_points=3, remove_outliers=True, outlier_method="iqr"),
    PrepConfig(min_points=3, remove_outliers=True, outlier_method="zscore"), PrepConfig(min_points=1, frequency="W"),
])
def test_daily_prices_variants(spark, cfg):
    df = days(spark, [10, 11, None, 12, 13, 11, 12, 10]).withColumn("tie", F.lit(1))
    df = df.unionByName(days(spark, [1, 2], "short").withColumn("tie", F.lit(1)))
    out = features_plan.daily_prices(df, ["tie"], cfg)
    assets = {r[0] for r in out.select("asset_id").distinct().collect()}
    assert assets == ({"a"} if cfg.min_points == 3 else {"a", "short"})


def test_split_shares_and_small_assets(spark):
    df = days(spark, range(1, 101)).unionByName(days(spark, range(1, 20), "small"))
    got = splits.temporal_split(df, SplitConfig(), ts="ts").groupBy("asset_id", "split").count().collect()
    n = 100
    test_at, val_at = int(n * (1 - 0.2)), int(n * (1 - 0.2 - 0.1))
    assert {(r[0], r[1]): r[2] for r in got} == {
        ("a", "train"): val_at, ("a", "val"): test_at - val_at, ("a", "test"): n - test_at}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = {r[0] for r in splits.seeded_sample(df.repartition(2), 50, ["id"]).collect()}
    assert len(a) == 50 and a == {r[0] for r in splits.seeded_sample(df.repartition(7), 50, ["id"]).collect()}
    assert a != {r[0] for r in splits.seeded_sample(df, 50, ["id"], seed=1).collect()}
    assert splits.seeded_sample(df, 5000, ["id"]).count() == 1000 and splits.seeded_sample(df, 0, ["id"]).count() == 0


def test_horizon_splits_equal_one_by_one(spark):
    df = days(spark, range(1, 101)).unionByName(days(spark, range(1, 20), "small"))
    g = ft.Grid(day="ts")
    every = splits.horizon_splits(df, (1, 3), SplitConfig(), g)
    for h in (1, 3):
        rows = ft.horizon_dataset(df, h, g)
        want = splits.temporal_split(rows, SplitConfig(), ts="ts", require=ft.target_name(h))
        got = every.filter(F.col(splits.split_name(h)).isNotNull())
        key = lambda d, c: sorted((r["asset_id"], str(r["ts"]), r[c], r[ft.target_name(h)]) for r in d.collect())
        assert key(got, splits.split_name(h)) == key(want, "split")


def test_quantiles_with_nan_and_infinities(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, nan, None, inf)] + [("b", -inf), ("b", 5.0), ("b", 6.0), ("c", nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "v", [0.0, 1 / 3, 1.0]).collect()}
    assert got["a"] == [1.0, 2.0, inf] and got["b"][0] == -inf and got["b"][2] == 6.0 and "c" not in got


def test_order_check_across_blocks(spark):
    rows = [("good", i, i) for i in range(20)] + [("seam", i, 100 - i if i >= 10 else i) for i in (0, 9, 10, 19)]
    rows += [("one", 0, None), ("hole", 0, 1), ("hole", 5, None), ("equal", 0, 3), ("equal", 11, 3)]
    df = spark.createDataFrame(rows, "a string, i long, t long")
    got = {r["a"]: r["ordered"] for r in validation.order_check(df, "a", "t", "i", block=10).collect()}
    assert got == {"good": True, "seam": False, "one": True, "hole": False, "equal": True}


def test_seam_between_blocks_is_compared(spark):
    df = spark.createDataFrame([("x", 9, 50), ("x", 10, 40)], "a string, i long, t long")
    assert validation.order_check(df, "a", "t", "i", block=10).first()["steps_back"] == 1


def test_verdict_texts(spark):
    df = spark.createDataFrame([("a", 5, True), ("b", 5, False), ("c", 200, False), ("d", 200, True), ("e", 0, True)],
                               "a string, row_count long, ordered boolean")
    got = {r["a"]: (r["is_valid"], r["error_message"]) for r in validation.verdicts(df, 100).collect()}
    assert got == {
        "a": (False, "Insufficient rows: 5 < 100"), "b": (False, "Insufficient rows: 5 < 100; Date ordering issue"),
        "c": (False, "Date ordering issue"), "d": (True, None), "e": (False, "Empty or header-only file")}


def test_upsert_new_batch_wins_and_first_load_is_untouched(spark):
    old, new = days(spark, [1, 2]), days(spark, [None, 9, 3])
    merged = upsert.upsert(old, new)
    assert prices(merged) == [None, 9.0, 3.0]
    twice = new.unionByName(new)
    assert upsert.upsert(None, twice).count() == 6


def test_label_codes_cover_several_partitions(spark):
    values = [f"v{i:04d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "name string").repartition(6)
    got = {r["name"]: r["code"] for r in summaries.encode_labels(df, "name", "code").collect()}
    assert got.pop(None) == -1 and got == {v: i for i, v in enumerate(values)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_title_case(spark):
    assert one(spark, names.title_case(F.lit("nautilus 5167a o'neil x-ray"))) == "nautilus 5167a o'neil x-ray".title()


@pytest.mark.parametrize("text,want", [
    ("", "unnamed"), ("a<b>:c", "a_b__c"), ("  x \t y ", "x_y"), ("..._", "unnamed"), ("a" * 300, "a" * 200),
])
def test_safe_file_name(spark, text, want):
    assert one(spark, names.safe_file_name(F.lit(text))) == want


def test_safe_file_name_of_missing_text(spark):
    assert one(spark, names.safe_file_name(F.lit(None).cast("string"))) == "unnamed"


def test_asset_label(spark):
    label = names.asset_label(F.lit("Philippe_Nautilus_Steel_5711"), F.lit("Patek Philippe"))
    assert one(spark, label) == "Patek Philippe Nautilus Steel (5711)"
    assert one(spark, names.asset_label(F.lit("5711"), F.lit(None).cast("string"))) == "5711"
    assert one(spark, names.asset_label(F.lit("__"), F.lit("X"))) == "__"


def test_keywords_match_blank_and_underscore_forms(spark):
    for text in ("Royal Oak 15202", "royal_oak_15202"):
        assert one(spark, labels.keyword_flags(F.lit(text))["is_dress_watch"]) == 1
    assert one(spark, labels.premium_flags(F.lit("Patek Philippe"))["brand_tier_premium"]) == 1
    assert one(spark, labels.premium_flags(F.lit("Seiko"))["brand_tier_non_premium"]) == 1


@pytest.mark.parametrize("value,want", [
    (-1.0, "unknown"), (0.0, "entry"), (4999.99, "entry"), (5000.0, "mid"), (20000.0, "high"), (100000.0, "ultra"), (None, "unknown"),
])
def test_tier_edges(spark, value, want):
    assert one(spark, labels.tier(F.lit(value).cast("double"))) == want


@pytest.mark.parametrize("text,want", [
    ("5", 5.0), ('"5.5"', 5.5), ('"x"', None), ('{"avg": 2, "value": 3}', 3.0), ('{"price": "7", "median": 1}', 1.0),
    ('{"q": [1], "z": 4}', 4.0), ('[null, "a", 6]', 6.0), ("[]", None), ("null", None), ("{}", None),
])
def test_variant_number(spark, text, want):
    assert one(spark, payloads.variant_number(F.parse_json(F.lit(text)))) == want


def test_price_column_choice():
    assert payloads.price_column(["date", "y", "value"]) == "value"
    with pytest.raises(ValueError):
        payloads.price_column(["date"])


def test_metric_text(spark):
    m, v = F.lit("mape"), F.lit(1.234)
    assert one(spark, labels.metric_text(m, v)) == "1.23%"
    assert one(spark, labels.metric_text(F.lit("rmse"), v)) == "1.2340"
    assert one(spark, labels.metric_text(F.lit("rmse"), F.lit(float("inf")))) == "N/A"
