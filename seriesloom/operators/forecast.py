"""Scoring-side relational work: grids of requests, model lookup, back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import dates


def request_grid(df: DataFrame, models: list[str], horizons: list[int]) -> DataFrame:
    """Every row once per model and horizon (a literal list exploded in place)."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.lit(h).alias("horizon_days"))
        for m in dict.fromkeys(models) for h in sorted(set(horizons))
    ])
    return df.withColumn("_cell", F.explode(cells)).select(*df.columns, "_cell.*")


def resolve_models(
    requests: DataFrame, registry: DataFrame, many_horizons: bool | Column
) -> DataFrame:
    """Best registered name per (model_name, horizon_days).

    Horizon-specific names come first. A generic model only serves a request for
    a single horizon.
    """
    m, h = F.col("model_name"), F.col("horizon_days").cast("string")
    candidates = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(m, F.lit("__h"), h).alias("name")),
        F.struct(F.lit(1).alias("rank"), F.concat(m, F.lit("_h"), h).alias("name")),
        F.struct(F.lit(2).alias("rank"), m.alias("name")),
    )
    many = F.lit(many_horizons) if isinstance(many_horizons, bool) else many_horizons
    wanted = (
        requests.select("model_name", "horizon_days", F.explode(candidates).alias("_c"))
        .select("model_name", "horizon_days", "_c.rank", "_c.name")
        .filter((F.col("rank") < 2) | ~many)
    )
    hits = wanted.join(registry.select("name").distinct(), "name")
    return hits.groupBy("model_name", "horizon_days").agg(
        F.min_by("name", "rank").alias("resolved"), (F.min("rank") < 2).alias("is_specific")
    )


def known_requests(requests: DataFrame, latest: DataFrame, asset: str = "asset_id") -> DataFrame:
    return requests.join(latest, asset)


def unknown_requests(requests: DataFrame, latest: DataFrame, asset: str = "asset_id") -> DataFrame:
    return requests.join(latest.select(asset), asset, "left_anti")


def label_forecasts(
    scored: DataFrame, asset: str = "asset_id", day: str = "d", price: str = "price"
) -> DataFrame:
    """The fixed forecast schema out of scored rows."""
    return scored.select(
        "model_name",
        F.col(asset).alias("asset_id"),
        F.col("horizon_days").cast("int").alias("horizon_days"),
        F.col(day).alias("feature_date"),
        dates.horizon_date(F.col(day), F.col("horizon_days")).alias("prediction_date"),
        "prediction",
        F.col(price).alias("current_price"),
    )


def backtest(
    forecasts: DataFrame, prices: DataFrame, asset: str = "asset_id", day: str = "d", price: str = "price"
) -> DataFrame:
    """Forecasts with the price later seen on their date, when there is one."""
    actual = prices.select(
        F.col(asset).alias("asset_id"), F.col(day).alias("prediction_date"), F.col(price).alias("actual")
    )
    return forecasts.join(actual, ["asset_id", "prediction_date"], "left")
