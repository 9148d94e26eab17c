"""Tables behind the price and forecast views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import dates, labels
from seriesloom.functions.names import asset_label
from seriesloom.operators import splits

HISTORY_ROWS = 180


def chart_table(
    prices: DataFrame, forecasts: DataFrame, asset: str = "asset_id", day: str = "d", price: str = "price",
    n: int = HISTORY_ROWS,
) -> DataFrame:
    """History, current point and D1.. forecasts of each asset as one long table."""
    history = splits.last_rows(prices.select(asset, day, price), n, asset, day).select(
        F.col(asset).alias("asset_id"), F.col(day).alias("date"), F.col(price).alias("price"),
        F.lit("History").alias("horizon"),
    )
    current = forecasts.groupBy("asset_id").agg(
        F.max_by("current_price", "feature_date").alias("price"), F.max("feature_date").alias("date")
    ).select("asset_id", "date", "price", F.lit("Current").alias("horizon"))
    ahead = forecasts.filter(F.col("prediction").isNotNull()).select(
        "asset_id", F.col("prediction_date").alias("date"), F.col("prediction").alias("price"),
        F.concat(F.lit("D"), F.col("horizon_days").cast("string")).alias("horizon"),
    )
    return history.unionByName(current).unionByName(ahead)


def change_table(forecasts: DataFrame) -> DataFrame:
    """Forecast rows with absolute and percent change, as numbers and as text."""
    diff, pct = labels.delta(F.col("prediction"), F.col("current_price"))
    return forecasts.withColumns({"delta": diff, "delta_pct": pct}).withColumns({
        "price_text": labels.currency(F.col("prediction")),
        "change_text": labels.signed_currency(F.col("delta")),
        "change_pct_text": labels.signed_percent(F.col("delta_pct")),
    })


def display_table(forecasts: DataFrame, brands: DataFrame) -> DataFrame:
    """Readable forecast table: labelled assets, ISO dates, prices last."""
    named = forecasts.join(brands.select("asset_id", "brand"), "asset_id", "left")
    text = {c: F.coalesce(dates.iso_date(F.col(c)), F.lit("")) for c in ("feature_date", "prediction_date")}
    return (
        named.withColumns({"asset": asset_label(F.col("asset_id").cast("string"), F.col("brand")), **text})
        .withColumnRenamed("prediction", "prediction_price")
        .select("asset", "horizon_days", "feature_date", "prediction_date", "current_price", "prediction_price")
    )
