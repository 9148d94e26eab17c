"""Calendar grids: resampling, densifying and gap filling.

``resample_last`` turns observations into at most one row per asset and
calendar bucket. From there on an asset holds at most one row per day of its
own date range, which is what bounds every per-asset window in this package.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.dates import bucket_day
from seriesloom.operators.ordering import picked_rows

STEP_DAYS = {"D": 1, "W": 7}
ROWS_A_TASK = 500_000  # of a grid; a task's sorts and windows then hold some 90 MB


def resample_last(
    df: DataFrame, frequency: str = "D", order: list[str] | None = None,
    asset: str = "asset_id", ts: str = "ts", price: str = "price", day: str = "d",
) -> DataFrame:
    """Last known price per asset and bucket."""
    known = df.filter(F.col(price).isNotNull())
    bucketed = known.withColumn(day, bucket_day(F.col(ts), frequency))
    return picked_rows(bucketed, [asset, day], [price], [ts, *(order or [])])


def tasks_for(
    df: DataFrame, frequency: str = "D", min_rows: int = 0, asset: str = "asset_id", ts: str = "ts",
    rows_a_task: int | None = None,
) -> int:
    """Into how many partitions to deal the assets of ``df`` for tasks of bounded grids.

    The planner sizes partitions by the bytes of a shuffle, but grid rows come into being after
    it, several for each row read. Assets with fewer than ``min_rows`` rows do not count.
    Reads ``df`` when called.
    """
    span = F.floor(F.coalesce(F.datediff(F.max(ts), F.min(ts)), F.lit(0)) / STEP_DAYS[frequency]) + 1
    spans = df.groupBy(asset).agg(span.alias("_size"), F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    rows, assets = spans.agg(F.sum("_size"), F.count("*")).first()
    wanted = math.ceil((rows or 0) / (rows_a_task or ROWS_A_TASK))
    return max(1, min(assets, max(wanted, df.sparkSession.sparkContext.defaultParallelism)))


def densify(
    df: DataFrame, frequency: str = "D", method: str = "linear",
    asset: str = "asset_id", day: str = "d", price: str = "price", min_rows: int = 0,
) -> DataFrame:
    """Regular grid from each asset's first to last bucket, gaps filled.

    Each observation knows the next one, so it can emit its own gap rows: no
    calendar table and no join. Column ``seq`` is the row's position in its asset.
    Assets whose grid would have fewer than ``min_rows`` rows are left out.
    """
    step = STEP_DAYS[frequency]
    w = Window.partitionBy(asset).orderBy(day)
    spaced = df.select(
        asset, day, price,
        F.lead(price).over(w).alias("_next"),
        F.coalesce(F.datediff(F.lead(day).over(w), day) / step, F.lit(1)).cast("int").alias("_gap"),
        (F.datediff(day, F.min(day).over(w.rowsBetween(Window.unboundedPreceding, 0))) / step)
        .cast("int").alias("_at"),
    )
    if min_rows > 0:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        spaced = spaced.withColumn("_size", F.sum("_gap").over(whole)).filter(F.col("_size") >= min_rows)
    rows = spaced.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
    k, p, nxt = F.col("_k"), F.col(price), F.col("_next")
    if method == "linear":
        value = F.when(k == 0, p).otherwise(p + (nxt - p) * k / F.col("_gap"))
    elif method == "forward":
        value = p
    elif method == "backfill":
        value = F.when(k == 0, p).otherwise(nxt)
    else:
        raise ValueError(f"unknown fill method {method!r}")
    return rows.select(
        asset,
        F.date_add(day, k * step).alias(day),
        value.alias(price),
        (F.col("_at") + k).alias("seq"),
    )


def grid_only(
    df: DataFrame, frequency: str = "D", asset: str = "asset_id", day: str = "d", price: str = "price"
) -> DataFrame:
    """The grid with gaps left NULL (an outer join with the calendar, without the join)."""
    step = STEP_DAYS[frequency]
    w = Window.partitionBy(asset).orderBy(day)
    gap = F.coalesce(F.datediff(F.lead(day).over(w), day) / step, F.lit(1)).cast("int")
    rows = df.select(asset, day, price, gap.alias("_gap")).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1))
    )
    return rows.select(
        asset, F.date_add(day, F.col("_k") * step).alias(day),
        F.when(F.col("_k") == 0, F.col(price)).alias(price),
    )
