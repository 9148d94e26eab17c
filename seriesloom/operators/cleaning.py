"""Row-level cleaning of raw observations.

Raw observations are the only rows whose count per asset has no bound, so
nothing here sorts or collects an asset in one task: every reduction is a
``groupBy`` with map-side partial aggregation, and per-asset facts come back by
an equi join that adaptive execution may broadcast or skew-split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.config import PrepConfig
from seriesloom.operators.ordering import picked_rows
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.session import dropped_shuffles, materialize, small_tasks


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def positive_price(df: DataFrame, price: str = "price") -> DataFrame:
    """Keep rows with a price above zero; missing prices go too."""
    return df.filter((F.col(price) > 0) & ~F.isnan(price))


def first_per_timestamp(
    df: DataFrame, order: list[str | Column], asset: str = "asset_id", ts: str = "ts",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per (asset, ts): the first in ingest order.

    ``order`` must be unique inside a duplicate group. Kept numbers and dates with
    order columns of whole numbers or times stay a hash aggregate (``ordering``).
    """
    rest = keep or [c for c in df.columns if c not in (asset, ts)]
    if len(rest) == 1 and len(order) == 1:
        return df.groupBy(asset, ts).agg(F.min_by(rest[0], order[0]).alias(rest[0]))
    return picked_rows(df, [asset, ts], rest, order, last=False)


def first_in_passes(
    df: DataFrame, order: list[str | Column], passes: int, asset: str = "asset_id", ts: str = "ts",
    keep: list[str] | None = None,
) -> DataFrame:
    """``first_per_timestamp`` over so many slices of the assets, one after the other.

    Each pass reads ``df`` again, writes its rows and deletes its shuffle files, so the disk
    holds the shuffle of one slice beside what is kept. Slices are by hash of the asset;
    inside one, rows spread over tasks by (asset, ts), few enough to be sorted in memory.
    """
    if passes < 1:
        raise ValueError("passes must be a positive integer")
    part = F.pmod(F.xxhash64(asset), F.lit(passes))
    with dropped_shuffles(df.sparkSession), small_tasks(df.sparkSession):
        made = [
            materialize(first_per_timestamp(df.filter(part == i), order, asset, ts, keep), "first")
            for i in range(passes)
        ]
    return reduce(DataFrame.unionByName, made)


def with_asset_stats(df: DataFrame, stats: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Attach one-row-per-asset facts to every row.

    No hint: the planner broadcasts a side it has measured as small, and beyond
    that a sort-merge join with skew splitting spreads a hot asset.
    """
    return df.join(stats, asset)


def min_observations(df: DataFrame, n: int, asset: str = "asset_id") -> DataFrame:
    enough = df.groupBy(asset).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(asset)
    return df.join(enough, asset, "left_semi")


def max_missing_share(
    df: DataFrame, percent: float, asset: str = "asset_id", price: str = "price"
) -> DataFrame:
    """Drop assets whose share of missing prices exceeds ``percent``."""
    share = F.avg(F.col(price).isNull().cast("double")) * 100
    kept = df.groupBy(asset).agg(share.alias("_share")).filter(F.col("_share") <= percent).select(asset)
    return df.join(kept, asset, "left_semi")


def outliers_iqr(
    df: DataFrame, k: float = 3.0, asset: str = "asset_id", price: str = "price"
) -> DataFrame:
    """Keep prices inside ``[Q1 - k*IQR, Q3 + k*IQR]`` of their asset."""
    q = exact_quantiles(df, [asset], price, [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    fences = q.select(
        asset,
        (F.col("q")[0] - F.lit(k) * iqr).alias("_lo"),
        (F.col("q")[1] + F.lit(k) * iqr).alias("_hi"),
    )
    kept = with_asset_stats(df, fences, asset).filter(F.col(price).between(F.col("_lo"), F.col("_hi")))
    return kept.select(df.columns)


def outliers_zscore(
    df: DataFrame, k: float = 3.0, asset: str = "asset_id", price: str = "price"
) -> DataFrame:
    """Keep prices strictly within ``k`` population deviations; a flat asset loses all rows."""
    stats = df.groupBy(asset).agg(F.avg(price).alias("_mu"), F.stddev_pop(price).alias("_sd"))
    z = F.abs(F.try_divide(F.col(price) - F.col("_mu"), F.col("_sd")))
    return with_asset_stats(df, stats, asset).filter(z < k).select(df.columns)


def remove_outliers(
    df: DataFrame, cfg: PrepConfig, asset: str = "asset_id", price: str = "price", ts: str = "ts"
) -> DataFrame:
    """Apply the configured method; off, empty or unknown methods change nothing."""
    from seriesloom.operators.isolation import outliers_isolation_forest

    method = (cfg.outlier_method or "none").lower()
    if not cfg.remove_outliers or method not in ("iqr", "zscore", "isolation_forest"):
        return df
    if method == "iqr":
        return outliers_iqr(df, cfg.outlier_threshold, asset, price)
    if method == "zscore":
        return outliers_zscore(df, cfg.outlier_threshold, asset, price)
    return outliers_isolation_forest(df, asset=asset, price=price, ts=ts)


def fill_limited(
    df: DataFrame, method: str = "linear", limit: int = 5,
    asset: str = "asset_id", ts: str = "ts", price: str = "price", block_days: int = 32,
) -> DataFrame:
    """Fill at most ``limit`` missing rows of each gap, then drop what is left.

    Linear spacing is by row. Forward and linear fill from the left edge (a
    trailing gap repeats the last value), backfill from the right. Works on raw rows:
    an asset is scanned in blocks of ``block_days``, each a window partition of its own,
    and one row a block carries the nearest known prices across block edges. Rows
    without a time form the first block.
    """
    known = F.col(price).isNotNull()
    span = F.floor(F.col(ts).cast("timestamp").cast("long") / (86_400 * block_days))
    rows = df.withColumn("_block", F.coalesce(span, F.lit(-(1 << 62))))
    w = Window.partitionBy(asset, "_block").orderBy(ts)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(known, F.struct(F.col(price).alias("p"), F.col("_in").alias("n")))
    inside = rows.withColumn("_in", F.row_number().over(w)).withColumns({
        "_before": F.last(at, True).over(before), "_after": F.first(at, True).over(after),
    })
    edges = inside.groupBy(F.col(asset).alias("_asset"), F.col("_block").alias("_b")).agg(
        F.count("*").alias("_n"), F.min_by(at, F.when(known, F.col("_in"))).alias("_first"),
        F.max_by(at, F.when(known, F.col("_in"))).alias("_last"),
    )
    blocks = Window.partitionBy("_asset").orderBy("_b")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)

    def moved(c: str) -> Column:
        """The edge with its place counted in the asset, not in its block."""
        place = F.struct(F.col(c)["p"].alias("p"), (F.col(c)["n"] + F.col("_start")).alias("n"))
        return F.when(F.col(c).isNotNull(), place)

    carried = edges.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        "_asset", "_b", "_start", F.last(moved("_last"), True).over(earlier).alias("_carry"),
        F.first(moved("_first"), True).over(later).alias("_ahead"),
    )
    same = F.col(asset).eqNullSafe(F.col("_asset")) & (F.col("_block") == F.col("_b"))
    marks = inside.join(carried, same).withColumns({
        "_l": F.coalesce(moved("_before"), F.col("_carry")), "_r": F.coalesce(moved("_after"), F.col("_ahead")),
    }).withColumns({
        "_rn": F.col("_in") + F.col("_start"), "_left": F.col("_l.p"), "_right": F.col("_r.p"),
        "_left_rn": F.col("_l.n"), "_right_rn": F.col("_r.n"),
    })
    from_left = F.col("_rn") - F.col("_left_rn")
    from_right = F.col("_right_rn") - F.col("_rn")
    width = F.col("_right_rn") - F.col("_left_rn")
    if method == "linear":
        line = F.col("_left") + (F.col("_right") - F.col("_left")) * from_left / F.nullif(width, F.lit(0))
        value, near = F.coalesce(line, F.col("_left")), from_left
    elif method == "forward":
        value, near = F.col("_left"), from_left
    elif method == "backfill":
        value, near = F.col("_right"), from_right
    else:
        raise ValueError(f"unknown fill method {method!r}")
    filled = F.when(known, F.col(price)).when(near <= limit, value)
    return marks.withColumn(price, filled).filter(F.col(price).isNotNull()).select(df.columns)


def drop_missing(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def required_text(df: DataFrame, *cols: str) -> DataFrame:
    """Trim the named texts and drop rows where one is missing or blank."""
    trimmed = df.withColumns({c: F.regexp_replace(c, r"^\s+|\s+$", "") for c in cols})
    for c in cols:
        trimmed = trimmed.filter(F.length(c) > 0)
    return trimmed


def price_range_warnings(
    df: DataFrame, low: float = 100.0, high: float = 1_000_000.0,
    asset: str = "asset_id", price: str = "price",
) -> DataFrame:
    """Per asset: price range, whether any price exists, and range warnings."""
    stats = df.groupBy(asset).agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("mean_price"),
        F.count(price).alias("n_prices"),
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("min_price") < low, F.lit("low price")),
        F.when(F.col("max_price") > high, F.lit("high price")),
    ))
    return stats.withColumns({"valid": F.col("n_prices") > 0, "warnings": warnings})


def members(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key appears in ``wanted``."""
    return df.join(wanted, on, "left_semi")
