"""Per-asset summaries, encodings, coverage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.config import TIERS
from seriesloom.functions import labels
from seriesloom.session import materialize

# ---- Fixed values: report texts ------------------------------------------------
MISSING_FEATURES = "Features have %d missing values"
MISSING_TARGET = "Target has %d missing values"
NO_SAMPLES = "No samples found"
# ------------------------------------------------------------------------------


def asset_summary(
    df: DataFrame, by: list[str] | None = None, day: str = "d", price: str = "price",
    n_columns: int | None = None, tiers=TIERS,
) -> DataFrame:
    """One row per asset: size, span, mean, deviation, tier, completeness."""
    by = by or ["asset_id"]
    base = df.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        F.datediff(F.max(day), F.min(day)).alias("date_range_days"),
        F.avg(price).alias("avg_price"),
        F.stddev_samp(price).alias("price_volatility"),
    )
    width = n_columns if n_columns is not None else len(df.columns)
    return base.withColumns({
        "luxury_tier": labels.tier(F.col("avg_price"), tiers),
        "data_quality_score": F.least(F.lit(1.0), F.col("total_records") / F.lit(365.0)),
        "features_generated": F.lit(width),
    })


def combined_summary(
    df: DataFrame, by: list[str] | None = None, day: str = "d", price: str = "price", tiers=TIERS
) -> DataFrame:
    """The summary rebuilt from the combined table: no completeness, no width."""
    return asset_summary(df, by, day, price, 0, tiers).drop("data_quality_score", "features_generated")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their zero-based position in sorted order.

    The distinct values are range-partitioned and written once, which fixes each
    one's partition and place; a code is its place plus the sizes of the
    partitions before. Only one number per partition is ever added up.
    """
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    placed = materialize(
        values.repartitionByRange(column)
        .sortWithinPartitions(column)
        .select(column, F.monotonically_increasing_id().alias("_id"))
        .select(column, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")),
        "codes",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    before = Window.partitionBy("_all").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(column, (F.col("_start") + F.col("_place")).cast("int").alias("code"))


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Code of each text in sorted order; missing text is -1."""
    codes = label_codes(df, column).withColumnRenamed("code", out)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1))).select(*df.columns, out)


def add_frequency(df: DataFrame, column: str, out: str) -> DataFrame:
    """Row count of each value, joined back (hot values are skew-split)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(out))
    return df.join(counts, column, "left").select(*df.columns, out)


def lookup(
    df: DataFrame, dim: DataFrame, on: str, value: str, out: str, default: str = ""
) -> DataFrame:
    """First non-missing ``value`` per key of ``dim``; unmatched rows get ``default``."""
    one = dim.dropna(subset=[on, value]).groupBy(on).agg(F.min(value).alias(out))
    return df.join(one, on, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def feature_report(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """One row: size, target range, missing counts, column kinds, warnings."""
    kinds: dict[str, int] = {}
    for name, kind in df.dtypes:
        if name in columns:
            kinds[kind] = kinds.get(kind, 0) + 1
    missing: Column = F.lit(0)
    for c in columns:
        missing = missing + F.count_if(F.col(c).isNull())
    stats = df.agg(
        F.count("*").alias("n_samples"),
        F.min(target).alias("target_min"),
        F.max(target).alias("target_max"),
        missing.cast("long").alias("missing_features"),
        F.count_if(F.col(target).isNull()).alias("missing_target"),
    )
    kind_map = F.create_map(*[F.lit(x) for k in sorted(kinds) for x in (k, kinds[k])]) if kinds else F.lit(None)
    warnings = F.array_compact(F.array(
        F.when(F.col("missing_features") > 0, F.format_string(MISSING_FEATURES, "missing_features")),
        F.when(F.col("missing_target") > 0, F.format_string(MISSING_TARGET, "missing_target")),
        F.when(F.col("n_samples") == 0, F.lit(NO_SAMPLES)),
    ))
    return stats.withColumns({
        "n_features": F.lit(len(columns)),
        "feature_types": kind_map,
        "warnings": warnings,
        "valid": (F.col("missing_target") == 0) & (F.col("n_samples") > 0),
    })


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def coverage(df: DataFrame, by: str, target: int) -> DataFrame:
    """Found rows per group against a wanted number, in percent."""
    return df.groupBy(by).agg(F.count("*").alias("found")).withColumns({
        "target": F.lit(target), "percent": F.col("found") / F.lit(float(target)) * 100,
    })


def outcome_counts(df: DataFrame, success: Column, by: list[str] | None = None) -> DataFrame:
    """Succeeded, failed, total and success percent, overall or per group."""
    agg = df.groupBy(*(by or [])).agg(
        F.count_if(success).alias("succeeded"), F.count("*").alias("total")
    )
    return agg.withColumns({
        "failed": F.col("total") - F.col("succeeded"),
        "percent": F.try_divide(F.col("succeeded") * 100.0, F.col("total")),
    })


def health(df: DataFrame, asset: str, models: DataFrame, model: str) -> DataFrame:
    """One row: number of assets and models, and whether both exist."""
    assets = df.select(F.col(asset).cast("string").alias("name"), F.lit("asset").alias("kind"))
    names = models.select(F.col(model).cast("string").alias("name"), F.lit("model").alias("kind"))
    seen = assets.unionByName(names).distinct()
    return seen.agg(
        F.count_if(F.col("kind") == "asset").alias("n_assets"),
        F.count_if(F.col("kind") == "model").alias("n_models"),
    ).withColumn(
        "status",
        F.when((F.col("n_assets") > 0) & (F.col("n_models") > 0), "healthy").otherwise("unhealthy"),
    )


def extraction_summary(
    df: DataFrame, by: list[str] | None = None, ts: str = "ts", price: str = "price"
) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
    )


def distinct_sorted(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the distinct values in order; repeats collapse before they move."""
    return df.select(by, value).distinct().groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("values"))


def first_mentions(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Per group the distinct values by their first place in ``order``."""
    seen = df.groupBy(by, value).agg(F.min(order).alias("_at"))
    pairs = F.array_sort(F.collect_list(F.struct("_at", value)))
    return seen.groupBy(by).agg(F.transform(pairs, lambda s: s[value]).alias("values"))


def distinct_in_order(names: list[str]) -> list[str]:
    """Requested names once each, first mention first."""
    return list(dict.fromkeys(names))
