"""Stored pages to targets, and collected series to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import names
from seriesloom.operators import cleaning, pages, splits, validation


def discover(
    stored: DataFrame, brands: DataFrame, page_brand: Column, quota: int,
    path_fragment: str = names.PRODUCT_PATH, chain: list[pages.Strategy] | None = None,
) -> DataFrame:
    """Targets per brand from stored listing pages.

    ``brands`` holds (brand, url); ``page_brand`` names a page's brand. The slug
    is the last part of the brand's address. A brand's links come from all its
    pages, first seen first, up to the quota.
    """
    dim = brands.select("brand", names.last_segment(F.col("url")).alias("slug"))
    ours = stored.withColumn("brand", page_brand).filter(~pages.is_challenge(F.col("html")))
    ours = ours.join(dim, "brand")
    found = pages.extract(
        ours, F.col("slug"), quota, chain or pages.default_chain(path_fragment), keep=["brand", "slug"])
    first = found.groupBy("brand", "slug", "url").agg(F.min(F.struct("page_id", "pos")).alias("seen"))
    kept = splits.top_per_group(first, ["brand"], [F.col("seen"), F.col("url")], quota)
    return pages.targets(kept, F.col("brand"), F.col("slug"), path_fragment)


def usable_targets(raw: DataFrame, path_fragment: str = names.PRODUCT_PATH) -> DataFrame:
    """Targets with an id (given or recovered) and non-blank brand, name and address."""
    fixed = names.backfill_id(F.col("watch_id"), F.col("model_name"), F.col("url"), path_fragment)
    found = raw.withColumns(fixed).filter(F.col("watch_id").isNotNull())
    return cleaning.required_text(found, "brand", "model_name", "url")


def check_series(
    df: DataFrame, asset: str, ts: str, ordinal: str, min_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdict per asset, valid rows, and quarantined rows with their reason."""
    v = validation.verdicts(validation.order_check(df, asset, ts, ordinal), min_rows)
    good, bad = validation.split_quarantine(df, v, asset)
    return v, good, bad


def recollect_list(v: DataFrame, asset: str) -> DataFrame:
    """Invalid assets with the parts of their file name."""
    parts = names.file_name(F.col(asset).cast("string"))
    return v.filter(~F.col("is_valid")).select(
        F.col(asset).alias("file"), parts["brand"].alias("brand"), parts["model"].alias("model"),
        parts["id"].alias("watch_id"), F.col("error_message").alias("issue"), "row_count",
    )
