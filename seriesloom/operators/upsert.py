"""Unions and last-wins merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import picked_rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(
    existing: DataFrame | None, new: DataFrame, order: list[str] | None = None,
    keys: tuple[str, ...] = ("asset_id", "ts"), value: str = "price",
) -> DataFrame:
    """Rows of both, one per key: a new row replaces an existing one.

    Inside a batch the greatest ``order`` wins. A first load is taken as is.
    Written as an aggregate, so duplicates of a hot key collapse before moving.
    """
    order = order or []
    cols = [*keys, value, *order]
    if existing is None:
        return new.select(*keys, value)
    ranked = existing.select(*cols, F.lit(False).alias("_new")).unionByName(
        new.select(*cols, F.lit(True).alias("_new"))
    )
    return picked_rows(ranked, list(keys), [value], ["_new", *order])


def added_rows(existing: DataFrame, merged: DataFrame, by: str = "asset_id") -> DataFrame:
    """Per asset: how many rows the merge added."""
    both = existing.select(by, F.lit(0).alias("_m")).unionByName(merged.select(by, F.lit(1).alias("_m")))
    return both.groupBy(by).agg(
        F.count_if(F.col("_m") == 0).alias("existing_rows"),
        F.count_if(F.col("_m") == 1).alias("merged_rows"),
    ).withColumn("added_rows", F.col("merged_rows") - F.col("existing_rows"))
