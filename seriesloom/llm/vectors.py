"""Vectors that can take part: of the common length, finite, not zero."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored


def as_doubles(column: str) -> Column:
    return F.col(column).cast("array<double>")


def valid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, vec array<double>), length) of the usable rows, written once.

    Null and zero vectors and such with null or non-finite components are left out, and
    so are those of another length than the most common one (ties: the longer).
    """
    v = as_doubles(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("vec")).where(
        F.col(vector).isNotNull() & good & F.exists(v, lambda x: x != 0)
    )
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    found = sizes.collect()
    d = int(found[0]["d"]) if found else 0
    return rows.where(F.size("vec") == d), d


def stack(lists, d: int) -> np.ndarray:
    """An Arrow list column as a matrix."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def seed_rows(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` different vectors with the smallest hashes: the same whatever the partitions."""
    share = rows.agg(F.count("*")).first()[0]
    if not share:
        return np.zeros((0, 0))
    top = min(1.0, 2.0 * n / share + 200 / share)
    mark = F.xxhash64(F.lit(seed), F.col("vec"))
    cut = rows.select("vec", mark.alias("h")).where(F.col("h") <= F.lit(min(int(-(2**63) + top * (2**64 - 1)), 2**63 - 1)))
    got = cut.distinct().orderBy("h").limit(n).select("vec").toPandas()
    return np.array([np.asarray(x, dtype=float) for x in got["vec"]])
