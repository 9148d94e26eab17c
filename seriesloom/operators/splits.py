"""Training-table shaping: column choice, null handling, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.config import SplitConfig
from seriesloom.operators import features as feat
from seriesloom.operators.ordering import picked_rows

# ---- Fixed values ------------------------------------------------------------
NOT_FEATURES = ("asset_id", "brand", "model", "date", "timestamp")
TARGET_PREFIX = "target"
LEADING_COLUMNS = ("date", "price", "watch_id", "brand", "model")
# ------------------------------------------------------------------------------


def feature_names(columns: list[str], extra: tuple[str, ...] = ()) -> list[str]:
    """Columns a model may see: no targets, identities or raw dates."""
    drop = {*NOT_FEATURES, *extra}
    return [c for c in columns if c not in drop and not c.startswith(TARGET_PREFIX)]


def feature_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(feature_names(df.columns, extra))


def leading_columns(df: DataFrame, first: tuple[str, ...] = LEADING_COLUMNS) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def numeric_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every named column as a double; missing or unreadable becomes 0."""
    kinds = dict(df.dtypes)

    def number(c: str):
        col = F.col(c)
        if kinds[c] == "string":
            return F.coalesce(col.try_cast("double"), F.lit(0.0))
        value = col.cast("int").cast("double") if kinds[c] == "boolean" else col.cast("double")
        return F.coalesce(value, F.lit(0.0))

    return df.withColumns({c: number(c) for c in columns})


def temporal_split(
    df: DataFrame, cfg: SplitConfig = SplitConfig(), asset: str = "asset_id", ts: str = "d",
    require: str | None = None,
) -> DataFrame:
    """Mark each row train, val or test by its position in its asset.

    Input is a grid, so an asset's rows are bounded by its days. Assets with too
    few rows, or whose shares collapse, are left out.
    """
    needed = [asset, ts] + ([require] if require else [])
    w = Window.partitionBy(asset).orderBy(ts)
    rows = df.dropna(subset=needed).withColumns({
        "_i": F.row_number().over(w) - 1,
        "_n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    test_at = F.floor(F.col("_n") * F.lit(1 - cfg.test_size))
    val_at = F.floor(F.col("_n") * F.lit(1 - cfg.test_size - cfg.val_size))
    part = (
        F.when(F.col("_i") < val_at, "train").when(F.col("_i") < test_at, "val").otherwise("test")
    )
    usable = (F.col("_n") >= cfg.min_rows) & (val_at > 0) & (test_at > val_at)
    return rows.filter(usable).withColumn("split", part).drop("_i", "_n")


def split_name(horizon: int) -> str:
    return f"split_h{horizon}"


def horizon_splits(df: DataFrame, horizons, cfg: SplitConfig, g: feat.Grid) -> DataFrame:
    """``df`` with target and split of every horizon, by one pass over the asset windows.

    A split is what ``temporal_split`` gives over the rows that have the target; it is
    NULL where the target is missing or the asset has too few rows.
    """
    rows = df.dropna(subset=[g.asset, g.day])
    names = {h: feat.target_name(h) for h in horizons}
    rows = rows.withColumns({
        n: F.lead(g.price, h).over(g.w) for h, n in names.items() if n not in rows.columns
    })
    before = g.w.rowsBetween(Window.unboundedPreceding, -1)
    whole = g.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        c: F.count(n).over(w) for h, n in names.items() for c, w in ((f"_i_{h}", before), (f"_n_{h}", whole))
    })
    out = {}
    for h, n in names.items():
        i, size = F.col(f"_i_{h}"), F.col(f"_n_{h}")
        test_at = F.floor(size * F.lit(1 - cfg.test_size))
        val_at = F.floor(size * F.lit(1 - cfg.test_size - cfg.val_size))
        usable = F.col(n).isNotNull() & (size >= cfg.min_rows) & (val_at > 0) & (test_at > val_at)
        part = F.when(i < val_at, "train").when(i < test_at, "val").otherwise("test")
        out[split_name(h)] = F.when(usable, part)
    return rows.withColumns(out).drop(*[f"_{k}_{h}" for h in names for k in "in"])


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): those with the smallest digests of seed and ``keys``.

    The same rows whatever the partitions, if ``keys`` tell rows apart. Digests are
    counted by their first four digits, at most 65 536 counts; all rows below the digits
    that hold rank ``n`` stay where they are, and only that last bucket is ordered.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)))
    bucket = F.left("_draw", F.lit(4))
    counts = drawn.groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect()
    below, last = 0, None
    for row in counts:
        if below + row["c"] > n:
            last = row["b"]
            break
        below += row["c"]
    if last is None:
        return df
    rest = drawn.filter(bucket == last).orderBy("_draw", *keys).limit(n - below)
    return drawn.filter(bucket < last).unionByName(rest).drop("_draw")


def last_rows(df: DataFrame, n: int, asset: str = "asset_id", ts: str = "d") -> DataFrame:
    """Newest ``n`` rows per asset; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(asset).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_row(df: DataFrame, asset: str = "asset_id", ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Newest row per asset, as an aggregate whose partial results merge before the shuffle.

    ``tie`` tells rows of one time apart.
    """
    rest = [c for c in df.columns if c != asset]
    return picked_rows(df, [asset], rest, [ts, *(tie or [])])
