"""Continuous forms: upsert ingest, alert windows, dedupe, latest value.

Series and latest values are kept in a ``BucketTable``: a micro-batch rewrites only the
buckets that it touches. Alerts on counts are a stream of their own, two windows in a
chain, without a look at earlier output. ``run_to_table`` publishes a log: a micro-batch
writes its own folder, replaced if the batch is retried, and readers keep the newest
version of each key. No driver state, and a lost executor only re-runs a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.sources.bucket_table import BucketTable, merge
from seriesloom.sources.writers import safe_replace

# ---- Fixed values ------------------------------------------------------------
ERROR_WINDOW = "60 seconds"
ERROR_THRESHOLD = 1
ERROR_WINDOWS_IN_A_ROW = 2
LATENCY_LIMIT = 5000.0
LATENCY_QUANTILE = 0.95
# ------------------------------------------------------------------------------


def stream_files(spark: SparkSession, path: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Process everything available, one folder per micro-batch."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        df.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_into_buckets(df: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Merge everything available into ``table``; a retried micro-batch changes nothing."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        merge(table, batch, checkpoint, batch_id)

    query = (
        df.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> int:
    """Append final rows to ``path``, each once; returns what came too late.

    Counted as the engine reports it: rows that a stateful step refused, after those of
    one task and one group were combined.
    """
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_with_alerts(
    df: DataFrame, path: str, alerts: str, checkpoint: str, keys: list[str], schema: str,
    rule: Callable[[DataFrame], DataFrame], reach: int,
) -> None:
    """Publish windows as ``run_to_table`` does, and in each micro-batch the alerts they raise.

    ``rule`` turns windows into alerts by ``window_start``. Only windows at most
    ``reach`` seconds before or after those of the batch are judged anew; alerts are
    versioned like the windows.
    """
    spark = df.sparkSession

    def publish(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        span = spark.read.parquet(folder).agg(F.min("window_start"), F.max("window_start")).first()
        if span[0] is None:
            return
        near = F.unix_timestamp("window_start").between(
            F.unix_timestamp(F.lit(span[0])) - reach, F.unix_timestamp(F.lit(span[1])) + reach
        )
        found = rule(newest_version(spark, path, keys, schema).filter(near))
        found.write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")

    query = (
        df.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], schema: str) -> None:
    """Rewrite versioned batches as one table that holds the winning row of each key.

    The winner keeps its batch number, so later batches still replace it. The new table
    is written beside the old one and swapped; run it between streams.
    """
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("_r"))
    safe_replace(picked.select(*keys, "_r.*"), path, partition_by=("batch",))


def newest_version(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """Per key, the row of the latest micro-batch that touched it."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return picked.select(*keys, "_r.*")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ---- incremental series ---------------------------------------------------------


def ingest_prices(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each micro-batch of (asset_id, ts, price, tie); no lateness limit."""
    run_to_table(stream, path, checkpoint, "append")


def merged_prices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Current series: the latest batch wins per (asset, ts), then the greatest tie."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    return rows.groupBy("asset_id", "ts").agg(
        F.max_by("price", F.struct("batch", "tie")).alias("price")
    )


# ---- alert windows --------------------------------------------------------------


def window_counts(df: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """Rows per tumbling window; works on streams and tables.

    On a stream, rows later than ``lateness`` behind the newest one are not counted.
    """
    timed = df.withWatermark(ts, lateness) if df.isStreaming else df
    return timed.groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), "n"
    )


def sustained(counts: DataFrame, width_seconds: int, threshold: int = ERROR_THRESHOLD,
              in_a_row: int = ERROR_WINDOWS_IN_A_ROW) -> DataFrame:
    """Windows above the threshold whose preceding windows are above it too.

    A window counts toward the alerts it can take part in, which is its own and
    the next ones; an alert is a window with all its votes.
    """
    high = counts.filter(F.col("n") > threshold)
    votes = high.select(
        F.explode(F.sequence(F.lit(0), F.lit(in_a_row - 1))).alias("_k"), "window_start", "n"
    ).select(
        F.timestamp_seconds(F.unix_timestamp("window_start") + F.col("_k") * width_seconds).alias("window_start"),
        F.when(F.col("_k") == 0, F.col("n")).alias("n"),
    )
    return votes.groupBy("window_start").agg(F.count("*").alias("_v"), F.max("n").alias("n")).filter(
        F.col("_v") == in_a_row
    ).select("window_start", "n")


def sustained_stream(df: DataFrame, ts: str, counted: Column, width_seconds: int, lateness: str,
                     threshold: int = ERROR_THRESHOLD, in_a_row: int = ERROR_WINDOWS_IN_A_ROW) -> DataFrame:
    """``sustained`` as a stream: counted windows feed a second, sliding one.

    An alert is emitted once, when the watermark has passed it. Rows that are not
    ``counted``, such as heartbeats, still move the watermark, which closes windows
    while there are no errors.
    """
    width, reach = f"{width_seconds} seconds", f"{width_seconds * in_a_row} seconds"
    # Counted inside the aggregate: a filter would be pushed below the watermark and
    # take the heartbeats away.
    timed = df.withWatermark(ts, lateness).groupBy(F.window(ts, width)).agg(F.count_if(counted).alias("n"))
    high = timed.filter(F.col("n") > threshold)
    votes = high.select(F.window_time("window").alias("at"), F.col("window.start").alias("window_start"), "n")
    runs = votes.groupBy(F.window("at", reach, width)).agg(
        F.count("*").alias("_v"), F.max("window_start").alias("window_start"), F.max_by("n", "window_start").alias("n")
    )
    return runs.filter(F.col("_v") == in_a_row).select("window_start", "n")


def window_values(df: DataFrame, ts: str, value: str, width: str, lateness: str) -> DataFrame:
    """Value counts per tumbling window: state splits by value, so no window is hot.

    On a stream, rows later than ``lateness`` behind the newest one are not counted.
    """
    timed = df.withWatermark(ts, lateness) if df.isStreaming else df
    return timed.groupBy(F.window(ts, width), F.col(value).alias("value")).agg(
        F.count("*").alias("n")
    ).select(F.col("window.start").alias("window_start"), "value", "n")


def latency_alerts(values: DataFrame, limit: float = LATENCY_LIMIT, q: float = LATENCY_QUANTILE) -> DataFrame:
    """Exact high quantile per window and whether it breaks the limit."""
    tops = exact_quantiles(values, ["window_start"], "value", [q], count="n")
    return tops.select(
        "window_start", F.col("q")[0].alias("p_high"), (F.col("q")[0] > limit).alias("alert")
    )


# ---- dedupe and latest ----------------------------------------------------------


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """First row of each key among rows at most ``lateness`` apart."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def latest_per_asset(df: DataFrame, asset: str, ts: str, rest: list[str], tie: str) -> DataFrame:
    """Newest observation per asset; the state is one row per asset."""
    newest = F.max_by(F.struct(ts, *rest), F.struct(ts, tie))
    return df.groupBy(asset).agg(newest.alias("_r")).select(asset, "_r.*")
