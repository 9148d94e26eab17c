"""Streams over the given tables, each read to its end and published as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import P_SQL, p, query, r, table
from seriesloom.session import scratch_path
from seriesloom.sources.bucket_table import BucketTable, current, merge
from seriesloom.streaming import series_streams as ss


#: The events span a month and come in no order: nothing is late within it.
LATENESS = "60 days"


def _prices(path):
    """Current prices by nation and year; among rows of a batch the greatest tie stays."""
    return BucketTable(
        path, "asset_id INT, ts DATE, price DOUBLE, tie BIGINT", ("asset_id", "ts"), ("tie",), ("asset_id", "year(ts)"))


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return ss.event_time(ss.stream_files(spark, sf, "events.parquet", schema), "ts")


@query("stm1_incremental_upsert", f"""
WITH {P_SQL} SELECT asset_id, ts, arg_max(price, struct_pack(a := tie % 2, b := tie)) AS price FROM p GROUP BY 1, 2""", as_text=("ts",))
def stm1(spark, sf):
    source = scratch_path(spark, "arrivals")
    checkpoint = scratch_path(spark, "ingest-checkpoint")
    rows = p(spark, sf)
    kept = _prices(scratch_path(spark, "ingested"))
    # Two arrivals, each ingested by its own run of the same query.
    for part in (0, 1):
        rows.filter(F.col("tie") % 2 == part).write.mode("append").parquet(source)
        ss.run_into_buckets(ss.stream_files(spark, source, "*.parquet", kept.schema), kept, checkpoint)
    return current(spark, kept).drop("tie")


@query("set2_upsert_by_buckets", f"""
WITH {P_SQL} SELECT asset_id, ts, arg_max(price, struct_pack(a := tie % 3 = 0, b := tie)) AS price FROM p GROUP BY 1, 2""", as_text=("ts",))
def set2_buckets(spark, sf):
    rows, kept = p(spark, sf), _prices(scratch_path(spark, "upserted"))
    for part in ("tie % 3 <> 0", "tie % 3 = 0"):
        merge(kept, rows.filter(part))
    return current(spark, kept).drop("tie")


@query("stm2_sustained_errors", """
WITH c AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS window_start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
h AS (SELECT * FROM c WHERE n > 5)
SELECT h.window_start, h.n FROM h JOIN h prev ON prev.window_start = h.window_start - INTERVAL 2 HOUR""", as_text=("window_start",))
def stm2(spark, sf):
    alerts = scratch_path(spark, "error-alerts")
    events = _events(spark, sf).select("ts", "event_type")
    # A heartbeat after the last event lets the watermark pass every window.
    last = ss.event_time(table(spark, sf, "events"), "ts").agg(F.max("ts").alias("ts"))
    beats = scratch_path(spark, "heartbeat")
    last.select((F.col("ts") + F.expr(f"INTERVAL {LATENESS} + INTERVAL 1 DAY")).alias("ts"),
                F.lit("heartbeat").alias("event_type")).write.parquet(beats)
    both = events.unionByName(ss.stream_files(spark, beats, "*.parquet", events.schema))
    found = ss.sustained_stream(both, "ts", F.col("event_type") == "error", 7200, LATENESS, threshold=5)
    ss.run_to_files(found, alerts, scratch_path(spark, "checkpoint"))
    return spark.read.schema("window_start TIMESTAMP, n BIGINT").parquet(alerts)


@query("stm3_latency_p95", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(quantile_cont(value, 0.95), 6) AS p_high,
  quantile_cont(value, 0.95) > 120 AS alert FROM events GROUP BY 1""", as_text=("window_start",))
def stm3(spark, sf):
    out = scratch_path(spark, "latency-windows")
    values = ss.window_values(_events(spark, sf), "ts", "value", "1 hour", LATENESS)
    alerts = scratch_path(spark, "latency-alerts")
    ss.run_with_alerts(
        values, out, alerts, scratch_path(spark, "checkpoint"), ["window_start", "value"],
        "window_start TIMESTAMP, value DOUBLE, n BIGINT", lambda seen: ss.latency_alerts(seen, limit=120.0), reach=0)
    judged = ss.newest_version(spark, alerts, ["window_start"], "window_start TIMESTAMP, p_high DOUBLE, alert BOOLEAN")
    return judged.withColumn("p_high", r("p_high", 6))


@query("stm4_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stm4(spark, sf):
    out = scratch_path(spark, "deduped")
    unique = ss.dedupe_stream(_events(spark, sf), ["user_id", "event_type"], "ts", LATENESS)
    ss.run_to_table(unique.select("user_id", "event_type"), out, scratch_path(spark, "checkpoint"), "append")
    return spark.read.parquet(out).select("user_id", "event_type")


@query("stm5_latest_per_user", """
SELECT user_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
       as_text=("ts",))
def stm5(spark, sf):
    kept = BucketTable(
        scratch_path(spark, "latest"), "user_id BIGINT, ts TIMESTAMP, event_id BIGINT, event_type STRING, value DOUBLE",
        ("user_id",), ("ts", "event_id"), newer_batch_wins=False)
    ss.run_into_buckets(_events(spark, sf), kept, scratch_path(spark, "checkpoint"))
    return current(spark, kept).drop("event_id")
