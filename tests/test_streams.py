"""Streaming forms on small arrivals."""

import datetime as dt

from pyspark.sql import functions as F

from seriesloom.sources.bucket_table import BucketTable, current
from seriesloom.streaming import series_streams as ss

T0 = dt.datetime(2024, 1, 1)


def test_a_later_batch_replaces_any_earlier_day(spark, tmp_path):
    schema = "asset_id STRING, ts DATE, price DOUBLE, tie BIGINT"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    days = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    batches = [
        [("a", days[0], 1.0, 1), ("a", days[1], 2.0, 1), ("a", days[1], 2.5, 2)],
        [("a", days[0], 9.0, 0), ("a", days[2], 3.0, 0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ss.ingest_prices(ss.stream_files(spark, src, "*.parquet", schema), out, cp)
    got = {r["ts"].day: r["price"] for r in ss.merged_prices(spark, out, schema).collect()}
    assert got == {1: 9.0, 2: 2.5, 3: 3.0}
    ss.compact(spark, out, ["asset_id", "ts"], ["tie"], schema)
    assert spark.read.parquet(out).count() == 3
    spark.createDataFrame([("a", days[1], 7.0, 0)], schema).coalesce(1).write.mode("append").parquet(src)
    ss.ingest_prices(ss.stream_files(spark, src, "*.parquet", schema), out, cp)
    got = {r["ts"].day: r["price"] for r in ss.merged_prices(spark, out, schema).collect()}
    assert got == {1: 9.0, 2: 7.0, 3: 3.0}


def test_alerts_are_raised_inside_the_stream(spark, tmp_path):
    schema = "ts TIMESTAMP, value DOUBLE"
    src, out, alerts, cp = (str(tmp_path / n) for n in ("src", "out", "alerts", "cp"))
    seen = []
    for second in ([0, 1, 2], [61, 62], [300], [63, 301, 302, 361, 362]):
        rows_at(spark, second).coalesce(1).write.mode("append").parquet(src)
        ss.run_with_alerts(
            ss.window_counts(ss.stream_files(spark, src, "*.parquet", schema), "ts", "60 seconds", "1 hour"),
            out, alerts, cp, ["window_start"], "window_start TIMESTAMP, n BIGINT",
            lambda counts: ss.sustained(counts, 60), reach=60)
        rows = ss.newest_version(spark, alerts, ["window_start"], "window_start TIMESTAMP, n BIGINT").collect()
        seen.append({(r["window_start"] - T0).seconds: r["n"] for r in rows})
    assert seen == [{}, {60: 2}, {60: 2}, {60: 3, 360: 2}]


def test_alerts_by_chained_windows(spark, tmp_path):
    """Each alert comes once, when the watermark has passed it; late rows are counted, not used."""
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema, seen, late = "ts TIMESTAMP, kind STRING", [], []

    def run(seconds, kind="error"):
        rows = [(T0 + dt.timedelta(seconds=s), kind) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        found = ss.sustained_stream(
            ss.stream_files(spark, src, "*.parquet", schema), "ts", F.col("kind") == "error", 60, "60 seconds")
        late.append(ss.run_to_files(found, out, cp))
        rows = spark.read.schema("window_start TIMESTAMP, n BIGINT").parquet(out).collect()
        seen.append(sorted(((r["window_start"] - T0).seconds, r["n"]) for r in rows))

    run([0, 1, 61, 62, 63, 121, 122, 300, 301])
    run([400], "heartbeat")
    run([2, 3])
    run([420, 421, 480, 481])
    run([1000], "heartbeat")
    assert seen == [[(60, 3), (120, 2)]] * 4 + [[(60, 3), (120, 2), (480, 2)]]
    assert late[0] == 0 and late[2] > 0 and late[3] == 0


def test_stream_into_buckets_matches_the_log(spark, tmp_path):
    schema = "asset_id STRING, ts DATE, price DOUBLE, tie BIGINT"
    src, cp, cp2 = (str(tmp_path / n) for n in ("src", "cp", "cp2"))
    kept = BucketTable(str(tmp_path / "kept"), schema, ("asset_id", "ts"), ("tie",), ("asset_id", "year(ts)"), buckets=8)
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=200 * i) for i in range(5)]
    for turn in range(3):
        rows = [(f"a{i}", d, float(turn * 100 + i), t) for i in range(6) for d in days[turn:turn + 3] for t in (2, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ss.run_into_buckets(ss.stream_files(spark, src, "*.parquet", schema), kept, cp)
        ss.ingest_prices(ss.stream_files(spark, src, "*.parquet", schema), str(tmp_path / "log"), cp2)
    got = {tuple(r) for r in current(spark, kept).drop("tie").collect()}
    assert got == {tuple(r) for r in ss.merged_prices(spark, str(tmp_path / "log"), schema).collect()} and len(got) == 30


def rows_at(spark, seconds, values=None):
    values = values or [1.0] * len(seconds)
    rows = [(T0 + dt.timedelta(seconds=s), v) for s, v in zip(seconds, values)]
    return spark.createDataFrame(rows, "ts timestamp, value double")


def test_sustained_needs_neighbouring_windows(spark):
    counts = ss.window_counts(rows_at(spark, [0, 1, 61, 62, 63, 125, 300, 301, 420, 421, 480, 481]), "ts", ss.ERROR_WINDOW, "1 hour")
    got = {(r["window_start"] - T0).seconds: r["n"] for r in ss.sustained(counts, 60).collect()}
    assert got == {60: 3, 480: 2}
    three = ss.sustained(counts, 60, threshold=0, in_a_row=3).collect()
    assert {(r["window_start"] - T0).seconds for r in three} == {120}


def test_latency_quantile(spark):
    values = [float(v) for v in range(4900, 5010, 10)]
    df = rows_at(spark, [1] * len(values) + [70], values + [10.0])
    got = {(r["window_start"] - T0).seconds: (r["p_high"], r["alert"]) for r in ss.latency_alerts(
        ss.window_values(df, "ts", "value", "60 seconds", "1 hour")).collect()}
    assert got == {0: (4995.0, False), 60: (10.0, False)}
    assert ss.latency_alerts(ss.window_values(df, "ts", "value", "60 seconds", "1 hour"), limit=4990.0).filter("alert").count() == 1


def test_updates_across_batches_keep_the_newest_version(spark, tmp_path):
    schema = "id BIGINT, user STRING, ts TIMESTAMP, v DOUBLE"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i, (user, v) in enumerate([("x", 1.0), ("x", 2.0), ("y", 5.0)]):
        spark.createDataFrame([(i, user, T0 + dt.timedelta(hours=i), v)], schema).write.mode("append").parquet(src)
        stream = ss.stream_files(spark, src, "*.parquet", schema, max_files=1)
        ss.run_to_table(ss.latest_per_asset(stream, "user", "ts", ["v"], "id"), out, cp)
    got = {r["user"]: r["v"] for r in ss.newest_version(spark, out, ["user"], "user STRING, ts TIMESTAMP, v DOUBLE").collect()}
    assert got == {"x": 2.0, "y": 5.0}


def test_dedupe_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = rows_at(spark, [0, 0, 5, 5, 5], [1.0, 1.0, 1.0, 2.0, 2.0])
    df.write.parquet(src)
    stream = ss.stream_files(spark, src, "*.parquet", df.schema)
    ss.run_to_table(ss.dedupe_stream(stream, ["ts", "value"], "ts", "1 hour"), out, cp, "append")
    assert spark.read.parquet(out).select("ts", "value").count() == 3


def test_batch_and_stream_counts_agree(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = rows_at(spark, list(range(0, 600, 7)))
    df.write.parquet(src)
    ss.run_to_table(ss.window_counts(ss.stream_files(spark, src, "*.parquet", df.schema), "ts", "60 seconds", "1 hour"), out, cp)
    streamed = ss.newest_version(spark, out, ["window_start"], "window_start TIMESTAMP, n BIGINT")
    assert streamed.exceptAll(ss.window_counts(df, "ts", "60 seconds", "1 hour")).count() == 0
    assert streamed.agg(F.sum("n")).first()[0] == df.count()
