"""Readers and writers, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import OBS_SQL, PD_SQL, W, observed, p, pd, query, r, snap, snap_sql, table
from seriesloom.operators import splits, summaries
from seriesloom.plans import features_plan
from seriesloom.session import scratch_path
from seriesloom.sources import readers, writers


def _series_dir(spark, sf) -> str:
    """Observations as CSV: one folder per nation, named by its partition."""
    path = scratch_path(spark, "series")
    obs = observed(spark, sf).select("asset_id", F.col("ts").cast("string").alias("date"), F.col("price").alias("price(SGD)"))
    # Rows of a nation meet in one task, so each folder holds one file.
    obs.repartition("asset_id").write.partitionBy("asset_id").option("header", True).csv(path)
    return path


@query("src1_series_files", f"""
WITH {OBS_SQL} SELECT CAST(asset_id AS VARCHAR) AS asset_id, ts, price FROM obs""", as_text=("ts",))
def src1(spark, sf):
    rows = readers.read_series(spark, f"{_series_dir(spark, sf)}/*", min_rows=1)
    return rows.select("asset_id", F.to_date("ts").alias("ts"), "price")


@query("src2_first_files", f"""
WITH {OBS_SQL}, n AS (SELECT CAST(asset_id AS VARCHAR) AS asset_id FROM obs)
SELECT asset_id, count(*) AS n_rows FROM n WHERE asset_id IN (SELECT DISTINCT asset_id FROM n ORDER BY 1 LIMIT 3) GROUP BY 1""")
def src2(spark, sf):
    rows = readers.read_series(spark, f"{_series_dir(spark, sf)}/*", min_rows=1, max_files=3)
    return rows.groupBy("asset_id").agg(F.count("*").alias("n_rows"))


_CSV = "asset_id INT, ts DATE, price DOUBLE"


@query("src3_csv_strict", f"WITH {OBS_SQL} SELECT asset_id, ts, price FROM obs", as_text=("ts",))
def src3(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_table(observed(spark, sf), path, "csv")
    return readers.read_csv(spark, path, _CSV, strict=True)


@query("src3_csv_tolerant", f"WITH {OBS_SQL} SELECT asset_id, CASE WHEN day(ts) > 20 THEN NULL ELSE price END AS price, ts FROM obs", as_text=("ts",))
def src3t(spark, sf):
    path = scratch_path(spark, "csv")
    text = F.when(F.dayofmonth("ts") > 20, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    writers.write_table(observed(spark, sf).withColumn("price", text), path, "csv")
    return readers.read_csv(spark, path, _CSV, strict=False)


@query("src4_dated_csv", f"WITH {OBS_SQL} SELECT asset_id, CASE WHEN day(ts) > 20 THEN NULL ELSE ts END AS ts, price FROM obs", as_text=("ts",))
def src4(spark, sf):
    path = scratch_path(spark, "csv")
    text = F.when(F.dayofmonth("ts") > 20, F.lit("someday")).otherwise(F.col("ts").cast("string"))
    writers.write_table(observed(spark, sf).withColumn("ts", text), path, "csv")
    schema = observed(spark, sf).schema
    return readers.read_dated_csv(spark, path, "ts", schema)


@query("src5_json_documents", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src5(spark, sf):
    """Array documents of at most 64 records, one file each."""
    path = scratch_path(spark, "json")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    documents = rows.groupBy(F.floor(F.col("s_suppkey") / 64).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    documents.write.partitionBy("part").text(path)
    return readers.read_json(spark, path, rows.schema, strict=True).select(rows.columns)


_EVENT = "event_id BIGINT, user_id BIGINT, value DOUBLE"


@query("src6_json_lines", "SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'")
def src6(spark, sf):
    path = scratch_path(spark, "jsonl")
    line = (
        F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "user_id", "value")))
        .when(F.col("event_id") % 2 == 0, F.lit(""))
        .otherwise(F.lit('{"event_id": 1, "user'))
    )
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, _EVENT)


@query("src7_mixed_json", "SELECT event_id, user_id, value FROM events")
def src7(spark, sf):
    """One folder with line files, array files and object-with-list files."""
    path = scratch_path(spark, "mixed")
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    record = F.to_json(F.struct(*e.columns))
    shape = F.col("event_id") % 4
    lines = e.filter(shape == 0).select(record.alias("value"), F.lit(0).alias("shape"), F.lit(0).alias("part"))
    lines.write.partitionBy("shape", "part").text(path)
    # A document holds at most 2000 records, spread over lines that are no objects themselves.
    chunks = e.filter(shape != 0).groupBy(shape.alias("shape"), F.floor(F.col("event_id") / 2000).alias("part")).agg(
        F.array_join(F.collect_list(record), ",\n").alias("records"))
    body = F.when(F.col("shape") == 1, F.concat(F.lit("[\n"), "records", F.lit("\n]"))).otherwise(
        F.concat(F.lit('{\n"rows":\n['), "records", F.lit("\n]\n}")))
    broken = F.regexp_replace(F.regexp_replace(body, r'\{"event_id"', '{\n"event_id"'), r'(\d)\}', "$1\n}")
    chunks.select(broken.alias("value"), "shape", "part").write.mode("append").partitionBy("shape", "part").text(path)
    return readers.read_mixed_json(spark, path, _EVENT)


@query("src8_combined_files", f"WITH {PD_SQL} SELECT CAST(asset_id AS VARCHAR) AS asset_id, d, price FROM pd", as_text=("d",))
def src8(spark, sf):
    path = scratch_path(spark, "assets")
    writers.write_by_asset(pd(spark, sf).drop("seq"), path)
    return readers.combine_assets(spark, path).select("asset_id", "d", "price")


@query("src9_unified_or_combined", f"WITH {PD_SQL} SELECT asset_id, d, price FROM pd", as_text=("d",))
def src9(spark, sf):
    path = scratch_path(spark, "unified")
    writers.write_table(pd(spark, sf).drop("seq"), path)
    return readers.load_features(spark, path, f"{path}-missing").select("asset_id", "d", "price")


@query("src9_combined_branch", f"WITH {PD_SQL} SELECT CAST(asset_id AS VARCHAR) AS asset_id, d, price FROM pd", as_text=("d",))
def src9_combined(spark, sf):
    """No unified table yet: files that name their asset ``watch_id`` are combined and kept as it."""
    parts, unified = scratch_path(spark, "parts"), scratch_path(spark, "unified")
    rows = pd(spark, sf).select(F.col("asset_id").cast("string").alias("watch_id"), "d", "price")
    writers.write_table(rows.repartition(4, "watch_id"), parts)
    readers.load_features(spark, unified, parts)
    return readers.load_features(spark, unified, f"{parts}-missing").select("asset_id", "d", "price")


@query("src10_inventory", f"WITH {OBS_SQL} SELECT count(DISTINCT asset_id) AS n_files, true AS has_bytes FROM obs")
def src10(spark, sf):
    total = readers.inventory_total(readers.inventory(spark, _series_dir(spark, sf), "*.csv"))
    return total.select("n_files", (F.col("total_mb") > 0).alias("has_bytes"))


@query("src13_forecast_reload", f"""
WITH {PD_SQL} SELECT 'naive' AS model_name, asset_id, d AS feature_date, CAST(d + 1 AS DATE) AS prediction_date, price AS prediction FROM pd""",
       as_text=("feature_date", "prediction_date"))
def src13(spark, sf):
    path = scratch_path(spark, "forecasts")
    made = pd(spark, sf).select(
        F.lit("naive").alias("model_name"), "asset_id", F.col("d").cast("string").alias("feature_date"),
        F.date_add("d", 1).cast("string").alias("prediction_date"), F.col("price").alias("prediction"))
    writers.write_table(made, path)
    return readers.load_forecasts(spark, path)


# ---- writers -------------------------------------------------------------------------------


@query("snk1_asset_partitions", f"""
WITH {PD_SQL} SELECT asset_id, d, price + CASE WHEN asset_id < 5 THEN 1 ELSE 0 END AS price FROM pd""", as_text=("d",))
def snk1(spark, sf):
    path = scratch_path(spark, "by-asset")
    rows = pd(spark, sf).drop("seq")
    writers.write_by_asset(rows, path)
    # Only the assets written again are replaced; skip-if-exists changes nothing.
    writers.write_by_asset(rows.filter("asset_id < 5").withColumn("price", F.col("price") + 1), path)
    writers.write_by_asset(rows, path, overwrite=False)
    return spark.read.parquet(path).select("asset_id", "d", "price")


@query("snk2_combined_table", f"WITH {PD_SQL} SELECT asset_id, d, price FROM pd", as_text=("d",))
def snk2(spark, sf):
    path = scratch_path(spark, "combined")
    rows = pd(spark, sf).drop("seq")
    writers.write_table(rows, path, "csv")
    return readers.read_csv(spark, path, rows.schema)


@query("snk3_summary_table", f"""
WITH {PD_SQL} SELECT asset_id, count(*) AS total_records, {snap_sql('avg(price)')} AS avg_price FROM pd GROUP BY 1""")
def snk3(spark, sf):
    path = scratch_path(spark, "summary")
    summary = summaries.asset_summary(pd(spark, sf))
    writers.write_summary(summary, path)
    back = readers.read_csv(spark, path, summary.schema)
    return back.select("asset_id", "total_records", snap("avg_price").alias("avg_price"))


@query("snk4_safe_replace", f"WITH {OBS_SQL} SELECT asset_id, ts, price * 2 AS price FROM obs", as_text=("ts",))
def snk4(spark, sf):
    path = scratch_path(spark, "replaced")
    writers.safe_replace(observed(spark, sf), path)
    writers.safe_replace(spark.read.parquet(path).withColumn("price", F.col("price") * 2), path)
    return spark.read.parquet(path)


@query("snk5_json_lines", "SELECT s_suppkey, s_nationkey, s_name FROM supplier")
def snk5(spark, sf):
    path = scratch_path(spark, "lines")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    writers.write_json_lines(rows, path, ("s_nationkey",))
    return readers.read_jsonl(spark, path, rows.schema)


@query("snk6_forecast_table", f"""
WITH {PD_SQL} SELECT 'naive' AS model_name, asset_id, CAST(1 AS INTEGER) AS horizon_days, max(d) AS feature_date,
  CAST(max(d) + 1 AS DATE) AS prediction_date, arg_max(price, d) AS prediction, arg_max(price, d) AS current_price FROM pd GROUP BY asset_id""",
       as_text=("feature_date", "prediction_date"))
def snk6(spark, sf):
    from seriesloom.operators import forecast

    path = scratch_path(spark, "forecast-table")
    latest = splits.latest_row(pd(spark, sf), ts="d").withColumn("prediction", F.col("price"))
    writers.write_table(forecast.label_forecasts(forecast.request_grid(latest, ["naive"], [1])), path)
    return readers.load_forecasts(spark, path)


# ---- whole passes --------------------------------------------------------------------------

# Assets with fewer than 30 observations, or whose grid is shorter than that, are left out.
_KEPT = PD_SQL + """, kept AS (SELECT * FROM pd
  WHERE asset_id IN (SELECT asset_id FROM obs GROUP BY 1 HAVING count(*) >= 30)
    AND asset_id IN (SELECT asset_id FROM pd GROUP BY 1 HAVING count(*) >= 30))"""


@query("pip1_prepared_summary", f"""
WITH {_KEPT}, f AS (SELECT asset_id, d, price, lead(price) OVER w AS target FROM kept {W})
SELECT asset_id, count(*) AS total_records, CAST(max(d) - min(d) AS INTEGER) AS date_range_days,
  {snap_sql('avg(price)')} AS avg_price, {snap_sql('stddev_samp(price)', 7)} AS price_volatility, 76 AS features_generated
FROM f WHERE target IS NOT NULL GROUP BY 1""")
def pip1(spark, sf):
    s = features_plan.prepare(p(spark, sf), ["tie"]).summary
    return s.select(
        "asset_id", "total_records", "date_range_days", snap("avg_price").alias("avg_price"),
        snap("price_volatility", 7).alias("price_volatility"), "features_generated")


@query("pip1_asset_status", f"""
WITH {_KEPT}, k AS (SELECT asset_id, count(*) AS rows_in FROM p GROUP BY 1), o AS (SELECT asset_id, count(*) - 1 AS n FROM kept GROUP BY 1)
SELECT asset_id, rows_in, coalesce(n, 0) AS rows_out, CASE WHEN coalesce(n, 0) > 0 THEN 'processed' ELSE 'failed' END AS status
FROM k LEFT JOIN o USING (asset_id)""")
def pip1s(spark, sf):
    return features_plan.prepare(p(spark, sf), ["tie"]).status


@query("pip2_clean_only", f"WITH {_KEPT} SELECT asset_id, d, price FROM kept", as_text=("d",))
def pip2(spark, sf):
    return features_plan.clean_only(p(spark, sf), ["tie"]).drop("seq")


@query("pip2_clean_and_check", f"""
WITH {_KEPT} SELECT asset_id, d, price FROM kept WHERE asset_id IN (SELECT asset_id FROM kept GROUP BY 1 HAVING count(price) > 0)""", as_text=("d",))
def pip2_check(spark, sf):
    rows, _ = features_plan.clean_and_check(p(spark, sf), ["tie"], 1500.0, 499000.0)
    return rows.drop("seq")


@query("pip3_combined_dataset", f"""
WITH {PD_SQL}, x AS (SELECT asset_id, d, 'g' || asset_id % 4 AS brand, 'm' || asset_id AS model FROM pd)
SELECT asset_id, d, brand, model, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INTEGER) AS brand_encoded,
  count(*) OVER (PARTITION BY brand) AS brand_frequency,
  CAST(dense_rank() OVER (ORDER BY model) - 1 AS INTEGER) AS model_encoded, count(*) OVER (PARTITION BY model) AS model_frequency FROM x""",
       as_text=("d",))
def pip3(spark, sf):
    named = pd(spark, sf).select(
        "asset_id", "d", F.concat(F.lit("g"), (F.col("asset_id") % 4).cast("string")).alias("brand"),
        F.concat(F.lit("m"), F.col("asset_id").cast("string")).alias("model"))
    return features_plan.combined_dataset(named)


# ---- view tables ---------------------------------------------------------------------------

_NAIVE = f"""{PD_SQL}, last AS (SELECT asset_id, max(d) AS d, arg_max(price, d) AS price FROM pd GROUP BY 1),
fc AS (SELECT asset_id, CAST(h AS INTEGER) AS horizon_days, d AS feature_date, CAST(d + CAST(h AS INTEGER) AS DATE) AS prediction_date,
  price * (1 + h / 71.0::DOUBLE) AS prediction, price AS current_price FROM last, (SELECT unnest(range(1, 8)) AS h))"""


def _naive(spark, sf):
    from seriesloom.operators import forecast

    latest = splits.latest_row(pd(spark, sf), ts="d")
    cells = forecast.request_grid(latest, ["naive"], list(range(1, 8)))
    grown = cells.withColumn("prediction", F.col("price") * (1 + F.col("horizon_days") / F.lit(71.0)))
    return forecast.label_forecasts(grown)


@query("pip7_chart_table", f"""
WITH {_NAIVE} SELECT * FROM (
SELECT asset_id, d AS date, price, 'History' AS horizon FROM pd QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY d DESC) <= 180)
UNION ALL SELECT asset_id, d, price, 'Current' FROM last UNION ALL SELECT asset_id, prediction_date, prediction, 'D' || horizon_days FROM fc""",
       as_text=("date",))
def pip7(spark, sf):
    from seriesloom.plans.dashboard_plan import chart_table

    return chart_table(pd(spark, sf), _naive(spark, sf))


@query("pip7_change_table", f"""
WITH {_NAIVE} SELECT asset_id, horizon_days, {snap_sql('prediction - current_price', 8)} AS delta,
  round((prediction - current_price) / current_price * 100, 6) AS delta_pct,
  format('{{:+.2f}}%', round((prediction - current_price) / current_price * 100, 6)) AS change_pct_text FROM fc""")
def pip7c(spark, sf):
    from seriesloom.plans.dashboard_plan import change_table

    return change_table(_naive(spark, sf)).select(
        "asset_id", "horizon_days", snap("delta", 8).alias("delta"), r("delta_pct", 6).alias("delta_pct"), "change_pct_text")


@query("prj4_display_table", f"""
WITH {_NAIVE} SELECT CASE WHEN asset_id % 2 = 0 THEN 'NATION ' || asset_id ELSE '' || asset_id END AS asset, horizon_days,
  strftime(feature_date, '%Y-%m-%d') AS feature_date, strftime(prediction_date, '%Y-%m-%d') AS prediction_date,
  current_price, prediction AS prediction_price FROM fc""")
def prj4(spark, sf):
    from seriesloom.plans.dashboard_plan import display_table

    brands = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("asset_id"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("brand"))
    return display_table(_naive(spark, sf), brands)
