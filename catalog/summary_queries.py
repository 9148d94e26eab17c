"""Summaries, validation, metrics, encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import P_SQL, PD_SQL, W, full, p, pd, query, r, snap, snap_sql, table
from seriesloom import config as C
from seriesloom.functions import labels
from seriesloom.operators import features as ft
from seriesloom.operators import metrics, summaries, validation
from seriesloom.plans import collection_plan, features_plan

_TIER = """CASE WHEN {x} >= 0 AND {x} < 5000 THEN 'entry' WHEN {x} >= 5000 AND {x} < 20000 THEN 'mid'
  WHEN {x} >= 20000 AND {x} < 100000 THEN 'high' WHEN {x} >= 100000 THEN 'ultra' ELSE 'unknown' END"""


@query("agg1_asset_summary", f"""
WITH {PD_SQL} SELECT asset_id, count(*) AS total_records, CAST(max(d) - min(d) AS INTEGER) AS date_range_days,
  {snap_sql('avg(price)')} AS avg_price, {snap_sql('stddev_samp(price)', 7)} AS price_volatility,
  {_TIER.format(x='avg(price)')} AS luxury_tier, least(1.0, count(*) / 365.0::DOUBLE) AS data_quality_score,
  4 AS features_generated FROM pd GROUP BY 1""")
def agg1(spark, sf):
    out = summaries.asset_summary(pd(spark, sf))
    return out.withColumns({"avg_price": snap("avg_price"), "price_volatility": snap("price_volatility", 7)})


@query("agg2_combined_summary", f"""
WITH {PD_SQL} SELECT asset_id, count(*) AS total_records, CAST(max(d) - min(d) AS INTEGER) AS date_range_days,
  {snap_sql('avg(price)')} AS avg_price, {snap_sql('stddev_samp(price)', 7)} AS price_volatility,
  {_TIER.format(x='avg(price)')} AS luxury_tier FROM pd GROUP BY 1""")
def agg2(spark, sf):
    out = summaries.combined_summary(pd(spark, sf))
    return out.withColumns({"avg_price": snap("avg_price"), "price_volatility": snap("price_volatility", 7)})


# ---- forecast quality --------------------------------------------------------------

F_SQL = PD_SQL + f""", r7 AS (SELECT asset_id, d, price, {full('avg(price)', 7)} AS m7, {full('avg(price)', 14)} AS m14 FROM pd),
f AS (SELECT asset_id, d, 1 AS horizon, 'mean_7' AS model, price AS y_true, m7 AS y_pred FROM r7
      UNION ALL SELECT asset_id, d, 1, 'mean_14', price, m14 FROM r7)"""


def fviews(spark, sf):
    rolled = ft.apply_stages(pd(spark, sf), [ft.rolling_stage(ft.Grid(), (7, 14), ("mean",))])
    cells = F.explode(F.array(
        F.struct(F.lit("mean_7").alias("model"), F.col("rolling_mean_7").alias("y_pred")),
        F.struct(F.lit("mean_14").alias("model"), F.col("rolling_mean_14").alias("y_pred")),
    ))
    return rolled.select("asset_id", "d", F.lit(1).alias("horizon"), F.col("price").alias("y_true"), cells.alias("c")).select(
        "asset_id", "d", "horizon", "c.model", "y_true", "c.y_pred")


_METRICS = """m AS (SELECT horizon, model, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
  avg((y_true - y_pred) * (y_true - y_pred)) AS mse, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) AS r2,
  avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100 AS mape,
  avg(y_true - y_pred) AS mean_residual, stddev_pop(y_true - y_pred) AS std_residual, max(abs(y_true - y_pred)) AS max_error
  FROM f WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1, 2)"""
_DIGITS = {"mae": 4, "mse": 0, "rmse": 4, "r2": 8, "mape": 6, "mean_residual": 4, "std_residual": 4, "max_error": 4}


@query("agg3_regression_metrics", f"""
WITH {F_SQL}, {_METRICS} SELECT horizon, model, n, {', '.join(f'round({c}, {n}) AS {c}' for c, n in _DIGITS.items())} FROM m""")
def agg3(spark, sf):
    out = metrics.regression_metrics(fviews(spark, sf), ["horizon", "model"])
    return out.select("horizon", "model", "n", *[r(c, n).alias(c) for c, n in _DIGITS.items()])


@query("agg4_directional_accuracy", f"""
WITH {F_SQL}, s AS (SELECT horizon, model, y_true - lag(y_true) OVER k AS dy, y_pred - lag(y_pred) OVER k AS dp
  FROM f WHERE y_pred IS NOT NULL WINDOW k AS (PARTITION BY horizon, model, asset_id ORDER BY d))
SELECT horizon, model, round(avg(CASE WHEN (dy > 0) = (dp > 0) THEN 1.0 ELSE 0.0 END) * 100, 3) AS directional_accuracy
FROM s WHERE dy IS NOT NULL GROUP BY 1, 2""")
def agg4(spark, sf):
    out = metrics.directional_accuracy(fviews(spark, sf), ["horizon", "model"])
    return out.withColumn("directional_accuracy", r("directional_accuracy", 3))


@query("agg5_best_models", f"""
WITH {F_SQL}, {_METRICS}, l AS (UNPIVOT (SELECT horizon, model, rmse, mae, r2, mape FROM m) ON rmse, mae, r2, mape INTO NAME metric VALUE v)
SELECT horizon, metric, CASE WHEN metric = 'r2' THEN arg_max(model, v) ELSE arg_min(model, v) END AS model,
  round(CASE WHEN metric = 'r2' THEN max(v) ELSE min(v) END, 5) AS value FROM l GROUP BY 1, 2""")
def agg5(spark, sf):
    wide = metrics.regression_metrics(fviews(spark, sf), ["horizon", "model"])
    best = metrics.best_models(metrics.long_metrics(wide, ["horizon", "model"]), ["horizon"])
    return best.select("horizon", "metric", "model", r("value", 5).alias("value"))


@query("agg6_prediction_report", f"""
WITH {F_SQL} SELECT horizon, model, count(*) AS n_samples, count(y_pred) AS n_valid, 0::BIGINT AS n_missing_true,
  count(*) - count(y_pred) AS n_missing_pred, 0::BIGINT AS n_inf_true, 0::BIGINT AS n_inf_pred, count(y_pred) > 0 AS valid,
  'Predictions contain ' || (count(*) - count(y_pred)) || ' NaN values' AS issues FROM f GROUP BY 1, 2""")
def agg6(spark, sf):
    out = metrics.prediction_report(fviews(spark, sf), ["horizon", "model"])
    return out.withColumn("issues", F.array_join("issues", "|"))


@query("agg7_feature_report", f"""
WITH {PD_SQL}, x AS (SELECT price, lag(price, 7) OVER w AS price_lag_7, lead(price) OVER w AS target FROM pd {W})
SELECT count(*) AS n_samples, min(target) AS target_min, max(target) AS target_max,
  count(*) - count(price_lag_7) AS missing_features, count(*) - count(target) AS missing_target, 2 AS n_features,
  'double:2' AS feature_types, count(*) = count(target) AS valid,
  'Features have ' || (count(*) - count(price_lag_7)) || ' missing values|Target has ' || (count(*) - count(target)) || ' missing values' AS warnings
FROM x""")
def agg7(spark, sf):
    g = ft.Grid()
    rows = ft.apply_stages(pd(spark, sf), [ft.lag_stage(g, (7,)), ft.target_stage(g, -1)])
    out = summaries.feature_report(rows, "target", ["price", "price_lag_7"])
    kinds = F.transform(F.map_entries("feature_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumns({"feature_types": F.array_join(kinds, "|"), "warnings": F.array_join("warnings", "|")})


# ---- counts --------------------------------------------------------------------------


@query("agg8_distinct_assets", f"WITH {P_SQL} SELECT DISTINCT asset_id FROM p ORDER BY 1")
def agg8(spark, sf):
    return summaries.distinct_values(p(spark, sf), "asset_id")


@query("agg9_coverage", "SELECT p_brand, count(*) AS found, 100 AS target, count(*) / 100.0::DOUBLE * 100 AS percent FROM part GROUP BY 1")
def agg9(spark, sf):
    return summaries.coverage(table(spark, sf, "part"), "p_brand", 100)


@query("agg10_collection_outcome", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) AS total,
  count(*) FILTER (WHERE event_type = 'error') AS failed,
  round(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS percent FROM events GROUP BY 1""")
def agg10(spark, sf):
    out = summaries.outcome_counts(table(spark, sf, "events"), F.col("event_type") != "error", ["user_id"])
    return out.withColumn("percent", r("percent", 6))


def _verdicts(spark, sf):
    """Orders in key order as an ingest log: are a customer's orders dated in order?"""
    o = table(spark, sf, "orders")
    checked = validation.order_check(o, "o_custkey", "o_orderdate", "o_orderkey", block=1000)
    return validation.verdicts(checked, 2)


_V = """chk AS (SELECT o_custkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders),
v AS (SELECT o_custkey, count(*) AS row_count, 0::BIGINT AS missing, count(*) FILTER (WHERE back) AS steps_back,
  count(*) FILTER (WHERE back) = 0 AS ordered FROM chk GROUP BY 1),
vd AS (SELECT *, row_count >= 2 AND ordered AS is_valid, NOT ordered AS has_date_issues,
  nullif(concat_ws('; ', CASE WHEN row_count < 2 THEN 'Insufficient rows: ' || row_count || ' < 2' END,
                   CASE WHEN NOT ordered THEN 'Date ordering issue' END), '') AS error_message FROM v)"""


@query("agg11_validation_summary", f"""
WITH {_V} SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalid,
  0::BIGINT AS errors, count(*) FILTER (WHERE NOT is_valid AND has_date_issues) AS date_issues,
  count(*) FILTER (WHERE NOT is_valid) - count(*) FILTER (WHERE NOT is_valid AND has_date_issues) AS insufficient,
  round(count(*) FILTER (WHERE is_valid) * 100.0::DOUBLE / count(*), 6) AS percent FROM vd""")
def agg11(spark, sf):
    return validation.verdict_summary(_verdicts(spark, sf)).withColumn("percent", r("percent", 6))


@query("agg12_health", """
SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_assets, (SELECT count(DISTINCT p_type) FROM part) AS n_models, 'healthy' AS status""")
def agg12(spark, sf):
    return summaries.health(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "part"), "p_type")


@query("agg13_extraction_summary", f"""
WITH {P_SQL} SELECT asset_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, min(price) AS min_price, max(price) AS max_price FROM p GROUP BY 1""", as_text=("first_ts", "last_ts"))
def agg13(spark, sf):
    return summaries.extraction_summary(p(spark, sf), ["asset_id"])


@query("agg14_outcome_totals", f"""
WITH {PD_SQL}, k AS (SELECT asset_id, count(*) AS n FROM obs GROUP BY 1)
SELECT count(*) AS raw, count(*) FILTER (WHERE n >= 500) AS processed, count(*) FILTER (WHERE n < 500) AS failed FROM k""")
def agg14(spark, sf):
    raw = p(spark, sf)
    dense = features_plan.daily_prices(raw, ["tie"], C.PrepConfig(min_points=500))
    return features_plan.outcome_totals(features_plan.outcomes(raw, dense))


@query("agg15_order_check", f"WITH {_V} SELECT * FROM v")
def agg15(spark, sf):
    return validation.order_check(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", block=1000)


@query("agg15_order_check_events", """
WITH c AS (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
SELECT user_id, count(*) AS row_count, 0::BIGINT AS missing, count(*) FILTER (WHERE back) AS steps_back,
  count(*) FILTER (WHERE back) = 0 AS ordered FROM c GROUP BY 1""")
def agg15e(spark, sf):
    return validation.order_check(table(spark, sf, "events"), "user_id", "ts", "event_id", block=1000)


@query("agg16_verdicts", f"WITH {_V} SELECT o_custkey, row_count, is_valid, has_date_issues, error_message FROM vd")
def agg16(spark, sf):
    return _verdicts(spark, sf).select("o_custkey", "row_count", "is_valid", "has_date_issues", "error_message")


def _collected(spark, sf):
    """Orders of each nation as a collected file: in date order, in key order, cut short, header only, no text."""
    from seriesloom.session import scratch_path
    from seriesloom.sources import readers

    path = scratch_path(spark, "collected")
    rows = p(spark, sf).withColumn("kind", F.col("asset_id") % 5)
    at = F.row_number().over(Window.partitionBy("asset_id").orderBy("ts", "tie"))
    body = rows.withColumn("at", at).filter((F.col("kind") != 3) & ((F.col("kind") != 2) | (F.col("at") <= 3))).select(
        "asset_id", F.when(F.col("kind") == 1, F.col("tie")).otherwise(F.col("at")).alias("k"),
        F.when((F.col("kind") == 4) & (F.col("at") == 2), F.unhex(F.lit("FF2C31")).cast("string"))
        .otherwise(F.concat_ws(",", F.col("ts").cast("string"), F.col("price").cast("string"))).alias("value"))
    header = rows.select("asset_id", F.lit(-1).cast("bigint").alias("k"), F.lit("date,price(SGD)").alias("value")).distinct()
    lines = body.unionByName(header).repartition("asset_id").sortWithinPartitions("asset_id", "k")
    lines.select("asset_id", "value").write.partitionBy("asset_id").text(path)
    checked = validation.file_check(readers.read_for_check(spark, path, "*.txt"))
    folder = F.regexp_extract("file", "asset_id=([0-9]+)", 1).cast("int")
    return validation.verdicts(checked, 30).withColumn("asset_id", folder).drop("file")


_FILES = P_SQL + """, st AS (SELECT asset_id, ts < lag(ts) OVER (PARTITION BY asset_id ORDER BY tie) AS back FROM p),
n AS (SELECT asset_id, asset_id % 5 AS kind, count(*) AS n, count(*) FILTER (WHERE back) AS backs FROM st GROUP BY 1),
fl AS (SELECT asset_id, CASE WHEN kind >= 3 THEN 0 WHEN kind = 2 THEN least(n, 3) ELSE n END AS row_count,
  kind <> 1 OR backs = 0 AS ordered, kind FROM n),
fv AS (SELECT asset_id, row_count, kind < 3 AND ordered AND row_count >= 30 AS is_valid, kind = 4 AS is_error, NOT ordered AS has_date_issues,
  CASE kind WHEN 4 THEN 'Error reading file: not UTF-8 text' WHEN 3 THEN 'Empty or header-only file' ELSE
    nullif(concat_ws('; ', CASE WHEN row_count < 30 THEN 'Insufficient rows: ' || row_count || ' < 30' END,
                     CASE WHEN NOT ordered THEN 'Date ordering issue' END), '') END AS error_message FROM fl)"""


@query("agg16_file_verdicts", f"WITH {_FILES} SELECT * FROM fv")
def agg16_files(spark, sf):
    return _collected(spark, sf).select(
        "asset_id", "row_count", "is_valid", "is_error", "has_date_issues", "error_message")


@query("agg11_file_summary", f"""
WITH {_FILES} SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid,
  count(*) FILTER (WHERE NOT is_valid AND NOT is_error) AS invalid, count(*) FILTER (WHERE is_error) AS errors,
  count(*) FILTER (WHERE has_date_issues) AS date_issues,
  count(*) FILTER (WHERE NOT is_valid AND NOT is_error AND NOT has_date_issues) AS insufficient,
  round(count(*) FILTER (WHERE is_valid) * 100.0::DOUBLE / count(*), 6) AS percent FROM fv""")
def agg11_files(spark, sf):
    return validation.verdict_summary(_collected(spark, sf)).withColumn("percent", r("percent", 6))


@query("snk9_report_headings", f"""
WITH {_FILES}, c AS (SELECT CASE WHEN is_valid THEN 'VALID FILES' WHEN is_error THEN 'ERROR FILES' ELSE 'INVALID FILES' END AS category FROM fv),
h AS (SELECT unnest(['VALID FILES', 'INVALID FILES', 'ERROR FILES']) AS category)
SELECT category, count(c.category) AS n, category || ' (' || count(c.category) || '):' AS line FROM h LEFT JOIN c USING (category) GROUP BY category""")
def snk9_headings(spark, sf):
    return validation.report_headings(_collected(spark, sf))


@query("snk8_quarantine_counts", f"""
WITH {_V} SELECT CASE WHEN is_valid THEN 'kept' ELSE error_message END AS fate, count(*) AS n_rows
FROM orders JOIN vd USING (o_custkey) GROUP BY 1""")
def snk8(spark, sf):
    o = table(spark, sf, "orders")
    good, bad = validation.split_quarantine(o, _verdicts(spark, sf), "o_custkey")
    fates = good.select(F.lit("kept").alias("fate")).unionByName(bad.select(F.col("reason").alias("fate")))
    return fates.groupBy("fate").agg(F.count("*").alias("n_rows"))


@query("snk9_validation_report", f"""
WITH {_V} SELECT CASE WHEN is_valid THEN 'VALID FILES' ELSE 'INVALID FILES' END AS category, o_custkey AS file,
  CASE WHEN is_valid THEN o_custkey || ' (' || row_count || ' rows)' ELSE o_custkey || ': ' || error_message END AS line
FROM vd ORDER BY 1, 2""")
def snk9(spark, sf):
    return validation.report_lines(_verdicts(spark, sf), "o_custkey").orderBy("category", "file")


# ---- encodings, formatting -------------------------------------------------------------


@query("mth6_label_codes", """
SELECT event_id, CASE WHEN value > 20 THEN event_type END AS kind,
  CAST(CASE WHEN value > 20 THEN dense_rank() OVER (PARTITION BY value > 20 ORDER BY event_type) - 1 ELSE -1 END AS INTEGER) AS kind_code FROM events""")
def mth6(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 20, F.col("event_type")).alias("kind"))
    return summaries.encode_labels(e, "kind", "kind_code")


@query("mth6_label_codes_wide", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS name_code FROM customer""")
def mth6w(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return summaries.encode_labels(c, "c_name", "name_code").select("c_custkey", "name_code")


@query("mth7_frequency_encoding", """
SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS model_frequency, count(*) OVER (PARTITION BY p_type) AS type_frequency FROM part""")
def mth7(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    out = summaries.add_frequency(part, "p_name", "model_frequency")
    return summaries.add_frequency(out, "p_type", "type_frequency").drop("p_name", "p_type")


@query("mth5_forecast_delta", f"""
WITH {F_SQL} SELECT asset_id, d, model, {snap_sql('y_pred - y_true')} AS delta,
  round((y_pred - y_true) / nullif(y_true, 0) * 100, 6) AS delta_pct FROM f""", as_text=("d",))
def mth5(spark, sf):
    diff, pct = labels.delta(F.col("y_pred"), F.col("y_true"))
    return fviews(spark, sf).select("asset_id", "d", "model", snap(diff).alias("delta"), r(pct, 6).alias("delta_pct"))


@query("str10_metric_text", f"""
WITH {F_SQL}, {_METRICS}, l AS (UNPIVOT (SELECT horizon, model, round(rmse, 1) AS rmse, round(mae, 1) AS mae, round(mape, 1) AS mape FROM m)
  ON rmse, mae, mape INTO NAME metric VALUE value)
SELECT horizon, model, metric, CASE WHEN metric = 'mape' THEN format('{{:.2f}}%', value) ELSE format('{{:.4f}}', value) END AS text FROM l""")
def str10(spark, sf):
    wide = metrics.regression_metrics(fviews(spark, sf), ["horizon", "model"])
    long = metrics.long_metrics(wide.select("horizon", "model", *[r(c, 1).alias(c) for c in ("rmse", "mae", "mape")]), ["horizon", "model"])
    return metrics.formatted(long).drop("value")


_IN_DOCUMENT = ("mae", "mse", "rmse", "mape")


@query("snk7_metrics_documents", f"""
WITH {F_SQL}, {_METRICS}
SELECT 'horizon_' || horizon || 'd' AS key, model, {', '.join(f'round({c}, 3) AS {c}' for c in _IN_DOCUMENT)}, NULL AS error FROM m
UNION ALL SELECT 'horizon_1d', 'broken', {', '.join('NULL' for _ in _IN_DOCUMENT)}, 'did not end'""")
def snk7(spark, sf):
    """Written as documents, read back as text: every figure, and a failed run."""
    from seriesloom.session import scratch_path
    from seriesloom.sources import writers

    wide = metrics.regression_metrics(fviews(spark, sf), ["horizon", "model"])
    failed = wide.select("horizon", F.lit("broken").alias("model"), F.lit("did not end").alias("error")).distinct()
    docs = metrics.metrics_documents(metrics.long_metrics(wide, ["horizon", "model"]), failed)
    path = scratch_path(spark, "metrics")
    writers.write_documents(docs, path)
    whole = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "document"))
    models = whole.select("key", F.explode(F.from_json("document", "map<string,string>")).alias("model", "doc"))
    figures = [r(F.get_json_object("doc", f"$.{c}").cast("double"), 3).alias(c) for c in _IN_DOCUMENT]
    return models.select("key", "model", *figures, F.get_json_object("doc", "$.error").alias("error"))


@query("pip8_recollect_list", f"""
WITH {_V} SELECT 'Brand-' || o_custkey || '.csv' AS file, 'Brand' AS brand, 'Unknown' AS model, CAST(o_custkey AS VARCHAR) AS watch_id,
  error_message AS issue, row_count FROM vd WHERE NOT is_valid""")
def pip8(spark, sf):
    o = table(spark, sf, "orders").withColumn("file", F.concat(F.lit("Brand-"), F.col("o_custkey").cast("string"), F.lit(".csv")))
    v, _, _ = collection_plan.check_series(o, "file", "o_orderdate", "o_orderkey", 2)
    return collection_plan.recollect_list(v, "file")
