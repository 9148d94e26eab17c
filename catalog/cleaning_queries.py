"""Cleaning, grids, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    OBS_SQL, P_SQL, PD_SQL, observed, p, pd, query, snap, snap_sql, table,
)
from seriesloom.config import PrepConfig
from seriesloom.operators import cleaning, forecast, grid, splits, summaries, upsert
from seriesloom.operators import quantiles as q

# ---- filters -------------------------------------------------------------------


@query("flt1_positive_price", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def flt1(spark, sf):
    return cleaning.positive_price(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("flt2_outliers_iqr", f"""
WITH {OBS_SQL}, k AS (SELECT asset_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM obs GROUP BY 1)
SELECT asset_id, ts, price FROM obs JOIN k USING (asset_id)
WHERE price BETWEEN q1 - 0.2 * (q3 - q1) AND q3 + 0.2 * (q3 - q1)""", as_text=("ts",))
def flt2(spark, sf):
    return cleaning.outliers_iqr(observed(spark, sf), 0.2)


@query("flt3_outliers_zscore", f"""
WITH {OBS_SQL}, k AS (SELECT asset_id, avg(price) AS m, stddev_pop(price) AS s FROM obs GROUP BY 1)
SELECT asset_id, ts, price FROM obs JOIN k USING (asset_id) WHERE abs((price - m) / nullif(s, 0)) < 1.5""", as_text=("ts",))
def flt3(spark, sf):
    return cleaning.outliers_zscore(observed(spark, sf), 1.5)


@query("flt4_outliers_isolation_forest", as_text=("ts",))
def flt4(spark, sf):
    from seriesloom.operators.isolation import outliers_isolation_forest

    return outliers_isolation_forest(observed(spark, sf))


@query("flt4_isolation_invariants", f"""
WITH {OBS_SQL} SELECT asset_id, count(*) AS n_rows, true AS keeps_ninety_percent, true AS drops_the_soonest
FROM obs GROUP BY 1""")
def flt4_invariants(spark, sf):
    """Per asset: every row is scored, nine tenths stay, and no dropped row is less isolated than a kept one."""
    from seriesloom.operators.isolation import isolation_scores, outliers_isolation_forest

    rows = observed(spark, sf)
    kept = outliers_isolation_forest(rows).select("asset_id", "ts", F.lit(True).alias("kept"))
    scored = isolation_scores(rows).join(kept, ["asset_id", "ts"], "left")
    inside = F.coalesce("kept", F.lit(False))
    facts = scored.groupBy("asset_id").agg(
        F.count("*").alias("n_rows"), F.count_if(inside).alias("n"),
        F.min(F.when(inside, F.col("path"))).alias("low"), F.max(F.when(~inside, F.col("path"))).alias("high"))
    return facts.select(
        "asset_id", "n_rows", (F.col("n") >= F.col("n_rows") * 0.9 - 1).alias("keeps_ninety_percent"),
        F.coalesce(F.col("high") < F.col("low"), F.lit(True)).alias("drops_the_soonest"))


@query("flt5_outliers_off", f"WITH {OBS_SQL} SELECT asset_id, ts, price FROM obs", as_text=("ts",))
def flt5(spark, sf):
    obs = observed(spark, sf)
    for cfg in (
        PrepConfig(remove_outliers=False), PrepConfig(remove_outliers=True, outlier_method=None),
        PrepConfig(remove_outliers=True, outlier_method="none"),
        PrepConfig(remove_outliers=True, outlier_method="other"),
    ):
        obs = cleaning.remove_outliers(obs, cfg)
    return obs


@query("flt6_required_values", """
SELECT o_orderkey, c_acctbal FROM (SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE c_acctbal IS NOT NULL""")
def flt6(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return cleaning.drop_missing(o, "c_acctbal")


@query("flt7_min_observations", f"""
WITH {OBS_SQL} SELECT asset_id, ts, price FROM obs
WHERE asset_id IN (SELECT asset_id FROM obs GROUP BY 1 HAVING count(*) >= 500)""", as_text=("ts",))
def flt7(spark, sf):
    return cleaning.min_observations(observed(spark, sf), 500)


@query("flt8_max_missing_percent", f"""
WITH {P_SQL}, g AS (SELECT asset_id, ts, tie, CASE WHEN price >= 100000 THEN price END AS price FROM p)
SELECT asset_id, ts, tie, price FROM g
WHERE asset_id IN (SELECT asset_id FROM g GROUP BY 1 HAVING avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) * 100 <= 20)""", as_text=("ts",))
def flt8(spark, sf):
    gaps = p(spark, sf).withColumn("price", F.when(F.col("price") >= 100000, F.col("price")))
    return cleaning.max_missing_share(gaps, 20.0).select("asset_id", "ts", "tie", "price")


@query("flt9_asset_membership", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def flt9(spark, sf):
    wanted = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("c_custkey").alias("o_custkey"))
    return cleaning.members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wanted, ["o_custkey"])


@query("flt10_price_range_warnings", f"""
WITH {P_SQL} SELECT asset_id, min(price) AS min_price, max(price) AS max_price, {snap_sql('avg(price)')} AS mean_price,
  count(price) AS n_prices, count(price) > 0 AS valid,
  concat_ws('|', CASE WHEN min(price) < 1500 THEN 'low price' END, CASE WHEN max(price) > 499000 THEN 'high price' END) AS warnings
FROM p GROUP BY 1""")
def flt10(spark, sf):
    out = cleaning.price_range_warnings(p(spark, sf), 1500.0, 499000.0)
    return out.withColumns({"mean_price": snap("mean_price"), "warnings": F.array_join("warnings", "|")})


@query("flt11_required_text", """
SELECT conv_id, turn, trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS text
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  ' || text || E'\\t' WHEN turn % 3 = 1 THEN repeat(' ', CAST(length(text) % 3 AS INTEGER)) || text ELSE text END AS t FROM conversations)
WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 0""")
def flt11(spark, sf):
    c = table(spark, sf, "conversations")
    t = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.col("text"), F.lit("\t")))
        .when(F.col("turn") % 3 == 1, F.concat(F.repeat(F.lit(" "), F.length("text") % 3), F.col("text")))
        .otherwise(F.col("text"))
    )
    return cleaning.required_text(c.select("conv_id", "turn", t.alias("text")), "text")


# ---- dedupe, fills, grids --------------------------------------------------------


@query("win20_first_per_timestamp", f"WITH {OBS_SQL} SELECT asset_id, ts, price FROM obs", as_text=("ts",))
def win20(spark, sf):
    return observed(spark, sf)


@query("win18_latest_row", f"""
WITH {P_SQL} SELECT asset_id, ts, price, tie FROM p
QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, tie DESC) = 1""", as_text=("ts",))
def win18(spark, sf):
    return splits.latest_row(p(spark, sf), tie=["tie"])


@query("jon1_calendar_grid", f"""
WITH {OBS_SQL}, span AS (SELECT asset_id, min(ts) AS lo, max(ts) AS hi FROM obs GROUP BY 1),
cal AS (SELECT asset_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
SELECT cal.asset_id, d, price FROM cal LEFT JOIN obs ON obs.asset_id = cal.asset_id AND ts = d""", as_text=("d",))
def jon1(spark, sf):
    return grid.grid_only(observed(spark, sf).withColumnRenamed("ts", "d"))


@query("win21_linear_fill", f"""
WITH {OBS_SQL}, span AS (SELECT asset_id, min(ts) AS lo, max(ts) AS hi FROM obs GROUP BY 1),
cal AS (SELECT asset_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
j AS (SELECT cal.asset_id, d, price, CASE WHEN price IS NOT NULL THEN d END AS kd FROM cal LEFT JOIN obs ON obs.asset_id = cal.asset_id AND ts = d),
f AS (SELECT asset_id, d, price,
  last_value(price IGNORE NULLS) OVER b AS p0, last_value(kd IGNORE NULLS) OVER b AS d0,
  first_value(price IGNORE NULLS) OVER a AS p1, first_value(kd IGNORE NULLS) OVER a AS d1
  FROM j WINDOW b AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT asset_id, d, coalesce(price, p0 + (p1 - p0) * (d - d0) / (d1 - d0)) AS price FROM f""", as_text=("d",))
def win21(spark, sf):
    return pd(spark, sf).drop("seq")


_FILL = """
WITH {obs}, span AS (SELECT asset_id, min(ts) AS lo, max(ts) AS hi FROM obs GROUP BY 1),
cal AS (SELECT asset_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
j AS (SELECT cal.asset_id, d, price FROM cal LEFT JOIN obs ON obs.asset_id = cal.asset_id AND ts = d)
SELECT asset_id, d, {fn} OVER (PARTITION BY asset_id ORDER BY d ROWS BETWEEN {rows}) AS price FROM j"""


@query("win22_forward_fill", _FILL.format(
    obs=OBS_SQL, fn="last_value(price IGNORE NULLS)", rows="UNBOUNDED PRECEDING AND CURRENT ROW"), as_text=("d",))
def win22f(spark, sf):
    return grid.densify(observed(spark, sf).withColumnRenamed("ts", "d"), method="forward").drop("seq")


@query("win22_back_fill", _FILL.format(
    obs=OBS_SQL, fn="first_value(price IGNORE NULLS)", rows="CURRENT ROW AND UNBOUNDED FOLLOWING"), as_text=("d",))
def win22b(spark, sf):
    return grid.densify(observed(spark, sf).withColumnRenamed("ts", "d"), method="backfill").drop("seq")


_GAPPED = OBS_SQL + """, gapped AS (
  SELECT asset_id, ts, CASE WHEN CAST(floor(price) AS BIGINT) % 3 = 0 THEN price END AS price FROM obs),
g AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS rn FROM gapped),
f AS (SELECT asset_id, ts, price, rn,
  last_value(price IGNORE NULLS) OVER b AS p0, last_value(CASE WHEN price IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS r0,
  first_value(price IGNORE NULLS) OVER a AS p1, first_value(CASE WHEN price IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS r1
  FROM g WINDOW b AS (PARTITION BY asset_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY asset_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _gapped(spark, sf):
    keep = F.floor("price") % 3 == 0
    return observed(spark, sf).withColumn("price", F.when(keep, F.col("price")))


@query("win23_limited_linear_fill", f"""
WITH {_GAPPED}, x AS (SELECT asset_id, ts, CASE WHEN price IS NOT NULL THEN price WHEN rn - r0 <= 2 THEN
  coalesce(p0 + (p1 - p0) * (rn - r0) / nullif(r1 - r0, 0), p0) END AS price FROM f)
SELECT asset_id, ts, {snap_sql('price')} AS price FROM x WHERE price IS NOT NULL""", as_text=("ts",))
def win23l(spark, sf):
    return cleaning.fill_limited(_gapped(spark, sf), "linear", 2).withColumn("price", snap("price"))


@query("win23_limited_forward_fill", f"""
WITH {_GAPPED}, x AS (SELECT asset_id, ts, CASE WHEN price IS NOT NULL THEN price WHEN rn - r0 <= 2 THEN p0 END AS price FROM f)
SELECT * FROM x WHERE price IS NOT NULL""", as_text=("ts",))
def win23f(spark, sf):
    return cleaning.fill_limited(_gapped(spark, sf), "forward", 2)


@query("win23_limited_back_fill", f"""
WITH {_GAPPED}, x AS (SELECT asset_id, ts, CASE WHEN price IS NOT NULL THEN price WHEN r1 - rn <= 2 THEN p1 END AS price FROM f)
SELECT * FROM x WHERE price IS NOT NULL""", as_text=("ts",))
def win23b(spark, sf):
    return cleaning.fill_limited(_gapped(spark, sf), "backfill", 2)


@query("rsm1_daily_last_value", """
SELECT user_id, CAST(ts AS DATE) AS d, arg_max(value, struct_pack(a := ts, b := event_id)) AS value
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""", as_text=("d",))
def rsm1d(spark, sf):
    e = table(spark, sf, "events")
    return grid.resample_last(e, "D", ["event_id"], "user_id", "ts", "value")


@query("rsm1_weekly_last_value", f"""
WITH {P_SQL} SELECT asset_id, CAST(ts + CAST((7 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS d,
  arg_max(price, struct_pack(a := ts, b := tie)) AS price FROM p GROUP BY 1, 2""", as_text=("d",))
def rsm1w(spark, sf):
    return grid.resample_last(p(spark, sf), "W", ["tie"])


# ---- joins -----------------------------------------------------------------------


@query("jon2_aligned_columns", f"""
WITH {PD_SQL}, x AS (SELECT asset_id, d, price, lag(price, 5) OVER w AS price_lag_5, lead(price) OVER w AS target
  FROM pd WINDOW w AS (PARTITION BY asset_id ORDER BY d))
SELECT asset_id, d, coalesce(price_lag_5, 0) AS price_lag_5, price, target FROM x WHERE target IS NOT NULL""", as_text=("d",))
def jon2(spark, sf):
    from seriesloom.operators import features as ft

    g = ft.Grid()
    rows = ft.apply_stages(pd(spark, sf), [ft.lag_stage(g, (5,)), ft.target_stage(g, -1)])
    rows = rows.filter(F.col("target").isNotNull())
    return splits.numeric_features(rows, ["price_lag_5"]).select("asset_id", "d", "price_lag_5", "price", "target")


@query("jon3_brand_lookup", """
SELECT o_orderkey, o_custkey, coalesce(n_name, '') AS nation FROM orders
LEFT JOIN (SELECT c_custkey, min(n_name) AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1) ON o_custkey = c_custkey""")
def jon3(spark, sf):
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey") < 3)
    dim = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return summaries.lookup(orders, dim, "o_custkey", "n_name", "nation").select("o_orderkey", "o_custkey", "nation")


@query("jon4_frequency", "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS brand_frequency FROM part")
def jon4(spark, sf):
    return summaries.add_frequency(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "brand_frequency")


@query("jon5_model_horizon_grid", f"""
WITH {P_SQL}, l AS (SELECT asset_id, ts, price FROM p QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, tie DESC) = 1)
SELECT asset_id, ts, price, model_name, CAST(horizon_days AS INTEGER) AS horizon_days,
  CAST(ts + CAST(horizon_days AS INTEGER) AS DATE) AS prediction_date
FROM l, (VALUES ('ridge'), ('linear')) m(model_name), (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS horizon_days)""", as_text=("ts", "prediction_date"))
def jon5(spark, sf):
    latest = splits.latest_row(p(spark, sf), tie=["tie"]).drop("tie")
    cells = forecast.request_grid(latest, ["ridge", "linear", "ridge"], [7, 6, 5, 4, 3, 2, 1, 1])
    return cells.withColumn("prediction_date", F.date_add("ts", F.col("horizon_days")))


def _requests(spark, sf):
    return table(spark, sf, "supplier").select((F.col("s_nationkey") + F.col("s_suppkey") % 7).cast("int").alias("asset_id"), "s_suppkey")


@query("jon6_batch_request", f"""
WITH {P_SQL}, l AS (SELECT asset_id, ts, price FROM p QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, tie DESC) = 1)
SELECT s_suppkey, asset_id, ts, price FROM (SELECT s_suppkey, CAST(s_nationkey + s_suppkey % 7 AS INTEGER) AS asset_id FROM supplier) JOIN l USING (asset_id)""", as_text=("ts",))
def jon6(spark, sf):
    latest = splits.latest_row(p(spark, sf), tie=["tie"]).drop("tie")
    return forecast.known_requests(_requests(spark, sf), latest)


@query("jon6_unknown_requests", f"""
WITH {P_SQL} SELECT s_suppkey, CAST(asset_id AS INTEGER) AS asset_id FROM (SELECT s_suppkey, s_nationkey + s_suppkey % 7 AS asset_id FROM supplier)
WHERE asset_id NOT IN (SELECT asset_id FROM p)""")
def jon6u(spark, sf):
    return forecast.unknown_requests(_requests(spark, sf), p(spark, sf).select("asset_id").distinct())


@query("jon7_backtest", f"""
WITH {PD_SQL}, f AS (SELECT asset_id, d, price, lead(price, 30) OVER (PARTITION BY asset_id ORDER BY d) AS actual FROM pd)
SELECT asset_id, CAST(d + 30 AS DATE) AS prediction_date, price AS prediction, actual FROM f WHERE day(d) = 1""", as_text=("prediction_date",))
def jon7(spark, sf):
    grid_ = pd(spark, sf).drop("seq")
    made = grid_.filter(F.dayofmonth("d") == 1).select(
        "asset_id", F.date_add("d", 30).alias("prediction_date"), F.col("price").alias("prediction"))
    return forecast.backtest(made, grid_)


@query("jon8_stats_back_join", f"""
WITH {P_SQL} SELECT asset_id, tie, price, {snap_sql('avg(price) OVER (PARTITION BY asset_id)')} AS mean_price,
  max(price) OVER (PARTITION BY asset_id) AS top_price FROM p""")
def jon8(spark, sf):
    rows = p(spark, sf).select("asset_id", "tie", "price")
    stats = rows.groupBy("asset_id").agg(snap(F.avg("price")).alias("mean_price"), F.max("price").alias("top_price"))
    return cleaning.with_asset_stats(rows, stats)


# ---- projections ------------------------------------------------------------------


@query("prj1_feature_columns", """
SELECT c_custkey AS watch_id, c_acctbal AS price FROM customer""")
def prj1(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("watch_id"), F.col("c_acctbal").alias("price"),
        F.col("c_custkey").alias("asset_id"), F.col("c_mktsegment").alias("brand"), F.col("c_name").alias("model"),
        F.col("c_acctbal").alias("target"), F.col("c_acctbal").alias("target_pct_change"), F.lit("x").alias("date"),
    )
    return splits.feature_columns(c)


@query("prj2_leading_columns", """
SELECT o_orderdate AS date, o_totalprice AS price, o_custkey AS watch_id, o_orderstatus AS brand, o_orderpriority AS model, o_orderkey FROM orders""", as_text=("date",))
def prj2(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("brand"),
        F.col("o_custkey").alias("watch_id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date"))
    return splits.leading_columns(o)


@query("prj3_numeric_fill", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS kind, coalesce(CASE WHEN value > 50 THEN value END, 0) AS value FROM events""")
def prj3(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"),
        F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return splits.numeric_features(e, ["k", "kind", "value"])


# ---- sorts, limits, samples, sets --------------------------------------------------


@query("srt1_multi_key_sort", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey""", as_text=("o_orderdate",))
def srt1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(
        "o_custkey", "o_orderdate", "o_orderkey")


@query("srt2_priority_order", """
SELECT c_custkey, c_mktsegment, CAST(coalesce(nullif(list_position(['MACHINERY', 'HOUSEHOLD'], c_mktsegment), 0) - 1, 2) AS INTEGER) AS priority
FROM customer ORDER BY priority, c_mktsegment, c_custkey""")
def srt2(spark, sf):
    from seriesloom.functions import labels

    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    ranked = c.withColumn("priority", labels.priority(F.col("c_mktsegment"), ("MACHINERY", "HOUSEHOLD")))
    return ranked.orderBy("priority", "c_mktsegment", "c_custkey")


@query("lim1_top_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5""")
def lim1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return splits.top_per_group(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 5)


@query("smp1_seeded_sample", """
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500)""")
def smp1(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return splits.seeded_sample(rows, 500, ["o_orderkey"])


@query("set1_union_all", """
SELECT o_orderkey, o_totalprice, 'F' AS part FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice, 'O' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_totalprice, 'P' FROM orders WHERE o_orderstatus = 'P'""")
def set1(spark, sf):
    o = table(spark, sf, "orders")
    parts = [
        o.filter(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice", F.lit(s).alias("part"))
        for s in ("F", "O", "P")
    ]
    return upsert.union_all(parts)


_UPS = P_SQL + """, m AS (SELECT asset_id, ts, arg_max(price, struct_pack(a := tie % 2, b := tie)) AS price FROM p GROUP BY 1, 2)"""


@query("set2_upsert", f"WITH {_UPS} SELECT asset_id, ts, price FROM m", as_text=("ts",))
def set2(spark, sf):
    rows = p(spark, sf)
    return upsert.upsert(rows.filter("tie % 2 = 0"), rows.filter("tie % 2 = 1"), ["tie"])


@query("set2_added_rows", f"""
WITH {_UPS}, e AS (SELECT asset_id, count(DISTINCT ts) AS n FROM p WHERE tie % 2 = 0 GROUP BY 1)
SELECT asset_id, coalesce(e.n, 0) AS existing_rows, k.n AS merged_rows, k.n - coalesce(e.n, 0) AS added_rows
FROM (SELECT asset_id, count(*) AS n FROM m GROUP BY 1) k LEFT JOIN e USING (asset_id)""")
def set2a(spark, sf):
    rows = p(spark, sf)
    old = cleaning.first_per_timestamp(rows.filter("tie % 2 = 0"), ["tie"], keep=["price"])
    merged = upsert.upsert(rows.filter("tie % 2 = 0"), rows.filter("tie % 2 = 1"), ["tie"])
    return upsert.added_rows(old, merged)


@query("set4_distinct_and_sorted", """
SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes,
  array_to_string(list_distinct_first, ',') AS first_types FROM (
  SELECT p_brand, p_size, NULL FROM part) x(p_brand, p_size, z)
  JOIN (SELECT p_brand, list(p_type ORDER BY k) AS list_distinct_first FROM (
    SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2) GROUP BY 1) USING (p_brand)
GROUP BY p_brand, list_distinct_first""")
def set4(spark, sf):
    part = table(spark, sf, "part")
    sizes = summaries.distinct_sorted(part, "p_brand", "p_size").withColumn("sizes", F.array_join("values", ","))
    first = summaries.first_mentions(part, "p_brand", "p_type", "p_partkey").withColumn(
        "first_types", F.array_join("values", ","))
    return sizes.drop("values").join(first.drop("values"), "p_brand")


@query("agg_exact_quantiles", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS q05, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY 1""")
def quant(spark, sf):
    out = q.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return out.select("l_returnflag", *[F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))])
