"""Model fits, scoring and forecasts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import PD_SQL, pd, query, snap, snap_sql, table
from seriesloom.config import FeatureConfig, TrainConfig
from seriesloom.operators import features as ft
from seriesloom.operators import models
from seriesloom.plans import training_plan
from seriesloom.session import materialize, scratch_path

# ---- one-feature fits have closed forms ---------------------------------------------------

_ONE = """c AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
  covar_pop(l_quantity, l_extendedprice) AS cxy, var_pop(l_quantity) AS vx FROM lineitem),"""


def _one_feature(name):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        model = models.fit(name, li, ["l_quantity"], "l_extendedprice", TrainConfig(lasso_alpha=2.0, ridge_alpha=5000.0))
        scored = models.score(model, li)
        return scored.select("l_orderkey", "l_linenumber", snap("prediction", 3).alias("prediction"))

    return run


def _closed(slope: str) -> str:
    return f"""WITH {_ONE} s AS (SELECT mx, my, {slope} AS slope FROM c)
SELECT l_orderkey, l_linenumber, {snap_sql('my + slope * (l_quantity - mx)', 3)} AS prediction FROM lineitem, s"""


query("mdl1_least_squares", _closed("cxy / vx"))(_one_feature("linear"))
query("mdl2_ridge", _closed("cxy * n / (vx * n + 5000)"))(_one_feature("ridge"))
query("mdl3_lasso", _closed("sign(cxy) * greatest(abs(cxy) - 2, 0) / vx"))(_one_feature("lasso"))

# ---- trees on the daily grid ----------------------------------------------------------------

FEATURES = ["price", "price_lag_5", "price_lag_7", "rolling_mean_5", "rolling_std_7", "momentum_5", "day_of_week", "month"]
SMALL = TrainConfig(models=("linear", "ridge"), trees=5, forest_depth=5, boost_depth=4)


def _features(spark, sf):
    cfg = FeatureConfig(lags=(5, 7), rolling_windows=(5, 7), change_periods=(5,))
    g = ft.Grid()
    stages = [
        ft.lag_stage(g, cfg.lags), ft.rolling_stage(g, cfg.rolling_windows, cfg.rolling_stats),
        ft.momentum_stage(g, cfg.change_periods), ft.target_stage(g, -1),
    ]
    wide = ft.add_temporal(ft.apply_stages(pd(spark, sf), stages))
    return materialize(wide.select("asset_id", "d", "target", *FEATURES), "model-features")


def _grid(name):
    def run(spark, sf):
        cfg = replace(SMALL, models=(name,), horizons=(1,))
        out = training_plan.train_grid(_features(spark, sf), FEATURES, cfg, scratch_path(spark, "models"))
        if out.errors:
            raise RuntimeError(out.errors)
        return out.metrics

    return run


query("mdl4_random_forest")(_grid("random_forest"))
query("mdl5_boosted_trees")(_grid("xgboost"))
query("mdl6_leafwise_trees")(_grid("lightgbm"))


@query("mdl7_importance")
def mdl7(spark, sf):
    rows = models.scoring_input(_features(spark, sf), FEATURES).filter(F.col("target").isNotNull())
    forest = models.fit("random_forest", rows, FEATURES, "target", SMALL)
    ridge = models.fit("ridge", rows, FEATURES, "target", SMALL)
    return models.importance(spark, "random_forest", forest).unionByName(models.importance(spark, "ridge", ridge))


@query("mdl8_standardized", f"""
WITH {PD_SQL} SELECT asset_id, d, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 7) + 0 AS price FROM pd""",
       as_text=("d",))
def mdl8(spark, sf):
    return models.standardize(pd(spark, sf).drop("seq"), ["price"]).withColumn("price", F.round("price", 7) + 0)


# ---- fits with closed forms: group means, one feature, a line over the grid -------------------


def _two_valued(name):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
            (F.col("l_linestatus") == "O").cast("double").alias("is_open"))
        cfg = TrainConfig(trees=1, bootstrap=False, learning_rate=1.0, reg_lambda=0.0)
        scored = models.score(models.fit(name, li, ["is_open"], "l_extendedprice", cfg), li)
        return scored.select("l_orderkey", "l_linenumber", "l_partkey", snap("prediction", 3).alias("prediction"))

    return run


_MEANS = f"""SELECT l_orderkey, l_linenumber, l_partkey,
  {snap_sql("avg(l_extendedprice) OVER (PARTITION BY l_linestatus = 'O')", 3)} AS prediction FROM lineitem"""
query("mdl4_one_tree", _MEANS)(_two_valued("random_forest"))
query("mdl5_one_round", _MEANS)(_two_valued("xgboost"))
query("mdl6_one_round", _MEANS)(_two_valued("lightgbm"))


_FEATS = ("l_quantity", "l_linenumber", "percent")


def _grown_sql(leaves: int, l2: float, l1: float, rate: float, least: int) -> str:
    """One tree, split by split, best leaf first, from its sums by leaf, feature and value."""
    def drawn(g):
        return f"(sign({g}) * greatest(abs({g}) - {l1!r}::DOUBLE, 0))"

    steps = ["""r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, round(l_discount * 100) AS percent FROM lineitem),
s0 AS (SELECT *, avg(l_extendedprice) OVER () AS base, avg(l_extendedprice) OVER () - l_extendedprice AS g, 0 AS leaf FROM r)"""]
    for k in range(1, leaves):
        long = " UNION ALL ".join(f"SELECT leaf, {i} AS f, CAST({c} AS DOUBLE) AS v, g FROM s{k - 1}" for i, c in enumerate(_FEATS))
        value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_FEATS))
        steps.append(f"""h{k} AS (SELECT leaf, f, v, sum(g) AS g, count(*) AS n FROM ({long}) GROUP BY ALL),
c{k} AS (SELECT leaf, f, v, sum(g) OVER u AS lg, sum(n) OVER u AS ln, sum(g) OVER a AS tg, sum(n) OVER a AS tn FROM h{k}
  WINDOW u AS (PARTITION BY leaf, f ORDER BY v), a AS (PARTITION BY leaf, f)),
b{k} AS (SELECT leaf AS hit, f, v FROM c{k} WHERE ln >= {least} AND tn - ln >= {least}
  ORDER BY {drawn('lg')} ^ 2 / (ln + {l2!r}) + {drawn('(tg - lg)')} ^ 2 / (tn - ln + {l2!r}) - {drawn('tg')} ^ 2 / (tn + {l2!r}) DESC, leaf, f, v LIMIT 1),
s{k} AS (SELECT s.* EXCLUDE leaf, CASE WHEN leaf <> hit THEN leaf WHEN (CASE f {value} END) <= v THEN {2 * k - 1} ELSE {2 * k} END AS leaf
  FROM s{k - 1} s, b{k})""")
    weight = f"{drawn('sum(g) OVER (PARTITION BY leaf)')} / (count(*) OVER (PARTITION BY leaf) + {l2!r}::DOUBLE)"
    return f"""WITH {", ".join(steps)}
SELECT l_orderkey, l_linenumber, l_partkey, {snap_sql(f'base - {rate!r}::DOUBLE * {weight}', 3)} AS prediction FROM s{leaves - 1}"""


def _grown(name, cfg):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
            F.round(F.col("l_discount") * 100).alias("percent"))
        scored = models.score(models.fit(name, li, list(_FEATS), "l_extendedprice", cfg), li)
        return scored.select("l_orderkey", "l_linenumber", "l_partkey", snap("prediction", 3).alias("prediction"))

    return run


query("mdl5_penalised_split", _grown_sql(2, 5000.0, 1e6, 0.1, 1))(
    _grown("xgboost", TrainConfig(trees=1, boost_depth=1, reg_lambda=5000.0, reg_alpha=1e6)))
query("mdl6_leafwise_tree", _grown_sql(6, 0.0, 0.0, 0.1, 20))(_grown("lightgbm", TrainConfig(trees=1, leaves=6)))


@query("mdl7_coefficients", f"""WITH {_ONE} k AS (SELECT cxy / vx AS slope FROM c)
SELECT 'linear' AS model, 'l_quantity' AS feature, round(abs(slope), 5) AS importance FROM k""")
def mdl7_coefficients(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = models.fit("linear", li, ["l_quantity"], "l_extendedprice")
    return models.importance(spark, "linear", model).withColumn("importance", F.round("importance", 5))


@query("mdl7_parameters", """SELECT * FROM (VALUES ('lasso', 'elasticNetParam', '1.0'), ('lasso', 'labelCol', 'l_extendedprice'),
  ('lasso', 'maxIter', '1000'), ('lasso', 'regParam', '1.0'), ('lasso', 'standardization', 'False')) t(model, parameter, value)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def mdl7_parameters(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    report = models.parameters(spark, "lasso", models.fit("lasso", li, ["l_quantity"], "l_extendedprice"))
    return report.filter(F.col("parameter").isin("elasticNetParam", "labelCol", "maxIter", "regParam", "standardization"))


HORIZONS = (1, 2, 3, 4, 5, 6, 7)
LINE = TrainConfig(horizons=HORIZONS, models=("linear",))
_LINE = PD_SQL + ", t AS (" + " UNION ALL ".join(
    f"SELECT {h} AS h, asset_id, d, price, lead(price, {h}) OVER (PARTITION BY asset_id ORDER BY d) AS y FROM pd" for h in HORIZONS
) + f"""), n AS (SELECT *, row_number() OVER (PARTITION BY h, asset_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY h, asset_id) AS n
  FROM t WHERE y IS NOT NULL),
sp AS (SELECT *, CASE WHEN i < floor(n * {1 - 0.2 - 0.1!r}::DOUBLE) THEN 'train' WHEN i < floor(n * {1 - 0.2!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM n WHERE n >= 20 AND floor(n * {1 - 0.2 - 0.1!r}::DOUBLE) > 0),
ab AS (SELECT h, regr_slope(y, price) AS b, regr_intercept(y, price) AS a FROM sp WHERE split = 'train' GROUP BY 1),
last AS (SELECT asset_id, d, price FROM pd QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY d DESC) = 1),
fc AS (SELECT 'linear' AS model_name, asset_id, CAST(h AS INTEGER) AS horizon_days, d AS feature_date, CAST(d + CAST(h AS INTEGER) AS DATE) AS prediction_date,
  round(a + b * price, 3) AS prediction, price AS current_price FROM last, ab)"""
_DATES = ("feature_date", "prediction_date")


def _line(spark, sf):
    rows = pd(spark, sf).select("asset_id", "d", "price")
    where = scratch_path(spark, "models")
    out = training_plan.train_grid(rows, ["price"], LINE, where)
    if out.errors:
        raise RuntimeError(out.errors)
    return rows, where, out


@query("pip4_line_metrics", f"""WITH {_LINE}, e AS (SELECT h, y - a - b * price AS r FROM sp JOIN ab USING (h) WHERE split = 'test')
SELECT CAST(h AS INTEGER) AS horizon, 'linear' AS model, 'rmse' AS metric, round(sqrt(avg(r * r)), 3) AS value FROM e GROUP BY h
UNION ALL SELECT CAST(h AS INTEGER), 'linear', 'mae', round(avg(abs(r)), 3) FROM e GROUP BY h""")
def pip4_line(spark, sf):
    _, _, out = _line(spark, sf)
    return out.metrics.filter(F.col("metric").isin("rmse", "mae")).withColumn("value", F.round("value", 3))


@query("pip5_line_forecasts", f"WITH {_LINE} SELECT * FROM fc", as_text=_DATES)
def pip5_line(spark, sf):
    rows, where, _ = _line(spark, sf)
    made = training_plan.forecast_latest(rows, where, ["linear"], list(HORIZONS), ["price"])
    return made.withColumn("prediction", F.round("prediction", 3))


@query("pip6_line_forecasts_of_assets", f"WITH {_LINE} SELECT * FROM fc WHERE asset_id IN (SELECT s_nationkey FROM supplier) AND horizon_days IN (2, 7)", as_text=_DATES)
def pip6_line(spark, sf):
    rows, where, _ = _line(spark, sf)
    wanted = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("asset_id")).distinct()
    made = training_plan.forecast_latest(rows, where, ["linear"], [7, 2], ["price"], assets=wanted)
    return made.withColumn("prediction", F.round("prediction", 3))


@query("mdl10_forecast_one", f"WITH {_LINE} SELECT * FROM fc WHERE asset_id = 3 AND horizon_days = 7", as_text=_DATES)
def mdl10(spark, sf):
    rows, where, _ = _line(spark, sf)
    made = training_plan.forecast_one(rows, 3, 7, "linear", model_dir=where, features=["price"])
    return made.withColumn("prediction", F.round("prediction", 3))


@query("pip4_training_grid")
def pip4(spark, sf):
    out = training_plan.train_grid(_features(spark, sf), FEATURES, SMALL, scratch_path(spark, "models"))
    if out.errors:
        raise RuntimeError(out.errors)
    return out.metrics


@query("pip5_forward_forecasts")
def pip5(spark, sf):
    rows = _features(spark, sf)
    where = scratch_path(spark, "models")
    training_plan.train_grid(rows, FEATURES, replace(SMALL, models=("ridge",)), where)
    return training_plan.forecast_latest(rows, where, ["ridge"], list(SMALL.horizons), FEATURES)


@query("pip6_batch_forecasts")
def pip6(spark, sf):
    rows = _features(spark, sf)
    where = scratch_path(spark, "models")
    training_plan.train_grid(rows, FEATURES, replace(SMALL, models=("linear",), horizons=(7,)), where)
    wanted = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("asset_id")).distinct()
    return training_plan.forecast_latest(rows, where, ["linear"], [7], FEATURES, assets=wanted)
