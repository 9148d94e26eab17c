"""Forecast quality as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import labels

# ---- Fixed values ------------------------------------------------------------
EPSILON = 2.220446049250313e-16
COMPARED = {"rmse": "min", "mae": "min", "r2": "max", "mape": "min"}
MISSING_TRUE = "True values contain %d NaN values"
MISSING_PREDICTED = "Predictions contain %d NaN values"
NO_PAIRS = "No valid prediction pairs found"
INFINITE_TRUE = "True values contain infinite values"
INFINITE_PREDICTED = "Predictions contain infinite values"
# ------------------------------------------------------------------------------


def _pairs(df: DataFrame, y: str, yhat: str) -> DataFrame:
    known = F.col(y).isNotNull() & F.col(yhat).isNotNull() & ~F.isnan(y) & ~F.isnan(yhat)
    return df.filter(known)


def regression_metrics(
    df: DataFrame, by: list[str], y: str = "y_true", yhat: str = "y_pred"
) -> DataFrame:
    """One row per group; every figure is a mergeable aggregate of one scan."""
    e = F.col(y) - F.col(yhat)
    pairs = _pairs(df, y, yhat).withColumns({"_e": e, "_a": F.abs(e)})
    relative = F.col("_a") / F.greatest(F.abs(F.col(y)), F.lit(EPSILON))
    agg = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("_a").alias("mae"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        (F.avg(relative) * 100).alias("mape"),
        F.avg("_e").alias("mean_residual"),
        F.stddev_pop("_e").alias("std_residual"),
        F.max("_a").alias("max_error"),
        F.var_pop(y).alias("_var"),
    )
    # A constant truth scores 1 when predicted perfectly and 0 otherwise.
    r2 = F.when(F.col("_var") > 0, 1 - F.try_divide(F.col("mse"), F.col("_var"))).otherwise(
        F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return agg.withColumns({
        "rmse": F.sqrt("mse"), "r2": F.when(F.col("n") >= 2, r2),
    }).drop("_var")


def directional_accuracy(
    df: DataFrame, by: list[str], asset: str = "asset_id", ts: str = "d",
    y: str = "y_true", yhat: str = "y_pred",
) -> DataFrame:
    """Percent of consecutive steps, inside an asset, whose direction agrees."""
    w = Window.partitionBy(*by, asset).orderBy(ts)
    steps = _pairs(df, y, yhat).withColumns({
        "_dy": F.col(y) - F.lag(y).over(w), "_dp": F.col(yhat) - F.lag(yhat).over(w),
    })
    same = ((F.col("_dy") > 0) == (F.col("_dp") > 0)).cast("double")
    return steps.filter(F.col("_dy").isNotNull()).groupBy(*by).agg(
        (F.avg(same) * 100).alias("directional_accuracy")
    )


def all_metrics(
    df: DataFrame, by: list[str], asset: str = "asset_id", ts: str = "d",
    y: str = "y_true", yhat: str = "y_pred",
) -> DataFrame:
    """Regression metrics plus directional accuracy (NULL below two rows)."""
    base = regression_metrics(df, by, y, yhat)
    direction = directional_accuracy(df, by, asset, ts, y, yhat)
    return base.join(direction, by, "left")


METRIC_NAMES = (
    "mae", "mse", "rmse", "r2", "mape", "mean_residual", "std_residual", "max_error",
    "directional_accuracy",
)


def long_metrics(wide: DataFrame, by: list[str]) -> DataFrame:
    """(by…, metric, value), missing figures left out."""
    names = [m for m in METRIC_NAMES if m in wide.columns]
    return wide.unpivot(by, names, "metric", "value").filter(F.col("value").isNotNull())


def metrics_documents(long: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One JSON document per horizon: model -> metric -> value.

    ``errors`` holds (horizon, model, error) of failed runs: they get model -> error.
    """
    per_model = long.groupBy("horizon", "model").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("metrics")
    )
    if errors is not None:
        failed = errors.groupBy("horizon", "model").agg(F.min("error").alias("error"))
        per_model = per_model.unionByName(failed.select(
            "horizon", "model", F.to_json(F.struct("error")).alias("metrics")
        ))
    entry = F.transform(
        F.array_sort(F.collect_list(F.struct("model", "metrics"))),
        lambda m: F.concat(F.lit('"'), F.replace(m["model"], F.lit('"'), F.lit('\\"')), F.lit('": '), m["metrics"]),
    )
    return per_model.groupBy("horizon").agg(
        F.concat(F.lit("{"), F.array_join(entry, ", "), F.lit("}")).alias("document")
    ).withColumn("key", F.concat(F.lit("horizon_"), F.col("horizon").cast("string"), F.lit("d")))


def best_models(long: DataFrame, by: list[str]) -> DataFrame:
    """Best model per group and compared metric, when every model has the metric."""
    models = long.groupBy(*by).agg(F.countDistinct("model").alias("_models"))
    value = F.when(~F.isnan("value"), F.col("value"))
    score = F.when(F.col("metric") == "r2", -value).otherwise(value)
    rank = F.when(score.isNotNull(), F.struct(score.alias("s"), F.col("model")))
    picked = long.filter(F.col("metric").isin(*COMPARED)).groupBy(*by, "metric").agg(
        F.countDistinct("model").alias("_have"),
        F.min_by(F.struct("model", "value"), rank).alias("_best"),
    )
    best = picked.join(models, by).filter(
        (F.col("_have") == F.col("_models")) & F.col("_best").isNotNull()
    )
    text = F.format_string("%s (%.4f)", F.col("_best.model"), F.col("_best.value"))
    return best.select(
        *by, "metric", F.col("_best.model").alias("model"), F.col("_best.value").alias("value"),
        text.alias("label"),
    )


def prediction_report(
    df: DataFrame, by: list[str], y: str = "y_true", yhat: str = "y_pred"
) -> DataFrame:
    """Row counts, missing and infinite counts, and the issues they raise."""

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    def infinite(c: str) -> Column:
        return F.abs(F.col(c)) == float("inf")

    agg = df.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.count_if(~missing(y) & ~missing(yhat)).alias("n_valid"),
        F.count_if(missing(y)).alias("n_missing_true"),
        F.count_if(missing(yhat)).alias("n_missing_pred"),
        F.count_if(F.coalesce(infinite(y), F.lit(False))).alias("n_inf_true"),
        F.count_if(F.coalesce(infinite(yhat), F.lit(False))).alias("n_inf_pred"),
    )

    issues = F.array_compact(F.array(
        F.when(F.col("n_missing_true") > 0, F.format_string(MISSING_TRUE, "n_missing_true")),
        F.when(F.col("n_missing_pred") > 0, F.format_string(MISSING_PREDICTED, "n_missing_pred")),
        F.when(F.col("n_valid") == 0, F.lit(NO_PAIRS)),
        F.when(F.col("n_inf_true") > 0, F.lit(INFINITE_TRUE)),
        F.when(F.col("n_inf_pred") > 0, F.lit(INFINITE_PREDICTED)),
    ))
    return agg.withColumns({"valid": F.col("n_valid") > 0, "issues": issues})


def formatted(long: DataFrame) -> DataFrame:
    return long.withColumn("text", labels.metric_text(F.col("metric"), F.col("value")))
