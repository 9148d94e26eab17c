"""Forecast models as ``pyspark.ml`` pipelines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.config import TrainConfig
from seriesloom.operators.boosting import BoostConfig, Task, fit_many
from seriesloom.operators.gram import fit_linear_many
from seriesloom.operators.splits import numeric_features
from seriesloom.operators.summaries import label_codes
from seriesloom.session import scratch_path


def _label_scale(train: DataFrame, label: str) -> tuple[float, int]:
    row = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
    return float(row["s"] or 0.0), int(row["n"])


def _linear(train: DataFrame, label: str, cfg: TrainConfig) -> Estimator:
    return LinearRegression(labelCol=label, regParam=0.0, solver="normal")


def _ridge(train: DataFrame, label: str, cfg: TrainConfig) -> Estimator:
    """Penalty on raw features: the library divides by the label's deviation and the row count."""
    s, n = _label_scale(train, label)
    return LinearRegression(
        labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal",
        regParam=cfg.ridge_alpha * s / max(n, 1),
    )


def _lasso(train: DataFrame, label: str, cfg: TrainConfig) -> Estimator:
    return LinearRegression(
        labelCol=label, elasticNetParam=1.0, standardization=False,
        regParam=cfg.lasso_alpha, maxIter=1000, tol=1e-12,
    )


def _forest(train: DataFrame, label: str, cfg: TrainConfig) -> Estimator:
    return RandomForestRegressor(
        labelCol=label, numTrees=cfg.trees, featureSubsetStrategy="sqrt",
        maxDepth=cfg.forest_depth, seed=cfg.seed, bootstrap=cfg.bootstrap,
    )


BUILDERS: dict[str, Callable[[DataFrame, str, TrainConfig], Estimator]] = {
    "linear": _linear,
    "ridge": _ridge,
    "lasso": _lasso,
    "random_forest": _forest,
}
WITH_VALIDATION = ("xgboost", "lightgbm")
#: Models that all horizons share the passes of.
TOGETHER = ("linear", "ridge", *WITH_VALIDATION)


def build(name: str, train: DataFrame, label: str, cfg: TrainConfig = TrainConfig()) -> Estimator:
    if name not in BUILDERS:
        raise ValueError(f"unknown model {name!r}; have {sorted([*BUILDERS, *WITH_VALIDATION])}")
    return BUILDERS[name](train, label, cfg)


def boost_settings(name: str, cfg: TrainConfig) -> BoostConfig:
    """Level by level under penalties for ``xgboost``, best leaf first for ``lightgbm``."""
    common = {
        "trees": cfg.trees, "learning_rate": cfg.learning_rate, "patience": cfg.patience, "seed": cfg.seed,
        "rows": cfg.subsample, "columns": cfg.colsample,
    }
    if name == "xgboost":
        return BoostConfig(depth=cfg.boost_depth, l2=cfg.reg_lambda, l1=cfg.reg_alpha, **common)
    return BoostConfig(
        depth=cfg.leafwise_depth, leaves=cfg.leaves, l2=cfg.leafwise_lambda, least_rows=cfg.leafwise_least_rows,
        importance="split", **common,
    )


def _encoder(rows: DataFrame, column: str, folder: str) -> SQLTransformer:
    """A stage that joins the written codes of ``column``, one table per fit."""
    path = f"{folder.rstrip('/')}/{column}-{uuid.uuid4().hex}"
    label_codes(rows, column).select(F.col(column).alias("value"), "code").write.parquet(path)
    return SQLTransformer(statement=(
        f"SELECT __THIS__.*, coalesce(c.code, -1) AS `{column}_code` FROM __THIS__ "
        f"LEFT JOIN parquet.`{path}` c ON __THIS__.`{column}` = c.value"
    ))


def fit(
    name: str, df: DataFrame, features: list[str], label: str, cfg: TrainConfig = TrainConfig(),
    categorical: tuple[str, ...] = (), split: str = "split", codes: str | None = None,
) -> PipelineModel:
    """Fit on the train rows; boosted models also watch the val rows.

    Encoders and the feature list are part of the returned model, so scoring
    re-uses them and fails on a missing column. The codes of a categorical column are
    a table, written to the folder ``codes`` beside the model and joined when scoring;
    missing and unseen texts are -1.
    """
    rows = df.filter(F.col(label).isNotNull())
    if split in df.columns:
        if name in WITH_VALIDATION:
            rows = rows.filter(F.col(split).isin("train", "val"))
        else:
            rows = rows.filter(F.col(split) == "train")
    stages, inputs = _input_stages(rows, features, categorical, codes)
    if name not in WITH_VALIDATION:
        return Pipeline(stages=[*stages, build(name, rows, label, cfg)]).fit(rows)
    ready = PipelineModel(stages)
    task = Task(label, split if split in df.columns else None)
    return PipelineModel([*stages, fit_many(ready.transform(rows), inputs, [task], boost_settings(name, cfg))[0]])


def _input_stages(
    rows: DataFrame, features: list[str], categorical: tuple[str, ...], codes: str | None,
) -> tuple[list, list[str]]:
    """Encoders fitted on ``rows`` and the assembler; and the names of the columns that models see."""
    encoders = [_encoder(rows, c, codes or scratch_path(rows.sparkSession, "codes")) for c in categorical]
    inputs = [f for f in features if f not in categorical] + [f"{c}_code" for c in categorical]
    return [*encoders, VectorAssembler(inputCols=inputs, outputCol="features")], inputs


def fit_together(
    name: str, df: DataFrame, features: list[str], tasks: list[Task], cfg: TrainConfig = TrainConfig(),
    categorical: tuple[str, ...] = (), codes: str | None = None,
) -> list[PipelineModel]:
    """``fit`` of one of ``TOGETHER`` for several labels, each with a split of its own, in shared passes.

    Codes of categorical columns come from all rows that some label trains on.
    """
    some = [F.col(t.label).isNotNull() & (F.col(t.split) == "train") for t in tasks]
    stages, inputs = _input_stages(df.filter(F.greatest(*[c.cast("int") for c in some]) == 1) if len(some) > 1
                                   else df.filter(some[0]), features, categorical, codes)
    ready = PipelineModel(stages).transform(df)
    if name in WITH_VALIDATION:
        made = fit_many(ready, inputs, tasks, boost_settings(name, cfg))
    else:
        made = [m[0] for m in fit_linear_many(ready, inputs, tasks, [cfg.ridge_alpha if name == "ridge" else 0.0])]
    return [PipelineModel([*stages, m]) for m in made]


def scoring_input(df: DataFrame, features: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    """Numeric, null-free features, identical for training and scoring."""
    return numeric_features(df, [f for f in features if f not in categorical])


def score(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    scored = model.transform(df).withColumn("_p", F.col("prediction"))
    return scored.select(*df.columns, F.col("_p").alias(out))


def feature_inputs(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def importance(spark: SparkSession, name: str, model: PipelineModel) -> DataFrame:
    """(model, feature, importance): |coefficient| or impurity share, one row per feature."""
    last = model.stages[-1]
    weights = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(name, f, abs(float(v))) for f, v in zip(feature_inputs(model), weights.toArray())]
    if name == "lasso":
        rows = [r for r in rows if r[2] > 0]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def parameters(spark: SparkSession, name: str, model: PipelineModel) -> DataFrame:
    """(model, parameter, value): the fitted stage's settings."""
    last = model.stages[-1]
    rows = [(name, p.name, str(v)) for p, v in sorted(last.extractParamMap().items(), key=lambda x: x[0].name)]
    return spark.createDataFrame(rows, "model string, parameter string, value string")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; one scalar subquery carries the constants.

    A column without deviation is only centred.
    """
    row = df.agg(F.struct(*[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))
    ])).scalar()
    return df.withColumns({
        c: (F.col(c) - row[f"m_{c}"]) / F.when(row[f"s_{c}"] == 0, F.lit(1.0)).otherwise(row[f"s_{c}"])
        for c in columns
    })
