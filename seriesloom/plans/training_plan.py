"""Train and evaluate models over horizons; forecast from a saved registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.config import TrainConfig
from seriesloom.operators import features as feat
from seriesloom.operators import forecast, metrics, models, splits
from seriesloom.session import materialize
from seriesloom.sources import readers, writers


@dataclass
class Trained:
    metrics: DataFrame
    errors: list[tuple[int, str, str]] = field(default_factory=list)
    saved: list[str] = field(default_factory=list)


def train_grid(
    df: DataFrame, features: list[str], cfg: TrainConfig, model_dir: str,
    g: feat.Grid = feat.Grid(), categorical: tuple[str, ...] = (),
) -> Trained:
    """Fit every model for every horizon, save it, and score it on the test rows.

    Targets and splits of all horizons come from one pass over the asset windows and
    are written once, so a lost executor never repeats the feature windows. With
    ``cfg.max_samples``, at most so many labelled train rows of a horizon are fitted on;
    validation and test rows are never sampled; without it, linear and boosted models of
    all horizons are fitted in shared passes. A failing model is recorded and the grid
    goes on.
    """
    spark = df.sparkSession
    out = Trained(metrics=spark.createDataFrame([], "horizon int, model string, metric string, value double"))
    parts: list[DataFrame] = []
    every = splits.horizon_splits(df, cfg.horizons, cfg.split, g)
    every = models.scoring_input(every, features, categorical)
    named = [c for h in cfg.horizons for c in (feat.target_name(h), splits.split_name(h))]
    every = materialize(every.select(g.asset, g.day, *named, *features), "splits")
    codes = f"{model_dir.rstrip('/')}/_codes"
    together: dict[str, dict] = {}
    if cfg.max_samples is None:
        tasks = [models.Task(feat.target_name(h), splits.split_name(h)) for h in cfg.horizons]
        for name in cfg.models:
            if name in models.TOGETHER:
                try:
                    made = models.fit_together(name, every, features, tasks, cfg, categorical, codes)
                    together[name] = dict(zip(cfg.horizons, made))
                except Exception:  # noqa: BLE001 - each horizon is then tried, and named, by itself
                    continue
    for h in cfg.horizons:
        label = feat.target_name(h)
        rows = every.filter(F.col(splits.split_name(h)).isNotNull()).select(
            g.asset, g.day, label, F.col(splits.split_name(h)).alias("split"), *features
        )
        if cfg.max_samples is not None:
            train = splits.seeded_sample(
                rows.filter(F.col("split") == "train"), cfg.max_samples, [g.asset, g.day], cfg.seed
            )
            rows = train.unionByName(rows.filter(F.col("split") != "train"))
        for name in cfg.models:
            try:
                model = together[name][h] if name in together else models.fit(
                    name, rows, features, label, cfg, categorical, codes=codes
                )
                out.saved.append(writers.save_model(model, model_dir, name, h))
                scored = models.score(model, rows.filter(F.col("split") == "test"), "y_pred")
                wide = metrics.all_metrics(
                    scored.select(
                        g.asset, g.day, F.col(label).alias("y_true"), "y_pred",
                        F.lit(h).alias("horizon"), F.lit(name).alias("model"),
                    ),
                    ["horizon", "model"], g.asset, g.day,
                )
                # Nine figures per fit.
                figures = metrics.long_metrics(wide, ["horizon", "model"]).collect()
                parts.append(spark.createDataFrame(figures, out.metrics.schema))
            except Exception as e:  # noqa: BLE001 - one model must not stop the grid
                out.errors.append((h, name, f"{type(e).__name__}: {e}"))
    for p in parts:
        out.metrics = out.metrics.unionByName(p)
    return out


def forecast_latest(
    df: DataFrame, model_dir: str, model_names: list[str], horizons: list[int], features: list[str],
    g: feat.Grid = feat.Grid(), categorical: tuple[str, ...] = (), assets: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of the newest row per asset for each resolvable model and horizon.

    ``assets`` limits the work to the named assets before anything is scored.
    """
    spark = df.sparkSession
    rows = df if assets is None else df.join(assets.select(g.asset), g.asset, "left_semi")
    latest = splits.latest_row(rows, g.asset, g.day)
    # Written once: every model and horizon is a branch over it.
    latest = materialize(models.scoring_input(latest, features, categorical), "latest")
    names = readers.registry_names(spark, model_dir)
    out: DataFrame | None = None
    for name in dict.fromkeys(model_names):
        for h in sorted(set(horizons)):
            found = _resolve(names, name, h, len(set(horizons)) > 1)
            if found is None:
                continue
            model = writers.load_model(spark, model_dir, found)
            missing = [c for c in models.feature_inputs(model)
                       if c not in latest.columns and c.removesuffix("_code") not in latest.columns]
            if missing:
                raise ValueError(f"model {found!r} expects missing features: {missing}")
            scored = models.score(model, latest).withColumns({
                "model_name": F.lit(name), "horizon_days": F.lit(h),
            })
            part = forecast.label_forecasts(scored, g.asset, g.day, g.price)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no model for {model_names} at horizons {horizons} in {model_dir}")
    return out


def _resolve(names: list[str], model: str, horizon: int, many: bool) -> str | None:
    """The registry rule for one request over the saved folder names."""
    wanted = [f"{model}__h{horizon}", f"{model}_h{horizon}"] + ([] if many else [model])
    return next((w for w in wanted if w in names), None)


def forecast_one(df: DataFrame, asset, horizon: int = 7, model: str = "lightgbm", **kw) -> DataFrame:
    """Forecast of one asset; an unknown asset or horizon out of range is an error."""
    if not 1 <= horizon <= 30:
        raise ValueError("horizon must be between 1 and 30")
    g = kw.get("g", feat.Grid())
    rows = df.filter(F.col(g.asset) == F.lit(asset))
    if rows.limit(1).count() == 0:
        raise ValueError(f"unknown asset {asset!r}")
    return forecast_latest(rows, model_names=[model], horizons=[horizon], **kw)


def error_rows(spark: SparkSession, trained: Trained) -> DataFrame:
    return spark.createDataFrame(trained.errors, "horizon int, model string, error string")
