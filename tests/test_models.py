"""Linear fits against closed forms, the registry rule, the training grid."""

import datetime as dt

import numpy as np
import pytest

from seriesloom.config import TrainConfig
from seriesloom.operators import features as ft
from seriesloom.operators import forecast, metrics, models, splits
from seriesloom.plans import training_plan
from seriesloom.sources import writers


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, [1, 10, 100], (400, 3))
    y = 3 + x @ np.array([2.0, -0.5, 0.03]) + rng.normal(0, 1, 400)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, label double").cache()


def fitted(df, name, **cfg):
    return models.fit(name, df, ["a", "b", "c"], "label", TrainConfig(**cfg)).stages[-1]


def test_least_squares(data):
    x, y, df = data
    design = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    m = fitted(df, "linear")
    np.testing.assert_allclose([m.intercept, *m.coefficients], want, rtol=1e-8)


@pytest.mark.parametrize("alpha", [1.0, 50.0, 5000.0])
def test_ridge(data, alpha):
    x, y, df = data
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    m = fitted(df, "ridge", ridge_alpha=alpha)
    np.testing.assert_allclose(m.coefficients, want, rtol=1e-7)
    np.testing.assert_allclose(m.intercept, y.mean() - x.mean(0) @ want, rtol=1e-7)


def test_lasso(data):
    x, y, df = data
    xc, yc, n, alpha = x - x.mean(0), y - y.mean(), len(y), 1.0
    w = np.zeros(3)
    for _ in range(5000):  # coordinate descent
        for j in range(3):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (xc[:, j] @ xc[:, j] / n)
    np.testing.assert_allclose(fitted(df, "lasso", lasso_alpha=alpha).coefficients, w, atol=1e-6)


def test_unknown_model(data):
    with pytest.raises(ValueError):
        models.build("nope", data[2], "label")


def test_missing_feature_fails(data):
    model = models.fit("linear", data[2], ["a", "b", "c"], "label")
    with pytest.raises(Exception):
        models.score(model, data[2].drop("b")).count()


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(9)
    rows = [
        (a, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v), f"w{a}")
        for a in ("p", "q", "r") for i, v in enumerate(500 + np.cumsum(rng.normal(0, 3, 200)))
    ]
    df = spark.createDataFrame(rows, "asset_id string, d date, price double, watch_id string")
    g = ft.Grid()
    return ft.apply_stages(df, [ft.lag_stage(g, (5,)), ft.target_stage(g, -1)]).cache()


FEATURES = ["price", "price_lag_5", "watch_id"]


def test_grid_trains_saves_scores_and_records_failures(spark, series, tmp_path):
    cfg = TrainConfig(horizons=(1, 3), models=("ridge", "broken"))
    out = training_plan.train_grid(series, FEATURES, cfg, str(tmp_path), categorical=("watch_id",))
    assert [(h, m) for h, m, _ in out.errors] == [(1, "broken"), (3, "broken")]
    assert training_plan.error_rows(spark, out).count() == 2
    assert {r["metric"] for r in out.metrics.collect()} == set(metrics.METRIC_NAMES)
    made = training_plan.forecast_latest(
        series, str(tmp_path), ["ridge", "absent"], [1, 3, 9], FEATURES, categorical=("watch_id",))
    rows = made.collect()
    assert len(rows) == 6 and {r["feature_date"] for r in rows} == {dt.date(2024, 7, 18)}
    assert {(r["prediction_date"] - r["feature_date"]).days for r in rows} == {1, 3}
    assert all(abs(r["prediction"] / r["current_price"] - 1) < 0.2 for r in rows)
    one = training_plan.forecast_one(
        series, "q", 3, "ridge", model_dir=str(tmp_path), features=FEATURES, categorical=("watch_id",))
    assert [r["asset_id"] for r in one.collect()] == ["q"]
    with pytest.raises(ValueError, match="unknown asset"):
        training_plan.forecast_one(series, "zz", 3, "ridge", model_dir=str(tmp_path), features=FEATURES)
    with pytest.raises(ValueError, match="between"):
        training_plan.forecast_one(series, "q", 31, "ridge", model_dir=str(tmp_path), features=FEATURES)


def test_resolution_prefers_specific_and_blocks_generic_for_many(spark):
    registry = spark.createDataFrame([("m__h1",), ("m_h1",), ("m_h2",), ("m",)], "name string")
    req = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "model_name string, horizon_days int")
    many = {r["horizon_days"]: r["resolved"] for r in forecast.resolve_models(req, registry, True).collect()}
    assert many == {1: "m__h1", 2: "m_h2"}
    single = {r["horizon_days"]: r["resolved"] for r in forecast.resolve_models(req, registry, False).collect()}
    assert single == {1: "m__h1", 2: "m_h2", 3: "m"}
    names = ["m__h1", "m_h1", "m_h2", "m"]
    for many_flag, want in ((True, many), (False, single)):
        for h in (1, 2, 3):
            assert training_plan._resolve(names, "m", h, many_flag) == want.get(h)


def test_importance_and_parameters(spark, data):
    m = models.fit("lasso", data[2], ["a", "b", "c"], "label", TrainConfig(lasso_alpha=2.5))
    assert {r["feature"] for r in models.importance(spark, "lasso", m).collect()} < {"a", "b", "c"}
    m = models.fit("random_forest", data[2], ["a", "b", "c"], "label", TrainConfig(trees=3, forest_depth=3))
    total = sum(r["importance"] for r in models.importance(spark, "random_forest", m).collect())
    assert abs(total - 1) < 1e-9
    assert "numTrees" in {r["parameter"] for r in models.parameters(spark, "random_forest", m).collect()}


def test_metrics_edges(spark):
    rows = [("m", 1.0, 1.0), ("m", 2.0, None), ("m", float("nan"), 1.0), ("k", 3.0, 4.0), ("k", 3.0, 2.0), ("z", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, y_true double, y_pred double")
    got = {r["model"]: r for r in metrics.regression_metrics(df, ["model"]).collect()}
    assert set(got) == {"m", "k"} and got["m"]["n"] == 1 and got["k"]["r2"] == 0.0
    report = {r["model"]: r for r in metrics.prediction_report(df, ["model"]).collect()}
    assert report["z"]["issues"] == ["True values contain 1 NaN values", "No valid prediction pairs found"]
    assert not report["z"]["valid"]


def test_best_model_needs_every_model(spark):
    rows = [(1, "a", "rmse", 2.0), (1, "b", "rmse", 1.0), (1, "a", "mae", 1.0), (1, "a", "r2", 0.2), (1, "b", "r2", float("nan"))]
    long = spark.createDataFrame(rows, "horizon int, model string, metric string, value double")
    got = {r["metric"]: r["label"] for r in metrics.best_models(long, ["horizon"]).collect()}
    assert got == {"rmse": "b (1.0000)", "r2": "a (0.2000)"}


def test_feature_names_and_numeric_fill(spark):
    df = spark.createDataFrame([("x", None, True, 2.0, 3.0)], "watch_id string, n int, flag boolean, target double, target_h3 double")
    assert splits.feature_names(df.columns) == ["watch_id", "n", "flag"]
    row = splits.numeric_features(df, ["watch_id", "n", "flag"]).first()
    assert (row["watch_id"], row["n"], row["flag"]) == (0.0, 0.0, 1.0)


def test_metrics_document(spark, tmp_path):
    rows = [(1, "a", "rmse", 2.0), (1, "a", "mae", 1.0), (2, "a", "rmse", 4.0)]
    long = spark.createDataFrame(rows, "horizon int, model string, metric string, value double")
    writers.write_documents(metrics.metrics_documents(long), str(tmp_path / "doc"))
    texts = [r[0] for r in spark.read.text(str(tmp_path / "doc")).collect()]
    assert any(t.startswith('{"horizon_1d": ') for t in texts) and len(texts) == 2
