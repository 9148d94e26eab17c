"""Boosted trees and shared linear fits against plain versions."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from seriesloom.config import TrainConfig
from seriesloom.operators import gram, models
from seriesloom.operators.boosting import BoostConfig, Task, fit_many
from seriesloom.sources import writers
from test_models import FEATURES, data, series  # noqa: F401


def made(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 9, n), rng.normal(0, 1, n).round(1)]).astype(float)
    y = 5 * np.sin(x[:, 0] / 4) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, n)
    part = np.where(np.arange(n) % 4 == 3, "val", "train")
    return x, y, part


def table(spark, x, y, part):
    rows = [(*map(float, r), float(v), str(p)) for r, v, p in zip(x, y, part)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, split string").repartition(3).cache()


def plain_tree(x, g, cfg):
    """{leaf: rows} by trying every split of every leaf, the best first."""
    def shrunk(v):
        return np.sign(v) * max(abs(v) - cfg.l1, 0)

    def score(rows):
        return shrunk(g[rows].sum()) ** 2 / (len(rows) + cfg.l2)

    leaves = [(np.arange(len(x)), 0)]
    most = cfg.leaves or 2**cfg.depth
    while len(leaves) < most:
        best = (1e-6, None)
        for i, (rows, depth) in enumerate(leaves):
            if cfg.depth is not None and depth >= cfg.depth:
                continue
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < cfg.least_rows:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (i, a, b, depth + 1))
        if best[1] is None:
            break
        i, a, b, depth = best[1]
        leaves[i:i + 1] = [(a, depth), (b, depth)]
    return {i: (rows, -shrunk(g[rows].sum()) / (len(rows) + cfg.l2)) for i, (rows, _) in enumerate(leaves)}


@pytest.mark.parametrize("cfg", [
    BoostConfig(trees=1, depth=None, leaves=9, l2=0.0, least_rows=20),
    BoostConfig(trees=1, depth=3, l2=7.0, l1=2.0),
    BoostConfig(trees=1, depth=4, leaves=6, l2=1.0, least_rows=5),
])
def test_one_tree_equals_trying_every_split(spark, cfg):
    x, y, part = made()
    df = table(spark, x, y, np.full(len(y), "train"))
    model = fit_many(df, ["a", "b", "c"], [Task("y")], cfg)[0]
    want = np.full(len(y), y.mean())
    for rows, value in plain_tree(x, y.mean() - y, cfg).values():
        want[rows] += cfg.learning_rate * value
    got = scored(model, df)
    keys = [tuple(map(float, r)) for r in np.column_stack([x, y])]
    np.testing.assert_allclose([got[k] for k in keys], want, rtol=1e-9)


def scored(model, df):
    from pyspark.ml.feature import VectorAssembler

    rows = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)).collect()
    return {(r["a"], r["b"], r["c"], r["y"]): r["prediction"] for r in rows}


def errors(model, df, x, y, part):
    got = scored(model, df)
    miss = np.array([got[tuple(map(float, r))] for r in np.column_stack([x, y])]) - y
    return np.sqrt((miss[part == "val"] ** 2).mean())


def test_leaves_beat_levels_and_both_stop(spark):
    """Best leaf first does no worse than level by level; patience keeps the trees of the least error."""
    x, y, part = made()
    df = table(spark, x, y, part)
    leafwise, levels = (
        fit_many(df, ["a", "b", "c"], [Task("y", "split")], cfg)[0]
        for cfg in (BoostConfig(trees=14, depth=None, leaves=31, l2=0.0, least_rows=5, learning_rate=0.4, patience=2),
                    BoostConfig(trees=14, depth=5, l2=0.0, least_rows=5, learning_rate=0.4, patience=2))
    )
    assert errors(leafwise, df, x, y, part) <= 1.05 * errors(levels, df, x, y, part)
    assert 0 < leafwise.numTrees <= 14
    noise = np.random.default_rng(3).normal(0, 1, len(y))
    hopeless = fit_many(table(spark, x, noise, part), ["a", "b", "c"], [Task("y", "split")],
                        BoostConfig(trees=14, depth=5, learning_rate=1.0, patience=2))[0]
    assert hopeless.numTrees <= 2


def test_samples_of_rows_and_columns(spark):
    x, y, part = made()
    df = table(spark, x, y, part)
    cfg = BoostConfig(trees=3, depth=2, rows=0.5, columns=0.34)
    one, other = (fit_many(df.repartition(n), ["a", "b", "c"], [Task("y")], cfg)[0] for n in (1, 5))
    assert [[r[:5] for r in t["inner"]] for t in json_trees(one)] == [[r[:5] for r in t["inner"]] for t in json_trees(other)]
    for tree in one._read()["trees"]:
        assert len({row[1] for row in tree["inner"]}) == 1


def test_tasks_together_equal_tasks_alone(spark):
    x, y, part = made(400)
    df = table(spark, x, y, part)
    cfg = BoostConfig(trees=12, depth=2, patience=None)
    both = fit_many(df, ["a", "b"], [Task("y", "split"), Task("c", "split")], cfg)
    for model, label in zip(both, ("y", "c")):
        alone = fit_many(df, ["a", "b"], [Task(label, "split")], cfg)[0]
        a, b = (json_trees(m) for m in (model, alone))
        assert [[r[:5] for r in t["inner"]] for t in a] == [[r[:5] for r in t["inner"]] for t in b]


def json_trees(model):
    return model._read()["trees"]


def test_odd_labels_and_settings(spark):
    x, y, part = made(60)
    df = table(spark, x, y, part)
    empty = fit_many(df.limit(0), ["a"], [Task("y", "split")], BoostConfig(trees=2))[0]
    assert empty.numTrees == 0
    flat = df.selectExpr("a", "1.0D AS b", "1.0D AS c", "5.0D AS y", "split")
    model = fit_many(flat, ["a", "b"], [Task("y", "split")], BoostConfig(trees=2))[0]
    assert model.numTrees == 0 and model._read()["base"] == 5.0
    with pytest.raises(ValueError):
        BoostConfig(depth=None)
    with pytest.raises(ValueError):
        BoostConfig(bins=999)


def test_saved_models_score_the_same(spark, tmp_path):
    x, y, part = made(300)
    df = table(spark, x, y, part)
    cfg = TrainConfig(trees=4, leaves=5)
    for name in ("lightgbm", "xgboost"):
        model = models.fit(name, df, ["a", "b", "c"], "y", cfg)
        path = writers.save_model(model, str(tmp_path), name, 1)
        again = PipelineModel.load(path)
        a = models.score(model, df).orderBy("a", "b", "c", "y").toPandas()
        b = models.score(again, df).orderBy("a", "b", "c", "y").toPandas()
        np.testing.assert_array_equal(a.prediction, b.prediction)
        shares = [r["importance"] for r in models.importance(spark, name, again).collect()]
        assert len(shares) == 3 and abs(sum(shares) - 1) < 1e-9


def test_linear_fits_of_many_labels_equal_single_fits(spark, series):  # noqa: F811
    from seriesloom.operators import features as ft
    from seriesloom.operators import splits

    cfg = TrainConfig(horizons=(1, 2, 3), ridge_alpha=50.0)
    every = splits.horizon_splits(series, cfg.horizons, cfg.split, ft.Grid())
    every = models.scoring_input(every, ["price", "price_lag_5"]).cache()
    tasks = [Task(ft.target_name(h), splits.split_name(h)) for h in cfg.horizons]
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    together = {name: models.fit_together(name, every, ["price", "price_lag_5"], tasks, cfg) for name in ("linear", "ridge")}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert jobs <= 12  # however many labels there are
    for name, made_models in together.items():
        for h, model in zip(cfg.horizons, made_models):
            rows = every.withColumn("split", every[splits.split_name(h)])
            alone = models.fit(name, rows, ["price", "price_lag_5"], ft.target_name(h), cfg).stages[-1]
            np.testing.assert_allclose(model.stages[-1].coefficients, alone.coefficients, rtol=1e-7)
            np.testing.assert_allclose(model.stages[-1].intercept, alone.intercept, rtol=1e-6)


def test_moments_of_large_values_with_little_spread(spark):
    rng = np.random.default_rng(2)
    x = 1e7 + rng.normal(0, 1, (500, 2))
    y = 1e6 + x @ np.array([0.5, -2.0]) + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    model = gram.fit_linear_many(df, ["a", "b"], [Task("y")], [0.0])[0][0]
    xc, yc = x - x.mean(0), y - y.mean()
    np.testing.assert_allclose(model.coefficients, np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-6)
