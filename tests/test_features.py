"""Feature families against pandas, and their edge rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import config as C
from seriesloom.config import FeatureConfig
from seriesloom.operators import features as ft
from seriesloom.operators import grid

START = dt.date(2024, 1, 1)
SCHEMA = "asset_id string, d date, price double"


def frame(spark, series):
    rows = [
        (a, START + dt.timedelta(days=i), None if v is None else float(v))
        for a, values in series.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def collect(df, asset, col):
    rows = df.filter(F.col("asset_id") == asset).orderBy("d").select(col).collect()
    return [r[0] for r in rows]


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    return {a: 1000 + np.cumsum(rng.normal(0, 10, 900)) for a in ("a", "b")}


@pytest.fixture(scope="module")
def wide(spark, walk):
    cfg = FeatureConfig(
        rolling_stats=("mean", "std", "min", "max", "median"), rolling_windows=(5, 7, 30, 90),
        indicators=("sma", "ema", "bollinger", "rsi"),
    )
    return ft.add_features(frame(spark, walk), cfg).filter("asset_id = 'a'").orderBy("d").toPandas()


def close(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    ok = ~np.isnan(want)
    np.testing.assert_allclose(got[ok], want[ok], rtol=tol, atol=1e-9)


@pytest.mark.parametrize("k", [5, 7, 30, 90])
def test_rolling(wide, walk, k):
    s = pd.Series(walk["a"]).rolling(k)
    for name in ("mean", "std", "min", "max", "median"):
        close(wide[f"rolling_{name}_{k}"], getattr(s, name)())


def test_momentum_and_volatility(wide, walk):
    s = pd.Series(walk["a"])
    ret = s.pct_change()
    for k in C.MOMENTUM_WINDOWS:
        close(wide[f"momentum_{k}"], s / s.shift(k))
        close(wide[f"roc_{k}"], s.pct_change(k))
    for k in C.VOLATILITY_WINDOWS:
        close(wide[f"volatility_{k}"], ret.rolling(k).std() * np.sqrt(252))
        close(wide[f"volatility_ratio_{k}"], ret.rolling(k // 2).std() / ret.rolling(k).std())
    for k in C.STABILITY_WINDOWS:
        close(wide[f"luxury_vol_{k}"], ret.rolling(k).std() * np.sqrt(252))
    low = s.rolling(30).min()
    close(wide["price_premium_30d"], (s - low) / low)


@pytest.mark.parametrize("span", C.EMA_SPANS)
def test_ema(wide, walk, span):
    close(wide[f"ema_{span}"], pd.Series(walk["a"]).ewm(span=span).mean(), 1e-12)


def test_ema_over_many_blocks_and_mixed_spans(spark):
    values = 1000 + np.cumsum(np.random.default_rng(3).normal(0, 5, 3000))
    df = frame(spark, {"a": values})
    for spans in ((20,), (1, 2, 200)):
        got = ft.add_ema(df, spans)
        for s in spans:
            close(collect(got, "a", f"ema_{s}"), pd.Series(values).ewm(span=s).mean(), 1e-11)


def test_bollinger_sma_rsi(wide, walk):
    s = pd.Series(walk["a"])
    for k in C.BOLLINGER_WINDOWS:
        m, sd = s.rolling(k).mean(), s.rolling(k).std()
        close(wide[f"bb_upper_{k}"], m + 2 * sd)
        close(wide[f"bb_position_{k}"], (s - (m - 2 * sd)) / (4 * sd), 1e-7)
    for k in C.SMA_WINDOWS:
        close(wide[f"sma_{k}"], s.rolling(k).mean())
    d = s.diff()
    gain = d.where(d > 0, 0.0).rolling(14).mean()
    loss = (-d.where(d < 0, 0.0)).rolling(14).mean()
    close(wide["rsi"], 100 - 100 / (1 + gain / loss), 1e-7)


def test_rsi_edges(spark):
    df = ft.apply_stages(
        frame(spark, {"up": range(1, 21), "flat": [5] * 20}), [ft.rsi_stage(ft.Grid())])
    up = collect(df, "up", "rsi")
    assert up[:13] == [None] * 13 and up[13:] == [100.0] * 7
    assert collect(df, "flat", "rsi") == [None] * 20


def test_flat_window_position_and_ratio(spark):
    cfg = FeatureConfig(rolling_windows=(5,), rolling_stats=("min", "max"))
    df = ft.add_rolling(frame(spark, {"f": [4.0] * 7}), cfg)
    assert collect(df, "f", "price_position_5") == [None] * 4 + [0.0] * 3
    vol = ft.add_volatility(frame(spark, {"f": [4.0] * 7}))
    assert collect(vol, "f", "volatility_5")[5:] == [0.0, 0.0]
    assert collect(vol, "f", "volatility_ratio_5") == [None] * 7


def test_null_inside_a_frame(spark):
    cfg = FeatureConfig(rolling_windows=(2,), rolling_stats=("mean", "min", "median"))
    df = ft.add_rolling(frame(spark, {"n": [1, None, 3, 5]}), cfg)
    for name in ("mean", "min", "median"):
        got = collect(df, "n", f"rolling_{name}_2")
        assert got[:3] == [None] * 3 and got[3] is not None


def test_shared_columns_are_dropped(spark):
    df = ft.add_features(frame(spark, {"a": range(1, 50)}))
    assert not [c for c in df.columns if c.startswith("_")] and len(set(df.columns)) == len(df.columns)


def test_target_and_horizons_stay_inside_an_asset(spark):
    df = frame(spark, {"a": [1, 2, 3, 4], "b": [10, 20]})
    assert collect(ft.horizon_dataset(df, 2), "a", "target_h2") == [3.0, 4.0]
    assert collect(ft.horizon_dataset(df, 2), "b", "target_h2") == []
    assert collect(ft.add_target(df), "a", "target") == [2.0, 3.0, 4.0, None]
    assert collect(ft.add_target(df), "a", "target_pct_change")[:2] == [None, 1.0]
    with pytest.raises(ValueError):
        ft.horizon_dataset(df, 0)


def test_positive_shift_looks_back(spark):
    df = ft.add_target(frame(spark, {"a": [1, 2, 3]}), FeatureConfig(target_shift=1))
    assert collect(df, "a", "target") == [None, 1.0, 2.0]


def test_sequences(spark):
    df = ft.sequences(frame(spark, {"a": range(10)}), 3)
    assert collect(df, "a", "label") == [float(i) for i in range(3, 10)]
    assert collect(df, "a", "window")[0] == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("method,pandas_fill", [
    ("linear", lambda s: s.interpolate("linear")), ("forward", lambda s: s.ffill()), ("backfill", lambda s: s.bfill()),
])
@pytest.mark.parametrize("freq", ["D", "W"])
def test_resample_and_fill_like_pandas(spark, freq, method, pandas_fill):
    rng = np.random.default_rng(11)
    days = np.sort(rng.choice(900, 120, replace=False))
    stamps = [pd.Timestamp(START) + pd.Timedelta(days=int(x), hours=int(h)) for x, h in zip(days, rng.integers(0, 24, 120))]
    values = rng.normal(100, 5, 120)
    want = pandas_fill(pd.Series(values, index=stamps).resample(freq).last())
    rows = [("a", t.to_pydatetime(), float(v)) for t, v in zip(stamps, values)]
    raw = spark.createDataFrame(rows, "asset_id string, ts timestamp, price double")
    got = grid.densify(grid.resample_last(raw, freq), freq, method).orderBy("d").toPandas()
    assert [pd.Timestamp(x) for x in got["d"]] == list(want.index)
    close(got["price"], want.to_numpy(), 1e-12)
    assert list(got["seq"]) == list(range(len(want)))


def test_config_rejects_unknown_fill():
    with pytest.raises(ValueError):
        C.PrepConfig(fill_method="cubic")
    assert C.PrepConfig(fill_method="backward").fill_method == "backfill"


@pytest.mark.parametrize("price", [1234.56, 6842.13, 68735.79])
def test_flat_prices_have_no_deviation(spark, price):
    g = ft.Grid()
    stages = [
        ft.rolling_stage(g, (5, 7, 14, 30), ("mean", "std")), ft.volatility_stage(g), ft.sma_stage(g),
        ft.bollinger_stage(g), ft.stability_stage(g),
    ]
    rows = ft.apply_stages(frame(spark, {"a": [price] * 80}), stages).orderBy("d").collect()
    for r in rows[60:]:
        for name, value in r.asDict().items():
            if name.startswith(("rolling_std", "volatility_", "luxury_vol")) and "ratio" not in name:
                assert value == 0.0, name
            if name.startswith(("bb_position", "volatility_ratio")):
                assert value is None, name
            if name.startswith(("bb_upper", "bb_lower", "sma_", "rolling_mean")):
                assert value == price, name


def test_windows_longer_than_the_unrolled_ones(spark):
    values = [100 + (i * 37 % 11) * 1.5 for i in range(150)]
    g = ft.Grid()
    stage = ft.Stage(g)
    stage.out = {"m": stage.full("avg", "price", 100), "s": stage.full("std", "ret", 90), "u": stage.full("avg", "up", 70)}
    got = ft.apply_stages(frame(spark, {"a": values}), [stage]).orderBy("d").toPandas()
    s = pd.Series(values)
    close(got["m"], s.rolling(100).mean().to_numpy(), 1e-9)
    close(got["s"], s.pct_change().rolling(90).std().to_numpy(), 1e-9)
    close(got["u"], s.diff().clip(lower=0).fillna(0).rolling(70).mean().to_numpy(), 1e-9)
