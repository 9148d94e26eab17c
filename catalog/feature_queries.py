"""Feature windows over the daily grid, calendars, tiers and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    B_SQL, OBS_SQL, PD_SQL, W, b, frame, full, observed, pd, query, r, rounded, snap, snap_sql, table,
)
from seriesloom import config as C
from seriesloom.config import FeatureConfig, SplitConfig
from seriesloom.functions import dates, labels
from seriesloom.operators import features as ft
from seriesloom.operators import grid, splits

ALL_STATS = FeatureConfig(rolling_stats=("mean", "std", "min", "max", "median"))


# ---- flagship ------------------------------------------------------------------

FLAGSHIP_SQL = f"""
WITH {PD_SQL}, f AS (
SELECT asset_id, d, price, lag(price, 7) OVER w AS price_lag_7,
  {full('avg(price)', 7)} AS m, {full('stddev_samp(price)', 7)} AS s,
  lead(price) OVER w AS target
FROM pd {W})
SELECT asset_id, d, price, price_lag_7, {snap_sql('m')} AS rolling_mean_7, {snap_sql('s', 7)} AS rolling_std_7, target
FROM f WHERE target IS NOT NULL
"""


@query("price_features", FLAGSHIP_SQL, as_text=("d",))
def price_features(spark, sf):
    cfg = FeatureConfig(lags=(7,), rolling_windows=(7,))
    g = ft.Grid()
    stages = [
        ft.lag_stage(g, cfg.lags), ft.rolling_stage(g, cfg.rolling_windows, cfg.rolling_stats),
        ft.target_stage(g, -1),
    ]
    wide = ft.apply_stages(pd(spark, sf), stages).filter(F.col("target").isNotNull())
    return wide.select(
        "asset_id", "d", "price", "price_lag_7", snap("rolling_mean_7").alias("rolling_mean_7"),
        snap("rolling_std_7", 7).alias("rolling_std_7"), "target",
    )


# ---- windows -------------------------------------------------------------------


@query("win1_lags", f"""
WITH {PD_SQL} SELECT asset_id, d, {', '.join(f'lag(price, {k}) OVER w AS price_lag_{k}' for k in (5, 7, 14, 30))}
FROM pd {W}""", as_text=("d",))
def win1(spark, sf):
    return ft.add_lags(pd(spark, sf)).drop("price", "seq")


_ROLL = ", ".join(
    f"{snap_sql(full(e, k), n)} AS rolling_{s}_{k}"
    for k in (5, 7, 14, 30)
    for s, e, n in (
        ("mean", "avg(price)", 10), ("std", "stddev_samp(price)", 7), ("min", "min(price)", 10),
        ("max", "max(price)", 10), ("median", "median(price)", 10),
    )
)


@query("win2_rolling_stats", f"WITH {PD_SQL} SELECT asset_id, d, {_ROLL} FROM pd", as_text=("d",))
def win2(spark, sf):
    out = ft.add_rolling(pd(spark, sf), ALL_STATS)
    out = out.drop("price", "seq", *[f"price_position_{k}" for k in ALL_STATS.rolling_windows])
    bits = {"mean": 10, "std": 7, "min": 10, "max": 10, "median": 10}
    return out.withColumns({
        f"rolling_{s}_{k}": snap(f"rolling_{s}_{k}", n)
        for s, n in bits.items() for k in ALL_STATS.rolling_windows
    })


_POS = ", ".join(
    f"""round(CASE WHEN count(price) OVER {frame(k)} < {k} THEN NULL
    WHEN max(price) OVER {frame(k)} = min(price) OVER {frame(k)} THEN 0.0
    ELSE (price - min(price) OVER {frame(k)}) / (max(price) OVER {frame(k)} - min(price) OVER {frame(k)}) END, 7)
    AS price_position_{k}""" for k in (5, 7, 14, 30)
)


@query("win3_price_position", f"WITH {PD_SQL} SELECT asset_id, d, {_POS} FROM pd", as_text=("d",))
def win3(spark, sf):
    cfg = FeatureConfig(rolling_stats=("min", "max"))
    cols = [f"price_position_{k}" for k in cfg.rolling_windows]
    return rounded(ft.add_rolling(pd(spark, sf), cfg).select("asset_id", "d", *cols), 7, *cols)


_CHG = ", ".join(
    f"round(price / nullif(lag(price, {k}) OVER w, 0) - 1, 8) AS price_change_{k}, "
    f"price - lag(price, {k}) OVER w AS price_change_abs_{k}" for k in (5, 7, 14, 30)
)


@query("win4_price_changes", f"WITH {PD_SQL} SELECT asset_id, d, {_CHG} FROM pd {W}", as_text=("d",))
def win4(spark, sf):
    out = ft.add_momentum(pd(spark, sf))
    for k in (5, 7, 14, 30):
        out = out.withColumn(f"price_change_{k}", r(f"price_change_{k}", 8))
    drop = [f"{n}_{k}" for n in ("momentum", "roc") for k in C.MOMENTUM_WINDOWS]
    return out.drop("price", "seq", *drop)


_MOM = ", ".join(
    f"round(price / nullif(lag(price, {k}) OVER w, 0), 8) AS momentum_{k}, "
    f"round(price / nullif(lag(price, {k}) OVER w, 0) - 1, 8) AS roc_{k}" for k in (5, 10, 20)
)


@query("win5_momentum_roc", f"WITH {PD_SQL} SELECT asset_id, d, {_MOM} FROM pd {W}", as_text=("d",))
def win5(spark, sf):
    cols = [f"{n}_{k}" for k in C.MOMENTUM_WINDOWS for n in ("momentum", "roc")]
    return rounded(ft.add_momentum(pd(spark, sf)).select("asset_id", "d", *cols), 8, *cols)


_RET = f"ret AS (SELECT asset_id, d, price, price / nullif(lag(price) OVER w, 0) - 1 AS ret FROM pd {W})"


def _vol(k: int) -> str:
    return full("stddev_samp(ret)", k, "ret")


@query("win6_volatility", f"""
WITH {PD_SQL}, {_RET}
SELECT asset_id, d, {', '.join(f'round({_vol(k)} * sqrt(252), 6) AS volatility_{k}' for k in (5, 10, 20, 30))} FROM ret""", as_text=("d",))
def win6(spark, sf):
    cols = [f"volatility_{k}" for k in C.VOLATILITY_WINDOWS]
    return rounded(ft.add_volatility(pd(spark, sf)).select("asset_id", "d", *cols), 6, *cols)


@query("win7_volatility_ratio", f"""
WITH {PD_SQL}, {_RET}
SELECT asset_id, d, {', '.join(f'round(({_vol(k // 2)}) / nullif({_vol(k)}, 0), 6) AS volatility_ratio_{k}' for k in (5, 10, 20, 30))} FROM ret""", as_text=("d",))
def win7(spark, sf):
    cols = [f"volatility_ratio_{k}" for k in C.VOLATILITY_WINDOWS]
    return rounded(ft.add_volatility(pd(spark, sf)).select("asset_id", "d", *cols), 6, *cols)


_SMA = ", ".join(
    f"{snap_sql(full('avg(price)', k))} AS sma_{k}, round(price / nullif({full('avg(price)', k)}, 0), 8) AS price_over_sma_{k}"
    for k in (5, 10, 20, 50)
)


@query("win8_simple_means", f"WITH {PD_SQL} SELECT asset_id, d, {_SMA} FROM pd", as_text=("d",))
def win8(spark, sf):
    out = ft.apply_stages(pd(spark, sf), [ft.sma_stage(ft.Grid())])
    return out.select(
        "asset_id", "d",
        *[snap(f"sma_{k}").alias(f"sma_{k}") for k in C.SMA_WINDOWS],
        *[r(f"price_over_sma_{k}", 8).alias(f"price_over_sma_{k}") for k in C.SMA_WINDOWS],
    )


def _ema_sql(s: int) -> str:
    q = 1 - 2 / (s + 1)
    k = ft.ema_depth(s)
    return f"""e{s} AS (
  SELECT x.asset_id, x.d, sum(y.price * pow({q!r}, x.rn - y.rn)) / sum(pow({q!r}, x.rn - y.rn)) AS ema
  FROM rn x JOIN rn y ON x.asset_id = y.asset_id AND y.rn BETWEEN x.rn - {k} AND x.rn
  GROUP BY x.asset_id, x.d)"""


@query("win9_exponential_means", f"""
WITH {PD_SQL}, rn AS (SELECT asset_id, d, price, row_number() OVER w AS rn FROM pd {W}),
{_ema_sql(5)}, {_ema_sql(10)}, {_ema_sql(20)}
SELECT asset_id, d, {', '.join(f'{snap_sql(f"e{s}.ema", 6)} AS ema_{s}, round(price / nullif(e{s}.ema, 0), 8) AS price_over_ema_{s}' for s in (5, 10, 20))}
FROM rn JOIN e5 USING (asset_id, d) JOIN e10 USING (asset_id, d) JOIN e20 USING (asset_id, d)""", as_text=("d",))
def win9(spark, sf):
    # The SQL sums hundreds of powers per row in no fixed order, so the comparison
    # grid is coarser here; the pandas test holds the same columns to 1e-12.
    out = ft.add_ema(pd(spark, sf))
    return out.select(
        "asset_id", "d",
        *[snap(f"ema_{s}", 6).alias(f"ema_{s}") for s in C.EMA_SPANS],
        *[r(f"price_over_ema_{s}", 8).alias(f"price_over_ema_{s}") for s in C.EMA_SPANS],
    )


_BB = ", ".join(
    f"round(m{k} + 2 * s{k}, 2) AS bb_upper_{k}, round(m{k} - 2 * s{k}, 2) AS bb_lower_{k}, "
    f"round((price - (m{k} - 2 * s{k})) / nullif((m{k} + 2 * s{k}) - (m{k} - 2 * s{k}), 0), 6) AS bb_position_{k}"
    for k in (10, 20)
)
_BBM = ", ".join(f"{full('avg(price)', k)} AS m{k}, {full('stddev_samp(price)', k)} AS s{k}" for k in (10, 20))


@query("win10_bollinger", f"""
WITH {PD_SQL}, m AS (SELECT asset_id, d, price, {_BBM} FROM pd) SELECT asset_id, d, {_BB} FROM m""", as_text=("d",))
def win10(spark, sf):
    out = ft.apply_stages(pd(spark, sf), [ft.bollinger_stage(ft.Grid())])
    return out.select("asset_id", "d", *[
        r(f"bb_{n}_{k}", digits).alias(f"bb_{n}_{k}")
        for k in C.BOLLINGER_WINDOWS for n, digits in (("upper", 2), ("lower", 2), ("position", 6))
    ])


_FLAT = ", ".join(
    f"{snap_sql(f'm{k} + 2 * s{k}', 7)} AS bb_upper_{k}, {snap_sql(f'm{k} - 2 * s{k}', 7)} AS bb_lower_{k}, "
    f"round((price - (m{k} - 2 * s{k})) / nullif(4 * s{k}, 0), 5) AS bb_position_{k}" for k in (10, 20)
)


def _flat_dev(k: int) -> str:
    f = frame(k)
    return (
        f"CASE WHEN count(price) OVER {f} < {k} THEN NULL WHEN min(price) OVER {f} = max(price) OVER {f} THEN 0.0 "
        f"ELSE stddev_samp(price) OVER {f} END"
    )


@query("win10_bollinger_forward_filled", f"""
WITH {OBS_SQL}, spaced AS (
  SELECT asset_id, ts, price, coalesce(lead(ts) OVER (PARTITION BY asset_id ORDER BY ts) - ts, 1) AS gap
  FROM obs WHERE day(ts) = 1),
ff AS (SELECT asset_id, CAST(ts + CAST(k AS INTEGER) AS DATE) AS d, price
  FROM spaced, unnest(generate_series(0, gap - 1)) AS t(k)),
m AS (SELECT asset_id, d, price, {', '.join(f"{full('avg(price)', k)} AS m{k}, {_flat_dev(k)} AS s{k}" for k in (10, 20))} FROM ff)
SELECT asset_id, d, {_FLAT} FROM m""", as_text=("d",))
def win10_flat(spark, sf):
    """Prices of the first of each month, held until the next: most windows are flat."""
    first = observed(spark, sf).filter(F.dayofmonth("ts") == 1).withColumnRenamed("ts", "d")
    held = grid.densify(first, "D", "forward", "asset_id", "d", "price", 1)
    out = ft.apply_stages(held, [ft.bollinger_stage(ft.Grid())])
    return out.select("asset_id", "d", *[
        c for k in C.BOLLINGER_WINDOWS for c in (
            snap(f"bb_upper_{k}", 7).alias(f"bb_upper_{k}"), snap(f"bb_lower_{k}", 7).alias(f"bb_lower_{k}"),
            r(f"bb_position_{k}", 5).alias(f"bb_position_{k}"),
        )
    ])


@query("win11_rsi", f"""
WITH {PD_SQL}, dl AS (SELECT asset_id, d, price - lag(price) OVER w AS dp FROM pd {W}),
gl AS (SELECT asset_id, d, greatest(coalesce(dp, 0), 0) AS g, greatest(coalesce(-dp, 0), 0) AS l FROM dl),
av AS (SELECT asset_id, d, count(*) OVER {frame(14)} AS n, avg(g) OVER {frame(14)} AS g, avg(l) OVER {frame(14)} AS l,
       max(l) OVER {frame(14)} AS lmax, max(g) OVER {frame(14)} AS gmax FROM gl)
SELECT asset_id, d, round(CASE WHEN n < 14 THEN NULL WHEN lmax = 0 AND gmax = 0 THEN NULL WHEN lmax = 0 THEN 100.0
       ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM av""", as_text=("d",))
def win11(spark, sf):
    out = ft.apply_stages(pd(spark, sf), [ft.rsi_stage(ft.Grid())])
    return rounded(out.select("asset_id", "d", "rsi"), 6, "rsi")


@query("win12_stability_volatility", f"""
WITH {PD_SQL}, {_RET}
SELECT asset_id, d, {', '.join(f'round({_vol(k)} * sqrt(252), 6) AS luxury_vol_{k}' for k in (3, 5, 10))} FROM ret""", as_text=("d",))
def win12(spark, sf):
    cols = [f"luxury_vol_{k}" for k in C.STABILITY_WINDOWS]
    out = ft.apply_stages(pd(spark, sf), [ft.stability_stage(ft.Grid())])
    return rounded(out.select("asset_id", "d", *cols), 6, *cols)


@query("win13_premium_over_low", f"""
WITH {PD_SQL} SELECT asset_id, d, round((price - {full('min(price)', 30)}) / nullif({full('min(price)', 30)}, 0), 7) AS price_premium_30d FROM pd""", as_text=("d",))
def win13(spark, sf):
    out = ft.apply_stages(pd(spark, sf), [ft.stability_stage(ft.Grid())])
    return rounded(out.select("asset_id", "d", "price_premium_30d"), 7, "price_premium_30d")


@query("win14_target", f"WITH {PD_SQL} SELECT asset_id, d, lead(price, 1) OVER w AS target FROM pd {W}", as_text=("d",))
def win14(spark, sf):
    return ft.add_target(pd(spark, sf)).select("asset_id", "d", "target")


@query("win15_target_pct_change", f"""
WITH {PD_SQL} SELECT asset_id, d, round(price / nullif(lag(price, 1) OVER w, 0) - 1, 8) AS target_pct_change FROM pd {W}""", as_text=("d",))
def win15(spark, sf):
    return rounded(ft.add_target(pd(spark, sf)).select("asset_id", "d", "target_pct_change"), 8, "target_pct_change")


@query("win16_horizon_target", f"""
WITH {PD_SQL}, h AS (SELECT asset_id, d, price, lead(price, 7) OVER w AS t FROM pd {W})
SELECT asset_id, d, price, t AS target_h7 FROM h WHERE t IS NOT NULL""", as_text=("d",))
def win16(spark, sf):
    return ft.horizon_dataset(pd(spark, sf), 7).drop("seq")


@query("win17_temporal_split", f"""
WITH {PD_SQL}, h AS (SELECT asset_id, d, lead(price, 1) OVER w AS t FROM pd {W}),
n AS (SELECT asset_id, d, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM h WHERE t IS NOT NULL {W})
SELECT asset_id, d, CASE WHEN i < floor(n * {1 - 0.2 - 0.1!r}::DOUBLE) THEN 'train'
  WHEN i < floor(n * {1 - 0.2!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM n WHERE n >= 20 AND floor(n * {1 - 0.2 - 0.1!r}::DOUBLE) > 0 AND floor(n * {1 - 0.2!r}::DOUBLE) > floor(n * {1 - 0.2 - 0.1!r}::DOUBLE)""", as_text=("d",))
def win17(spark, sf):
    rows = ft.horizon_dataset(ft.add_target(pd(spark, sf)), 1)
    return splits.temporal_split(rows, SplitConfig()).select("asset_id", "d", "split")


@query("win19_last_180_rows", f"""
WITH {PD_SQL} SELECT asset_id, d, price FROM pd
QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY d DESC) <= 180""", as_text=("d",))
def win19(spark, sf):
    return splits.last_rows(pd(spark, sf).drop("seq"), 180)


@query("win25_sequences", f"""
WITH {PD_SQL}, s AS (
  SELECT asset_id, d, price, list(price) OVER (PARTITION BY asset_id ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS x FROM pd)
SELECT asset_id, d, CAST(len(x) AS INTEGER) AS steps, {', '.join(f'x[{i}] AS step_{i}' for i in range(1, 31))}, price AS label
FROM s WHERE len(x) = 30""", as_text=("d",))
def win25(spark, sf):
    out = ft.sequences(pd(spark, sf), 30)
    x = F.col("window")
    return out.select(
        "asset_id", "d", F.size(x).alias("steps"), *[x[i - 1].alias(f"step_{i}") for i in range(1, 31)], "label",
    )


# ---- calendars -----------------------------------------------------------------


@query("dat1_calendar_parts", f"""
WITH {PD_SQL} SELECT asset_id, d, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(month(d) AS INTEGER) AS month,
  CAST(quarter(d) AS INTEGER) AS quarter, CAST(day(d) AS INTEGER) AS day_of_month, CAST(year(d) AS INTEGER) AS year FROM pd""", as_text=("d",))
def dat1(spark, sf):
    cols = dates.calendar_columns(F.col("d"), ("day_of_week", "month", "quarter", "day_of_month", "year"))
    out = pd(spark, sf).select("asset_id", "d").withColumns(cols)
    return out.select("asset_id", "d", "day_of_week", "month", "quarter", "day_of_month", "year")


@query("dat2_cyclic_encoding", f"""
WITH {PD_SQL} SELECT asset_id, d, round(sin(2 * pi() * (isodow(d) - 1) / 7), 9) + 0 AS day_of_week_sin,
  round(cos(2 * pi() * (isodow(d) - 1) / 7), 9) + 0 AS day_of_week_cos,
  round(sin(2 * pi() * month(d) / 12), 9) + 0 AS month_sin, round(cos(2 * pi() * month(d) / 12), 9) + 0 AS month_cos FROM pd""", as_text=("d",))
def dat2(spark, sf):
    cols = dates.calendar_columns(F.col("d"), ("day_of_week", "month"))
    names = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
    out = pd(spark, sf).select("asset_id", "d").withColumns(cols)
    return out.select("asset_id", "d", *[(r(n, 9) + 0).alias(n) for n in names])


@query("dat3_calendar_flags", f"""
WITH {PD_SQL} SELECT asset_id, d, isodow(d) >= 6 AS is_weekend, day(d) = 1 AS is_month_start,
  d = last_day(d) AS is_month_end, d = CAST(date_trunc('quarter', d) AS DATE) AS is_quarter_start,
  d + 1 = CAST(date_trunc('quarter', d + 1) AS DATE) AS is_quarter_end FROM pd""", as_text=("d",))
def dat3(spark, sf):
    names = ("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end")
    out = pd(spark, sf).select("asset_id", "d").withColumns(dates.calendar_columns(F.col("d"), names))
    return out.select("asset_id", "d", *names)


@query("dat4_seasons", f"""
WITH {PD_SQL} SELECT asset_id, d, month(d) IN (11, 12, 1) AS is_holiday_season,
  month(d) IN (3, 4) AS is_watch_fair_season FROM pd""", as_text=("d",))
def dat4(spark, sf):
    return pd(spark, sf).select("asset_id", "d").withColumns(dates.season_columns(F.col("d")))


# ---- tiers and flags -----------------------------------------------------------

_TIER = """CASE WHEN {x} >= 0 AND {x} < 5000 THEN 'entry' WHEN {x} >= 5000 AND {x} < 20000 THEN 'mid'
  WHEN {x} >= 20000 AND {x} < 100000 THEN 'high' WHEN {x} >= 100000 THEN 'ultra' ELSE 'unknown' END"""


@query("mth1_tier", f"SELECT c_custkey, {_TIER.format(x='c_acctbal')} AS tier FROM customer")
def mth1(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", labels.tier(F.col("c_acctbal")).alias("tier"))


@query("mth2_tier_one_hots", f"""
WITH {PD_SQL}, m AS (SELECT asset_id, d, avg(price) OVER (PARTITION BY asset_id) AS m FROM pd)
SELECT asset_id, d, {', '.join(f"CAST({_TIER.format(x='m')} = '{t}' AS INTEGER) AS tier_{t}" for t in ('entry', 'mid', 'high', 'ultra'))} FROM m""", as_text=("d",))
def mth2(spark, sf):
    out = ft.apply_stages(pd(spark, sf), [ft.tier_stage(ft.Grid(), C.TIERS)])
    return out.drop("price", "seq")


@query("mth3_premium_brand", """
SELECT p_partkey, CAST(contains(b, 'brand#1') OR contains(b, 'small_ring') AS INTEGER) AS brand_tier_premium,
  1 - CAST(contains(b, 'brand#1') OR contains(b, 'small_ring') AS INTEGER) AS brand_tier_non_premium
FROM (SELECT p_partkey, replace(lower(p_brand || ' ' || p_name), ' ', '_') AS b FROM part)""")
def mth3(spark, sf):
    flags = labels.premium_flags(F.concat_ws(" ", "p_brand", "p_name"), ("Brand#1", "small_ring"))
    return table(spark, sf, "part").withColumns(flags).select("p_partkey", *flags)


@query("mth4_keyword_flags", """
SELECT p_partkey, CAST(regexp_matches(replace(lower(p_name), ' ', '_'), 'ring|bolt') AS INTEGER) AS is_sports_watch,
  CAST(regexp_matches(replace(lower(p_name), ' ', '_'), 'blue_bolt|gear') AS INTEGER) AS is_dress_watch FROM part""")
def mth4(spark, sf):
    flags = labels.keyword_flags(F.col("p_name"), ("ring", "bolt"), ("blue_bolt", "gear"))
    return table(spark, sf, "part").withColumns(flags).select("p_partkey", *flags)


# ---- whole feature table over suppliers -----------------------------------------


def _flat_std(x: str, k: int) -> str:
    """Deviation of a full window; exactly 0 where all values are equal."""
    f = frame(k)
    return (
        f"CASE WHEN count({x}) OVER {f} < {k} THEN NULL WHEN min({x}) OVER {f} = max({x}) OVER {f} THEN 0.0 "
        f"ELSE stddev_samp({x}) OVER {f} END"
    )


def _table_columns() -> dict[str, tuple[str, str]]:
    """Feature -> (inner SQL over the grid with returns, rounding) of the 71 features."""
    out: dict[str, tuple[str, str]] = {
        "day_of_week": ("CAST(isodow(d) - 1 AS INTEGER)", ""),
        "day_of_week_sin": ("sin(2 * pi() * (isodow(d) - 1) / 7)", "r7"),
        "day_of_week_cos": ("cos(2 * pi() * (isodow(d) - 1) / 7)", "r7"),
        "month": ("CAST(month(d) AS INTEGER)", ""),
        "month_sin": ("sin(2 * pi() * month(d) / 12)", "r7"),
        "month_cos": ("cos(2 * pi() * month(d) / 12)", "r7"),
        "quarter": ("CAST(quarter(d) AS INTEGER)", ""), "is_weekend": ("isodow(d) >= 6", ""),
    }
    for k in (5, 7, 14, 30):
        out[f"price_lag_{k}"] = (f"lag(price, {k}) OVER w", "")
    for k in (5, 7, 14, 30):
        out[f"rolling_mean_{k}"] = (full("avg(price)", k), "s10")
        out[f"rolling_std_{k}"] = (_flat_std("price", k), "s7")
    for k in (5, 7, 14, 30):
        out[f"price_change_{k}"] = (f"price / nullif(lag(price, {k}) OVER w, 0) - 1", "r7")
        out[f"price_change_abs_{k}"] = (f"price - lag(price, {k}) OVER w", "")
    for k in C.MOMENTUM_WINDOWS:
        out[f"momentum_{k}"] = (f"price / nullif(lag(price, {k}) OVER w, 0)", "r7")
        out[f"roc_{k}"] = (f"price / nullif(lag(price, {k}) OVER w, 0) - 1", "r7")
    for k in C.VOLATILITY_WINDOWS:
        out[f"volatility_{k}"] = (f"({_flat_std('ret', k)}) * sqrt(252)", "r5")
        out[f"volatility_ratio_{k}"] = (f"({_flat_std('ret', k // 2)}) / nullif({_flat_std('ret', k)}, 0)", "r5")
    for k in C.EMA_SPANS:
        out[f"ema_{k}"] = (f"e{k}", "s6")
        out[f"price_over_ema_{k}"] = (f"price / nullif(e{k}, 0)", "r7")
    for k in C.BOLLINGER_WINDOWS:
        m, dev = full("avg(price)", k), f"({_flat_std('price', k)})"
        out[f"bb_upper_{k}"], out[f"bb_lower_{k}"] = (f"{m} + 2 * {dev}", "s6"), (f"{m} - 2 * {dev}", "s6")
        out[f"bb_position_{k}"] = (f"(price - ({m} - 2 * {dev})) / nullif(4 * {dev}, 0)", "r5")
    gain, loss = (f"avg({x}) OVER {frame(14)}" for x in ("g", "l"))
    out["rsi"] = (f"""CASE WHEN count(*) OVER {frame(14)} < 14 THEN NULL
      WHEN max(l) OVER {frame(14)} = 0 THEN CASE WHEN max(g) OVER {frame(14)} > 0 THEN 100.0 END
      ELSE 100 - 100 / (1 + {gain} / {loss}) END""", "r5")
    for t in ("entry", "mid", "high", "ultra"):
        out[f"tier_{t}"] = (f"CAST({_TIER.format(x='(avg(price) OVER (PARTITION BY asset_id))')} = '{t}' AS INTEGER)", "")
    # Supplier numbers are no brand or model name.
    out["brand_tier_premium"], out["brand_tier_non_premium"] = ("0", ""), ("1", "")
    out["is_sports_watch"], out["is_dress_watch"] = ("0", ""), ("0", "")
    out["is_holiday_season"] = ("month(d) IN (11, 12, 1)", "")
    out["is_watch_fair_season"] = ("month(d) IN (3, 4)", "")
    for k in C.STABILITY_WINDOWS:
        out[f"luxury_vol_{k}"] = (f"({_flat_std('ret', k)}) * sqrt(252)", "r5")
    low = full("min(price)", 30)
    out["price_premium_30d"] = (f"(price - {low}) / nullif({low}, 0)", "r7")
    out["target"] = ("lead(price, 1) OVER w", "")
    out["target_pct_change"] = ("price / nullif(lag(price, 1) OVER w, 0) - 1", "r7")
    return out


_COLUMNS = _table_columns()


def _rounded_sql(name: str, how: str) -> str:
    if not how:
        return name
    scale = f"{_scale(how)!r}::DOUBLE"
    return f"floor({name} * {scale} + 0.5) / {scale} AS {name}"


def _scale(how: str) -> float:
    return 2.0 ** int(how[1:]) if how[0] == "s" else 10.0 ** int(how[1:])


#: Returns and moves, then every feature, over the grid ``pd`` and its exponential means.
_FAMILIES_SQL = f"""g AS (SELECT asset_id, d, price, price / nullif(lag(price) OVER w, 0) - 1 AS ret,
    greatest(coalesce(price - lag(price) OVER w, 0), 0) AS g, greatest(coalesce(lag(price) OVER w - price, 0), 0) AS l,
    e5.ema AS e5, e10.ema AS e10, e20.ema AS e20
  FROM pd JOIN e5 USING (asset_id, d) JOIN e10 USING (asset_id, d) JOIN e20 USING (asset_id, d) {W}),
f AS (SELECT asset_id, d, price, {', '.join(f'{sql} AS {name}' for name, (sql, _) in _COLUMNS.items())} FROM g {W})"""

_GRID_SQL = f"""{B_SQL}, obs AS (
  SELECT asset_id, ts, price FROM (
    SELECT asset_id, ts, arg_min(price, tie) AS price, count(*) OVER (PARTITION BY asset_id) AS n FROM b GROUP BY asset_id, ts)
  WHERE n >= 30 AND price > 0), spaced AS (
  SELECT asset_id, ts, price, lead(price) OVER w AS nxt, coalesce(lead(ts) OVER w - ts, 1) AS gap
  FROM obs WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
pd AS (
  SELECT asset_id, CAST(ts + CAST(k AS INTEGER) AS DATE) AS d,
         CASE WHEN k = 0 THEN price ELSE price + (nxt - price) * k / gap END AS price
  FROM spaced, unnest(generate_series(0, gap - 1)) AS t(k)),
rn AS (SELECT asset_id, d, price, row_number() OVER w AS rn FROM pd {W}),
{_ema_sql(5)}, {_ema_sql(10)}, {_ema_sql(20)}, {_FAMILIES_SQL}"""


def _even(made):
    """The features on the comparison grid of the SQL; plain arithmetic, as ``round`` goes by decimals."""
    return made.withColumns({
        n: F.floor(F.col(n) * F.lit(_scale(how)) + F.lit(0.5)) / F.lit(_scale(how))
        for n, (_, how) in _COLUMNS.items() if how
    })


@query("feature_table_suppliers", f"""
WITH {_GRID_SQL}
SELECT d AS date, price, CAST(asset_id AS VARCHAR) AS watch_id, CAST(asset_id AS VARCHAR) AS brand,
  'Unknown' AS model, asset_id, {', '.join(_rounded_sql(n, how) for n, (_, how) in _COLUMNS.items())}
FROM f WHERE target IS NOT NULL""", as_text=("date",))
def feature_table_suppliers(spark, sf):
    from catalog.registry import B_ORDER
    from seriesloom.plans.features_plan import prepare

    return _even(prepare(b(spark, sf), B_ORDER, passes=3).features)


@query("pip2_feature_pass", f"""
WITH {PD_SQL}, rn AS (SELECT asset_id, d, price, row_number() OVER w AS rn FROM pd {W}),
{_ema_sql(5)}, {_ema_sql(10)}, {_ema_sql(20)}, {_FAMILIES_SQL}
SELECT d AS date, price, CAST(asset_id AS VARCHAR) AS watch_id, CAST(asset_id AS VARCHAR) AS brand,
  'Unknown' AS model, asset_id, {', '.join(_rounded_sql(n, how) for n, (_, how) in _COLUMNS.items())}
FROM f WHERE target IS NOT NULL""", as_text=("date",))
def pip2_features(spark, sf):
    from seriesloom.plans.features_plan import engineer

    return _even(engineer(pd(spark, sf)))
