"""Feature families over a regular grid (one row per asset and day).

All families share one window, (asset, day), so however many are combined the
plan holds one exchange. Short rolling statistics are not sliding frames, which
revisit every row of every frame: the window only fetches lagged prices, and
means, deviations, extremes and medians are compiled arithmetic over those
columns. Frames longer than ``UNROLL`` rows fall back to window aggregates.

A ``Stage`` describes a family in layers, each reading the ones before:

``windows``  lagged prices and whole-series or long-frame aggregates
``items``    returns as they stood some rows back
``frames``   long-frame aggregates of items
``means``    averages of items
``spreads``  deviations, extremes and medians
``out``      the features

Columns of equal name are computed once, however many families use them. All
but ``out`` start with an underscore and are dropped at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom import config as C
from seriesloom.config import FeatureConfig
from seriesloom.functions import dates, labels

UNROLL = 64
LAYERS = ("windows", "items", "frames", "means", "spreads")
FRAMES = {
    "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "median": lambda c: F.percentile(c, 0.5),
}


@dataclass(frozen=True)
class Grid:
    """Column names of the input grid and its window.

    ``block`` names a column that never falls from one day of an asset to the next:
    windows ordered by it too share the sort of windows inside the blocks.
    """

    asset: str = "asset_id"
    day: str = "d"
    price: str = "price"
    block: str | None = None

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.asset).orderBy(*([self.block] if self.block else []), self.day)

    @property
    def p(self) -> Column:
        return F.col(self.price)


def _change(p: Column, earlier: Column) -> Column:
    return F.try_divide(p, earlier) - 1


@dataclass
class Stage:
    grid: Grid
    windows: dict[str, Column] = field(default_factory=dict)
    items: dict[str, Column] = field(default_factory=dict)
    frames: dict[str, Column] = field(default_factory=dict)
    means: dict[str, Column] = field(default_factory=dict)
    spreads: dict[str, Column] = field(default_factory=dict)
    out: dict[str, Column] = field(default_factory=dict)

    def lag(self, k: int) -> Column:
        """Price ``k`` rows back."""
        return F.col(self._lag(k))

    def _lag(self, k: int) -> str:
        if k == 0:
            return f"`{self.grid.price}`"
        name = f"_lag_{k}"
        if name not in self.windows:
            self.windows[name] = F.lag(self.grid.price, k).over(self.grid.w)
        return name

    def item(self, series: str, k: int) -> str:
        """SQL text of ``series`` as it stood ``k`` rows back."""
        if series == "price":
            return self._lag(k)
        now, before = self._lag(k), self._lag(k + 1)
        # Moves are used once, so they stay inline. The first row has no
        # difference and counts as no move.
        if series == "up":
            return f"greatest(coalesce({now} - {before}, 0D), 0D)"
        if series == "down":
            return f"greatest(coalesce({before} - {now}, 0D), 0D)"
        name = f"_ret_{k}"
        if name not in self.items:
            self.items[name] = F.expr(f"try_divide({now}, {before}) - 1")
        return name

    def full(self, how: str, series: str, k: int) -> Column:
        """Statistic of the last ``k`` values, NULL unless all of them exist.

        Long sums are written as SQL text: one parse instead of a call per term.
        """
        if k > UNROLL:
            return self._frame(how, series, k)
        values = [self.item(series, i) for i in range(k)]
        mean, name = f"_avg_{series}_{k}", f"_{how}_{series}_{k}"
        if mean not in self.means:
            # Centred on the current value: exact where all values are equal, so a flat
            # window has no deviation.
            moved = " + ".join(f"({v} - {values[0]})" for v in values[1:])
            self.means[mean] = F.expr(f"{values[0]} + ({moved}) / {k}" if moved else values[0])
        if name not in self.spreads and how != "avg":
            if how == "std":
                squares = " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in values)
                value = f"sqrt(({squares}) / {k - 1})"
            elif how in ("min", "max"):
                value = f"{'least' if how == 'min' else 'greatest'}({', '.join(values)})" if k > 1 else values[0]
            else:
                ordered = f"sort_array(array({', '.join(values)}))"
                value = f"({ordered}[{(k - 1) // 2}] + {ordered}[{k // 2}]) / 2"
            self.spreads[name] = F.expr(f"CASE WHEN {mean} IS NOT NULL THEN {value} END")
        return F.col(name)

    def _frame(self, how: str, series: str, k: int) -> Column:
        frame = self.grid.w.rowsBetween(-(k - 1), 0)
        name = f"_{how}_{series}_{k}"
        value = self.grid.p
        if series != "price":
            now = f"_{series}_0"
            self.items.setdefault(now, F.expr(self.item(series, 0)))
            value = F.col(now)
        self.frames[name] = F.when(F.count(value).over(frame) == k, FRAMES[how](value).over(frame))
        return F.col(name)


def _annual(vol: Column) -> Column:
    return vol * F.lit(math.sqrt(C.TRADING_DAYS))


def lag_stage(g: Grid, periods: Iterable[int]) -> Stage:
    s = Stage(g)
    s.out = {f"price_lag_{k}": s.lag(k) for k in periods}
    return s


def rolling_stage(g: Grid, windows: Iterable[int], stats: Iterable[str]) -> Stage:
    stats = tuple(stats)
    s = Stage(g)
    for k in windows:
        cells = {x: s.full("avg" if x == "mean" else x, "price", k) for x in stats}
        s.out.update({f"rolling_{x}_{k}": c for x, c in cells.items()})
        if "min" in cells and "max" in cells:
            spread = cells["max"] - cells["min"]
            s.out[f"price_position_{k}"] = F.when(spread == 0, F.lit(0.0)).otherwise(
                F.try_divide(g.p - cells["min"], spread)
            )
    return s


def momentum_stage(g: Grid, periods: Iterable[int]) -> Stage:
    s = Stage(g)
    for k in periods:
        s.out[f"price_change_{k}"] = _change(g.p, s.lag(k))
        s.out[f"price_change_abs_{k}"] = g.p - s.lag(k)
    for k in C.MOMENTUM_WINDOWS:
        s.out[f"momentum_{k}"] = F.try_divide(g.p, s.lag(k))
        s.out[f"roc_{k}"] = _change(g.p, s.lag(k))
    return s


def volatility_stage(g: Grid) -> Stage:
    s = Stage(g)
    for k in C.VOLATILITY_WINDOWS:
        wide, narrow = s.full("std", "ret", k), s.full("std", "ret", k // 2)
        s.out[f"volatility_{k}"] = _annual(wide)
        s.out[f"volatility_ratio_{k}"] = F.try_divide(narrow, wide)
    return s


def sma_stage(g: Grid) -> Stage:
    s = Stage(g)
    for k in C.SMA_WINDOWS:
        s.out[f"sma_{k}"] = s.full("avg", "price", k)
        s.out[f"price_over_sma_{k}"] = F.try_divide(g.p, s.full("avg", "price", k))
    return s


def bollinger_stage(g: Grid) -> Stage:
    s = Stage(g)
    for k in C.BOLLINGER_WINDOWS:
        mid, dev = s.full("avg", "price", k), s.full("std", "price", k)
        upper, lower = mid + 2 * dev, mid - 2 * dev
        s.out[f"bb_upper_{k}"], s.out[f"bb_lower_{k}"] = upper, lower
        s.out[f"bb_position_{k}"] = F.try_divide(g.p - lower, upper - lower)
    return s


def rsi_stage(g: Grid) -> Stage:
    """Simple-mean RSI, from the first row with a full frame of moves."""
    s = Stage(g)
    k = C.RSI_WINDOW
    gain, loss = s.full("avg", "up", k), s.full("avg", "down", k)
    strength = F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(
        100 - 100 / (1 + F.try_divide(gain, loss))
    )
    s.out["rsi"] = F.when(s.lag(k - 1).isNotNull(), strength)
    return s


def stability_stage(g: Grid) -> Stage:
    s = Stage(g)
    for k in C.STABILITY_WINDOWS:
        s.out[f"luxury_vol_{k}"] = _annual(s.full("std", "ret", k))
    low = s.full("min", "price", C.PREMIUM_WINDOW)
    s.out[f"price_premium_{C.PREMIUM_WINDOW}d"] = F.try_divide(g.p - low, low)
    return s


def tier_stage(g: Grid, tiers) -> Stage:
    """One-hot tier of the asset's whole-series mean price."""
    s = Stage(g)
    whole = g.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s.windows["_mean"] = F.avg(g.price).over(whole)
    s.out = labels.tier_flags(F.col("_mean"), tiers)
    return s


def target_stage(g: Grid, shift: int) -> Stage:
    """``target`` looks ahead by ``-shift`` rows; its percent change looks back."""
    s = Stage(g)
    moved = F.lead(g.price, -shift) if shift < 0 else F.lag(g.price, shift)
    s.windows["_target"] = moved.over(g.w)
    s.out = {"target": F.col("_target"), "target_pct_change": _change(g.p, s.lag(abs(shift)))}
    return s


def apply_stages(df: DataFrame, stages: Iterable[Stage], keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns not rebuilt) followed by the features."""
    stages = list(stages)
    out = {n: c for s in stages for n, c in s.out.items()}
    if keep is None:
        keep = [c for c in df.columns if c not in out]
    cur = df
    for layer in LAYERS:
        columns = {n: c for s in stages for n, c in getattr(s, layer).items()}
        if columns:
            cur = cur.withColumns(columns)
    return cur.select(*keep, *[c.alias(n) for n, c in out.items()])


# ---- exponential means ---------------------------------------------------------


def ema_depth(span: int) -> int:
    """Rows after which a weight has fallen below 1e-17 of the newest one."""
    decay = 1 - 2 / (span + 1)
    return max(1, math.ceil(math.log(1e-17) / math.log(decay))) if decay > 0 else 1


def add_ema(
    df: DataFrame, spans: Iterable[int] = C.EMA_SPANS, g: Grid = Grid(), keep_block: bool = False
) -> DataFrame:
    """Adjusted exponential means and price ratios in linear time.

    Rows are cut into blocks of ``ema_depth`` positions. Inside a block the
    weighted sum is a running sum of prices scaled by ``decay ** -position``;
    the block before adds its closing sum, and older blocks weigh nothing in
    double precision. Positive prices make every step a sum without
    cancellation. Needs a filled grid (no NULL price). ``keep_block`` leaves the column
    ``_block``, where there is one for all spans, for windows that share the sort.
    """
    spans = tuple(spans)
    has_seq = "seq" in df.columns
    cur = df if has_seq else df.withColumn("seq", F.row_number().over(g.w) - 1)
    depth = max(ema_depth(s) for s in spans)
    steepest = max((-math.log(1 - 2 / (s + 1)) for s in spans if s > 1), default=0.0)
    if len(spans) > 1 and depth * steepest > 600:  # scaled weights must fit a double
        for s in spans:
            cur = add_ema(cur, (s,), g)
        return cur if has_seq else cur.drop("seq")
    pos = F.col("_pos")
    cur = cur.withColumns({
        "_block": F.floor(F.col("seq") / depth), "_pos": (F.col("seq") % depth).cast("double"),
    })
    block = Window.partitionBy(g.asset, "_block").orderBy(g.day).rowsBetween(Window.unboundedPreceding, 0)
    decays = {s: 1 - 2 / (s + 1) for s in spans}
    cur = cur.withColumns({
        f"_run_{s}": (
            F.sum(g.p * F.pow(F.lit(1 / q), pos)).over(block) * F.pow(F.lit(q), pos) if q > 0 else g.p
        )
        for s, q in decays.items()
    })
    earlier = replace(g, block="_block").w.rowsBetween(Window.unboundedPreceding, -1)
    closing = F.col("_pos") == depth - 1
    out: dict[str, Column] = {}
    for s, q in decays.items():
        carried = F.last(F.when(closing, F.col(f"_run_{s}")), True).over(earlier)
        total = F.col(f"_run_{s}") + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(q), pos + 1)
        weight = (1 - F.pow(F.lit(q), F.col("seq") + 1)) / (1 - q)
        out[f"ema_{s}"] = total / weight
        out[f"price_over_ema_{s}"] = F.try_divide(g.p, total / weight)
    cur = cur.withColumns(out).drop(*([] if keep_block else ["_block"]), "_pos", *[f"_run_{s}" for s in spans])
    return cur if has_seq else cur.drop("seq")


# ---- single families ----------------------------------------------------------


def add_temporal(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid()) -> DataFrame:
    return df.withColumns(dates.calendar_columns(F.col(g.day), cfg.temporal))


def add_lags(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid()) -> DataFrame:
    return apply_stages(df, [lag_stage(g, cfg.lags)])


def add_rolling(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid()) -> DataFrame:
    return apply_stages(df, [rolling_stage(g, cfg.rolling_windows, cfg.rolling_stats)])


def add_momentum(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid()) -> DataFrame:
    return apply_stages(df, [momentum_stage(g, cfg.change_periods)])


def add_volatility(df: DataFrame, g: Grid = Grid()) -> DataFrame:
    return apply_stages(df, [volatility_stage(g)])


def add_target(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid()) -> DataFrame:
    return apply_stages(df, [target_stage(g, cfg.target_shift)])


def add_features(
    df: DataFrame, cfg: FeatureConfig = FeatureConfig(), g: Grid = Grid(),
    brand: str | None = None, model: str | None = None, texts: dict[str, Column] | None = None,
) -> DataFrame:
    """Every configured family at once, in contract column order.

    ``brand`` and ``model`` name text columns for the brand and keyword flags. ``texts``
    are columns kept beside those of ``df`` and made after the windows, which sort
    narrower rows without them.
    """
    texts = texts or {}
    cur = df
    if cfg.include_technical and "ema" in cfg.indicators:
        cur = add_ema(cur, C.EMA_SPANS, g, keep_block=True)
        if "_block" in cur.columns:
            g = replace(g, block="_block")
    stages: list[Stage] = [Stage(g, spreads=texts)]
    if cfg.include_temporal:
        stages.append(Stage(g, out=dates.calendar_columns(F.col(g.day), cfg.temporal)))
    stages += [
        lag_stage(g, cfg.lags),
        rolling_stage(g, cfg.rolling_windows, cfg.rolling_stats),
        momentum_stage(g, cfg.change_periods),
        volatility_stage(g),
    ]
    if cfg.include_technical:
        if "sma" in cfg.indicators:
            stages.append(sma_stage(g))
        if "ema" in cfg.indicators:
            ema_names = [n for s in C.EMA_SPANS for n in (f"ema_{s}", f"price_over_ema_{s}")]
            stages.append(Stage(g, out={n: F.col(n) for n in ema_names}))
        if "bollinger" in cfg.indicators:
            stages.append(bollinger_stage(g))
        if "rsi" in cfg.indicators:
            stages.append(rsi_stage(g))
    if cfg.include_asset_groups:
        if "luxury_tier" in cfg.groups:
            stages.append(tier_stage(g, cfg.tiers))
        if "brand_features" in cfg.groups and brand and model:
            stages.append(Stage(g, out={
                **labels.premium_flags(F.col(brand), cfg.premium_brands),
                **labels.keyword_flags(F.col(model)),
            }))
        if "seasonality" in cfg.groups:
            stages.append(Stage(g, out=dates.season_columns(F.col(g.day))))
        if "price_stability" in cfg.groups:
            stages.append(stability_stage(g))
    stages.append(target_stage(g, cfg.target_shift))
    names = [n for s in stages for n in s.out]
    keep = [c for c in [*df.columns, *texts] if c not in names and c != "seq"]
    return apply_stages(cur, stages, keep)


# ---- horizons, sequences --------------------------------------------------------


def target_name(horizon: int, base: str = "target") -> str:
    if horizon < 1:
        raise ValueError("horizon must be a positive integer")
    return base if horizon == 1 else f"{base}_h{horizon}"


def horizon_dataset(df: DataFrame, horizon: int, g: Grid = Grid(), base: str = "target") -> DataFrame:
    """Rows with a known price ``horizon`` rows ahead in the same asset."""
    name = target_name(horizon, base)
    if name not in df.columns:
        df = df.withColumn(name, F.lead(g.price, horizon).over(g.w))
    return df.filter(F.col(name).isNotNull())


def sequences(
    df: DataFrame, length: int = 30, g: Grid = Grid(), columns: tuple[str, ...] | None = None
) -> DataFrame:
    """The ``length`` rows before each row, and that row's price as label."""
    cols = columns or (g.price,)
    item = F.col(cols[0]) if len(cols) == 1 else F.array(*cols)
    prior = F.collect_list(item).over(g.w.rowsBetween(-length, -1))
    return (
        df.select(g.asset, g.day, prior.alias("window"), g.p.alias("label"))
        .filter(F.size("window") == length)
    )
