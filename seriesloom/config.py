"""Configuration values, one frozen dataclass per stage.

Defaults are the shipped run settings. Feature columns are a pure function of
``FeatureConfig``, so the output schema is known before any job runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- Fixed values: must equal the compared system for equal results ----------

TIERS: tuple[tuple[str, float | None, float | None], ...] = (
    ("entry", 0.0, 5000.0),
    ("mid", 5000.0, 20000.0),
    ("high", 20000.0, 100000.0),
    ("ultra", 100000.0, None),
)
PREMIUM_BRANDS: tuple[str, ...] = (
    "rolex",
    "patek_philippe",
    "audemars_piguet",
    "omega",
    "cartier",
    "hublot",
)
SPORTS_KEYWORDS: tuple[str, ...] = (
    "speedmaster", "submariner", "daytona", "gmt", "diver", "chrono",
)
DRESS_KEYWORDS: tuple[str, ...] = (
    "calatrava", "master", "patrimony", "royal_oak", "nautilus",
)
MODEL_ORDER: tuple[str, ...] = ("ridge", "lightgbm", "xgboost", "linear", "random_forest")
MOMENTUM_WINDOWS: tuple[int, ...] = (5, 10, 20)
VOLATILITY_WINDOWS: tuple[int, ...] = (5, 10, 20, 30)
SMA_WINDOWS: tuple[int, ...] = (5, 10, 20, 50)
EMA_SPANS: tuple[int, ...] = (5, 10, 20)
BOLLINGER_WINDOWS: tuple[int, ...] = (10, 20)
RSI_WINDOW = 14
STABILITY_WINDOWS: tuple[int, ...] = (3, 5, 10)
PREMIUM_WINDOW = 30
TRADING_DAYS = 252
HOLIDAY_MONTHS: tuple[int, ...] = (11, 12, 1)
FAIR_MONTHS: tuple[int, ...] = (3, 4)

# ------------------------------------------------------------------------------

FILL_METHODS = ("linear", "forward", "backfill")


@dataclass(frozen=True)
class SeriesConfig:
    """Column names of a long price table."""

    asset: str = "asset_id"
    ts: str = "ts"
    price: str = "price"
    tie: str = "tie"


@dataclass(frozen=True)
class PrepConfig:
    """Cleaning and resampling."""

    frequency: str = "D"
    min_points: int = 30
    fill_method: str = "linear"
    fill_limit: int = 5
    remove_outliers: bool = False
    outlier_method: str | None = "iqr"
    outlier_threshold: float = 3.0
    max_missing_percent: float = 20.0

    def __post_init__(self) -> None:
        if self.frequency not in ("D", "W"):
            raise ValueError(f"frequency must be D or W, got {self.frequency!r}")
        if self.fill_method == "backward":
            object.__setattr__(self, "fill_method", "backfill")
        if self.fill_method not in FILL_METHODS:
            raise ValueError(
                f"fill_method must be one of {FILL_METHODS}, got {self.fill_method!r}"
            )


@dataclass(frozen=True)
class FeatureConfig:
    """Which feature columns are built."""

    lags: tuple[int, ...] = (5, 7, 14, 30)
    rolling_windows: tuple[int, ...] = (5, 7, 14, 30)
    rolling_stats: tuple[str, ...] = ("mean", "std")
    change_periods: tuple[int, ...] = (5, 7, 14, 30)
    # Fixed values, in the published order.
    indicators: tuple[str, ...] = ("ema", "rsi", "bollinger")
    temporal: tuple[str, ...] = ("day_of_week", "month", "quarter", "is_weekend")
    groups: tuple[str, ...] = (
        "luxury_tier", "seasonality", "price_stability", "brand_features",
    )
    include_temporal: bool = True
    include_technical: bool = True
    include_asset_groups: bool = True
    target_shift: int = -1
    tiers: tuple[tuple[str, float | None, float | None], ...] = TIERS
    premium_brands: tuple[str, ...] = PREMIUM_BRANDS


@dataclass(frozen=True)
class SplitConfig:
    """Temporal split shares."""

    test_size: float = 0.2
    val_size: float = 0.1
    min_rows: int = 20


@dataclass(frozen=True)
class TrainConfig:
    """Model grid and hyper-parameters."""

    horizons: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    models: tuple[str, ...] = ("lightgbm", "xgboost", "random_forest", "linear", "ridge")
    split: SplitConfig = field(default_factory=SplitConfig)
    seed: int = 42
    max_samples: int | None = None
    trees: int = 100
    bootstrap: bool = True
    learning_rate: float = 0.1
    boost_depth: int = 6
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    leaves: int = 31
    leafwise_depth: int | None = None
    leafwise_least_rows: int = 20
    leafwise_lambda: float = 0.0
    patience: int | None = 10
    forest_depth: int = 30  # the library's limit; the published setting has none
    ridge_alpha: float = 1.0
    lasso_alpha: float = 1.0
