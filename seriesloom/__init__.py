"""Price-series analytics on Spark DataFrames."""

from seriesloom.config import FeatureConfig, PrepConfig, SeriesConfig, SplitConfig, TrainConfig

__all__ = ["FeatureConfig", "PrepConfig", "SeriesConfig", "SplitConfig", "TrainConfig"]
