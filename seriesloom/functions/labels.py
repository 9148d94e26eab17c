"""Tiers, keyword flags, display formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.config import DRESS_KEYWORDS, PREMIUM_BRANDS, SPORTS_KEYWORDS, TIERS


def tier(value: Column, tiers=TIERS) -> Column:
    """First tier whose half-open range holds the value, else ``unknown``."""
    out = F.lit("unknown")
    for name, low, high in reversed(tiers):
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= F.lit(float(low)))
        if high is not None:
            inside = inside & (value < F.lit(float(high)))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def tier_flags(value: Column, tiers=TIERS) -> dict[str, Column]:
    label = tier(value, tiers)
    return {f"tier_{name}": (label == name).cast("int") for name, _, _ in tiers}


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def premium_flags(brand: Column, premium=PREMIUM_BRANDS) -> dict[str, Column]:
    slug = F.replace(F.lower(F.coalesce(brand, F.lit(""))), F.lit(" "), F.lit("_"))
    flag = _contains_any(slug, [p.lower() for p in premium]).cast("int")
    return {"brand_tier_premium": flag, "brand_tier_non_premium": F.lit(1) - flag}


def keyword_flags(model: Column, sports=SPORTS_KEYWORDS, dress=DRESS_KEYWORDS) -> dict[str, Column]:
    """Keywords match whether words are joined by blanks or underscores."""
    text = F.replace(F.lower(F.coalesce(model, F.lit(""))), F.lit(" "), F.lit("_"))
    return {
        "is_sports_watch": _contains_any(text, sports).cast("int"),
        "is_dress_watch": _contains_any(text, dress).cast("int"),
    }


def delta(prediction: Column, current: Column) -> tuple[Column, Column]:
    """Absolute and percent change; no percent for a zero base."""
    diff = prediction - current
    return diff, F.try_divide(diff, current) * 100


def currency(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.lit("S$"), F.format_number(value, 2))
    )


def signed_currency(value: Column) -> Column:
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit("-"))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(
        F.concat(sign, F.lit("S$"), F.format_number(F.abs(value), 2))
    )


def signed_percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_string("%+.2f%%", value))


def metric_text(metric: Column, value: Column, precision: int = 4) -> Column:
    """Percent style for shares, fixed decimals otherwise, N/A when missing."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    percent = metric.contains("percentage") | metric.contains("accuracy") | metric.contains("mape")
    return (
        F.when(bad, F.lit("N/A"))
        .when(percent, F.format_string("%.2f%%", value))
        .otherwise(F.format_string(f"%.{precision}f", value))
    )


def priority(name: Column, order: tuple[str, ...]) -> Column:
    """Sort key of a listed name; unlisted names come last."""
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    return F.coalesce(F.try_element_at(ranks, name), F.lit(len(order)))
