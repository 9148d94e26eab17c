"""Date expressions. Every function maps columns to columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.config import FAIR_MONTHS, HOLIDAY_MONTHS


def day_of_week(d: Column) -> Column:
    """Monday = 0."""
    return F.weekday(d)


def cycle(x: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = x * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar_columns(d: Column, wanted: tuple[str, ...]) -> dict[str, Column]:
    """Calendar features by name; cyclic pairs come with their base column."""
    simple = {
        "quarter": lambda: F.quarter(d),
        "day_of_month": lambda: F.dayofmonth(d),
        "year": lambda: F.year(d),
        "is_month_start": lambda: F.dayofmonth(d) == 1,
        "is_month_end": lambda: F.last_day(d) == d,
        "is_quarter_start": lambda: F.trunc(d, "quarter") == d,
        "is_quarter_end": lambda: F.trunc(F.date_add(d, 1), "quarter") == F.date_add(d, 1),
    }
    cyclic = {"day_of_week": (day_of_week, 7), "month": (F.month, 12)}
    out: dict[str, Column] = {}
    for name in wanted:
        if name in cyclic:
            base, period = cyclic[name]
            out[name] = base(d)
            out[f"{name}_sin"], out[f"{name}_cos"] = cycle(base(d), period)
        elif name == "is_weekend":
            out.setdefault("day_of_week", day_of_week(d))
            out[name] = day_of_week(d) >= 5
        elif name in simple:
            out[name] = simple[name]()
        else:
            raise ValueError(f"unknown calendar feature {name!r}")
    return out


def season_columns(d: Column) -> dict[str, Column]:
    return {
        "is_holiday_season": F.month(d).isin(*HOLIDAY_MONTHS),
        "is_watch_fair_season": F.month(d).isin(*FAIR_MONTHS),
    }


def horizon_date(d: Column, horizon: Column) -> Column:
    return F.date_add(d, horizon.cast("int"))


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parse_date(text: Column, strict: bool = False) -> Column:
    """Strict parsing fails the job on bad text; otherwise bad text is NULL."""
    return text.cast("date") if strict else text.try_cast("date")


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def epoch_day(seconds: Column) -> Column:
    """UTC day of an epoch-second count (session zone is UTC)."""
    return F.to_date(F.timestamp_seconds(seconds))


def bucket_day(ts: Column, frequency: str) -> Column:
    """Calendar bucket: the day, or the Sunday that ends the week."""
    day = F.to_date(ts)
    return day if frequency == "D" else F.next_day(F.date_sub(day, 1), "SUN")
