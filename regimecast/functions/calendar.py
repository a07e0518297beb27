"""Timestamp parsing, calendar parts and cyclical encodings as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-first formats tried in this order.
DAY_FIRST_FORMATS = (
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "dd.MM.yyyy HH:mm",
    "dd-MM-yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyyMMdd HH:mm",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd",
)


def naive(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def _shape(fmt: str) -> str:
    """The strings a format of plain two- and four-digit fields can read, as a regular expression."""
    return "^" + re.sub(r"([a-zA-Z])\1*", lambda m: rf"\d{{{len(m[0])}}}", re.sub(r"([.])", r"\\\1", fmt)) + "$"


def parse_mixed(column: str | Column, formats: Sequence[str] = DAY_FIRST_FORMATS) -> Column:
    """The first format that fits; null when none does. Only formats of the string's shape are tried."""
    column = F.col(column) if isinstance(column, str) else column
    return naive(
        F.coalesce(*[F.when(column.rlike(_shape(f)), F.try_to_timestamp(column, F.lit(f))) for f in formats])
    )


def parse_fixed(column: str | Column, fmt: str) -> Column:
    return naive(F.to_timestamp(column, fmt))


def date_plus_hour(day: str | Column, hour: str | Column) -> Column:
    """Hour of day numbered 1 to 24: hour 1 starts at midnight."""
    day = F.col(day) if isinstance(day, str) else day
    hour = F.col(hour) if isinstance(hour, str) else hour
    return naive(day.cast("timestamp") + F.make_interval(hours=hour - 1))


def from_parts(year, month, day, hour, minute) -> Column:
    return naive(F.make_timestamp(year, month, day, hour, minute, F.lit(0)))


def hour_number(ts: str | Column) -> Column:
    """Whole hours since the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def calendar_parts(ts: str | Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
    }


def is_weekend(ts: str | Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cyclical(name: str, value: Column, period: float) -> dict[str, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def time_features(ts: str | Column) -> dict[str, Column]:
    """Calendar parts with hour, week-day and day-of-year (365) on the circle."""
    parts = calendar_parts(ts)
    return {
        **parts,
        **cyclical("hour", parts["hour"], 24),
        **cyclical("day_of_week", parts["day_of_week"], 7),
        **cyclical("day_of_year", parts["day_of_year"], 365),
    }


def table_time_features(ts: str | Column) -> dict[str, Column]:
    """The twelve calendar columns of a processed table (day of year over 365.25, month over 12)."""
    parts = calendar_parts(ts)
    del parts["year"]
    return {
        **parts,
        "is_weekend": is_weekend(ts),
        **cyclical("hour", parts["hour"], 24),
        **cyclical("day", parts["day_of_year"], 365.25),
        **cyclical("month", parts["month"], 12),
    }


def span_days(first: Column, last: Column) -> Column:
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)
