"""Calendar features of a timestamp column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_marks(ts: str = "ts", with_hour: bool = True) -> list[Column]:
    """Integer month, day, weekday (Monday = 0) and hour; the hour is 0 for daily data."""
    return [
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.weekday(ts).alias("weekday"),
        (F.hour(ts) if with_hour else F.lit(0)).alias("hour"),
    ]


def _unit(value: Column, offset: int, span: int) -> Column:
    return (value - F.lit(offset)) / F.lit(float(span)) - F.lit(0.5)


def second_of_minute(ts: str) -> Column:
    return _unit(F.second(ts), 0, 59)


def minute_of_hour(ts: str) -> Column:
    return _unit(F.minute(ts), 0, 59)


def hour_of_day(ts: str) -> Column:
    return _unit(F.hour(ts), 0, 23)


def day_of_week(ts: str) -> Column:
    return _unit(F.weekday(ts), 0, 6)


def day_of_month(ts: str) -> Column:
    return _unit(F.dayofmonth(ts), 1, 30)


def day_of_year(ts: str) -> Column:
    return _unit(F.dayofyear(ts), 1, 365)


def month_of_year(ts: str) -> Column:
    return _unit(F.month(ts), 1, 11)


def week_of_year(ts: str) -> Column:
    return _unit(F.weekofyear(ts), 1, 52)


FEATURES = {
    "second_of_minute": second_of_minute,
    "minute_of_hour": minute_of_hour,
    "hour_of_day": hour_of_day,
    "day_of_week": day_of_week,
    "day_of_month": day_of_month,
    "day_of_year": day_of_year,
    "month_of_year": month_of_year,
    "week_of_year": week_of_year,
}

_DAILY = ["day_of_week", "day_of_month", "day_of_year"]

# Calendar features used at each sampling frequency.
BY_FREQUENCY = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": _DAILY,
    "B": _DAILY,
    "H": ["hour_of_day", *_DAILY],
    "T": ["minute_of_hour", "hour_of_day", *_DAILY],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", *_DAILY],
}

# Other spellings of the frequency units.
UNIT_ALIASES = {"A": "Y", "YE": "Y", "QE": "Q", "ME": "M", "MIN": "T"}


def frequency_unit(freq: str) -> str:
    """Unit of a frequency string such as ``h``, ``15min``, ``W-SUN`` or ``3D``."""
    match = re.fullmatch(r"\s*\d*\s*([A-Za-z]+)(-[A-Za-z]+)?\s*", freq)
    unit = match.group(1) if match else ""
    unit = "M" if unit in ("m", "M") else unit.upper()
    unit = UNIT_ALIASES.get(unit, unit)
    if unit not in BY_FREQUENCY:
        raise ValueError(f"unsupported frequency {freq!r}; known units: {sorted(BY_FREQUENCY)}")
    return unit


def time_features(freq: str, ts: str = "ts") -> list[Column]:
    """Calendar features that suit a sampling frequency, each scaled to [-0.5, 0.5]."""
    return [FEATURES[name](ts).alias(name) for name in BY_FREQUENCY[frequency_unit(freq)]]


def position_code(position: Column, dims: int) -> list[Column]:
    """Sine on even and cosine on odd dimensions, wavelengths growing geometrically to 10000."""
    out = []
    for d in range(dims):
        angle = position * F.lit(10000.0 ** (-(d - d % 2) / dims))
        out.append((F.cos(angle) if d % 2 else F.sin(angle)).alias(f"pos_{d}"))
    return out
