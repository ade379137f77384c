"""Times as numbers (all in UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S, YEAR_DAYS = 86_400, 365.25
YEAR_S = YEAR_DAYS * DAY_S


def micros(ts: Column) -> Column:
    """Microseconds since 1970; takes timestamps with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / 1e6


def _year_start(year: Column) -> Column:
    return F.unix_micros(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp"))


def fractional_year(ts: Column) -> Column:
    """Year plus the elapsed share of it; leap years have their own length."""
    year = F.year(ts)
    start = _year_start(year)
    return year + (micros(ts) - start) / (_year_start(year + 1) - start)


def approximate_year(ts: Column) -> Column:
    """Year plus (day of year - 1) / 365.25."""
    return F.year(ts) + (F.dayofyear(ts) - 1) / YEAR_DAYS


def relative_years(ts: Column, origin: Column) -> Column:
    return (micros(ts) - micros(origin)) / (YEAR_S * 1e6)


def year_month(frac: Column) -> Column:
    """``YYYY-MM`` of a fractional year."""
    year = F.floor(frac)
    month = F.least(F.lit(12), F.floor((frac - year) * 12) + 1)
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def cyclic(phase: Column) -> tuple[Column, Column]:
    """Sine and cosine of a phase given in turns."""
    return F.sin(2 * math.pi * phase), F.cos(2 * math.pi * phase)


def day_of_year_phase(ts: Column) -> Column:
    return F.dayofyear(ts) / YEAR_DAYS


def time_of_day_phase(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(DAY_S * 1_000_000)) / (DAY_S * 1e6)


def fourier_features(value: Column, octaves: int = 10) -> Column:
    """``sin, cos`` of ``2^i pi v`` for each octave, end to end."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(octaves - 1)), lambda i: F.pow(F.lit(2.0), i) * math.pi * value)
    return F.flatten(F.transform(angles, lambda a: F.array(F.sin(a), F.cos(a))))


def decay_weight(age: Column, rate: float) -> Column:
    """``1 - exp(-rate * age)``: older observations weigh more."""
    return 1 - F.exp(-rate * age)


def season(ts: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    names = F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON")))
    return F.element_at(names, (F.floor(F.pmod(F.month(ts), F.lit(12)) / 3) + 1).cast("int"))
