"""Bit-packed quality flags; ``True`` means invalid throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_bit(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def aerosol_level(flags: Column) -> Column:
    """Bits 6 and 7."""
    return F.shiftright(flags, 6).bitwiseAND(F.lit(3))


AEROSOL_LIMITS = {"low": 1, "medium": 2, "high": 3}


def hls_invalid(flags: Column, zenith: Column, reject: int, aerosol: str | None, min_sun: float) -> Column:
    """Rejected bits, too much aerosol, or the sun below ``min_sun`` degrees
    (unknown zenith counts as too low)."""
    bad = any_bit(flags, reject)
    if aerosol is not None:
        bad = bad | (aerosol_level(flags) > AEROSOL_LIMITS[aerosol])
    return bad | F.coalesce(90.0 - zenith < min_sun, F.lit(True))


def landsat_invalid(qa: Column, saturation: Column, aerosol: Column, sun_elevation: Column, reject: int, allowed: list[int], min_sun: float) -> Column:
    return (sun_elevation < min_sun) | any_bit(qa, reject) | (saturation != 0) | ~aerosol.isin(allowed)


def hyperspectral_invalid(cloud: Column, cirrus: Column, zenith: Column, aod: Column, uncertainty: Column, good: Column, min_sun: float, max_aod: float = 0.3, max_uncertainty: float = 0.1) -> Column:
    """Clouds, a low or unknown sun, much aerosol, or a good band whose
    uncertainty reaches the limit."""
    worst = F.array_max(F.filter(F.zip_with(uncertainty, good, lambda u, g: F.when(g, u)), lambda u: u.isNotNull()))
    sun = zenith.isNull() | (zenith == -9999) | (zenith > 90.0 - min_sun)
    return (cloud != 0) | (cirrus != 0) | sun | F.coalesce(aod >= max_aod, F.lit(False)) | F.coalesce(worst >= max_uncertainty, F.lit(False))


def with_polarity(invalid: Column, true_means: str = "invalid") -> Column:
    return invalid if true_means == "invalid" else ~invalid


def out_of_range(spectrum: Column, low: float = 0.0, high: float | None = None) -> Column:
    """Whether any band lies below ``low`` or above ``high``."""
    return F.exists(spectrum, lambda v: (v < low) | (F.lit(False) if high is None else v > high))
