"""Radiometric and spectral expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._clip import clip


def normalised_difference(a: Column, b: Column) -> Column:
    """``(a - b) / (a + b)`` within [-1, 1]; null where the sum is 0."""
    return clip((a - b) / F.nullif(a + b, F.lit(0.0)), -1.0, 1.0)


def band(spectrum: Column, index: int) -> Column:
    """A band by position; null if the sensor has no such band."""
    return F.get(spectrum, F.lit(index))


def ndvi(red: Column, nir: Column) -> Column:
    return normalised_difference(nir, red)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalised_difference(swir, nir)


def evi(blue: Column, red: Column, nir: Column) -> Column:
    """Enhanced vegetation index, not clipped."""
    return 2.5 * (nir - red) / F.nullif(nir + 6.0 * red - 7.5 * blue + 1.0, F.lit(0.0))


def scaled(raw: Column, factor: float, offset: float = 0.0, fill: float | None = None, floor: float | None = None) -> Column:
    """Digital numbers to physical values; ``fill`` becomes null."""
    value = (raw if fill is None else F.nullif(raw, F.lit(fill))) * factor + offset
    return value if floor is None else F.greatest(value, F.lit(floor))


def earth_sun_distance(day_of_year: Column) -> Column:
    """Astronomical units."""
    return 1 - 0.01672 * F.cos(F.radians(0.9856 * (day_of_year - 4)))


def toa_reflectance(radiance: Column, distance: Column, irradiance: Column, zenith_deg: Column, strict: bool = False) -> Column:
    """``pi L d^2 / (E cos z)``; null, or an error if ``strict``, where the
    sun is down or the irradiance isn't positive."""
    down = F.cos(F.radians(zenith_deg))
    bad = F.raise_error(F.lit("sun below the horizon or no irradiance")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((down <= 0) | (irradiance <= 0), bad).otherwise(math.pi * radiance * distance * distance / (irradiance * down))


def surface_reflectance(radiance: Column, xa: Column, xb: Column, xc: Column) -> Column:
    """Correction by three coefficients; 0 where the denominator vanishes."""
    y = xa * radiance - xb
    return F.when(F.abs(1 + xc * y) > 1e-6, y / (1 + xc * y)).otherwise(F.lit(0.0))


def angstrom(tau1: Column, wave1: float, tau2: Column, wave2: float, wave: float) -> Column:
    """Optical depth at ``wave`` from two others by the Angstrom exponent."""
    exponent = -F.ln(tau1 / tau2) / math.log(wave1 / wave2)
    return tau1 * F.pow(F.lit(wave / wave1), -exponent)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def degrees_to_metres(dlat: Column, dlon: Column, lat: Column) -> tuple[Column, Column]:
    return dlat * 111_320.0, dlon * 111_320.0 * F.cos(F.radians(lat))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_nanometres(wave: Column) -> Column:
    """Values below 100 are micrometres."""
    return F.when(wave < 100, wave * 1000.0).otherwise(wave)


def wavelength_weights(waves: Column) -> Column:
    """Normalised central differences of an ascending array (ends one-sided)."""
    n = F.size(waves)
    at = lambda i: F.get(waves, i)
    step = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (at(F.least(i + 1, n - 1)) - at(F.greatest(i - 1, F.lit(0)))) / (F.least(i + 1, n - 1) - F.greatest(i - 1, F.lit(0))),
    )
    return F.transform(step, lambda d: d / F.aggregate(step, F.lit(0.0), lambda s, x: s + x))


def band_count_norm(volumes: Column, bands: int) -> Column:
    """Volume ``m`` (from 1) over ``bands ** (m / 2)``."""
    return F.transform(volumes, lambda v, i: v / F.pow(F.lit(float(bands)), (i + 1) / 2))


def scalar_reduction(volumes: Column) -> Column:
    """The largest volume from the third on."""
    return F.array_max(F.slice(volumes, 3, F.greatest(F.size(volumes) - 2, F.lit(0))))
