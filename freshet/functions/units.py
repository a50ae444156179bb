"""Unit conversions between discharge, depth over the basin, and volume.

An area of zero gives null: a plain division would stop the job under ANSI rules.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion constants the published products are built on.
SECONDS_PER_DAY = 86400
FEET_PER_KM = 3280.84
MM_PER_KM = 1e6
CUBIC_MM_PER_DAY_IN_CFS = 4.08735e-13
SQ_MM_PER_SQ_KM = 1e12
CUBIC_FEET_PER_ACRE_FOOT = 43559.9
ACRES_PER_SQ_KM = 247.105
MM_PER_FOOT = 304.8
MISSING_AREA_FACTOR = 99999.0


def cfs_to_mm_usgs(q: Column, km2: Column) -> Column:
    """Cubic feet per second to millimetres per day over a basin of km2."""
    return F.try_divide(q * SECONDS_PER_DAY, km2 * FEET_PER_KM**3) * MM_PER_KM


def cms_to_mm(q: Column, km2: Column) -> Column:
    """Cubic metres per second to mm/day; an unknown area gives the sentinel factor."""
    factor = F.try_divide(F.lit(SECONDS_PER_DAY * 1e9), km2 * SQ_MM_PER_SQ_KM)
    return q * F.when(km2.isNull(), MISSING_AREA_FACTOR).otherwise(factor)


def cfs_to_mm_sensor(q: Column, km2: Column) -> Column:
    return F.try_divide(q / CUBIC_MM_PER_DAY_IN_CFS, SQ_MM_PER_SQ_KM * km2)


def cfs_to_acft_day(q: Column) -> Column:
    return q * SECONDS_PER_DAY / CUBIC_FEET_PER_ACRE_FOOT


def mm_to_cfs(depth: Column, km2: Column) -> Column:
    return depth * CUBIC_MM_PER_DAY_IN_CFS * SQ_MM_PER_SQ_KM * km2


def mm_to_acft(depth: Column, km2: Column) -> Column:
    return depth * km2 * ACRES_PER_SQ_KM / MM_PER_FOOT
