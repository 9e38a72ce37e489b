"""Geometry on the sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Length of one degree of latitude on that sphere.
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180
#: Where points count as lying in the covered country, for stations and for the quality gate.
STATION_BOX = (20.0, 46.0, 122.0, 154.0)
GATE_BOX = (20.0, 45.8, 122.8, 154.1)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would pass over a null


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = STATION_BOX) -> Column:
    """False, never null, for missing or NaN coordinates."""
    ok = lat.between(box[0], box[1]) & lng.between(box[2], box[3])
    return F.coalesce(ok, F.lit(False))


def finite(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def round_half_up(c: Column, unit: float) -> Column:
    """Integer multiples of 1/unit, halves towards plus infinity."""
    return F.floor(c * F.lit(unit) + 0.5).cast("long")


def accuracy_of_scale(scale: Column) -> Column:
    """Maps of scale 1:500 and larger count as surveyed."""
    return F.when((scale > 0) & (scale <= 500), "surveyed").otherwise("legacy")
