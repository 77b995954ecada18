"""Planar distance between coordinates in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree, miles per kilometre.
KM_PER_DEGREE = 111.0
MILES_PER_KM = 0.6214


def planar_distance_km(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    """Straight-line distance of two named points, one degree taken as 111 km in both directions."""
    north = f"((double({lat1}) - double({lat2})) * {KM_PER_DEGREE}D)"
    east = f"((double({lng1}) - double({lng2})) * {KM_PER_DEGREE}D)"
    return F.expr(f"sqrt({north} * {north} + {east} * {east})")
