"""Planar and spherical geometry as column expressions, and grid-cell keys for spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

# Origin and scale of the local metric projection.
LAT0, LON0, METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 17.4, 78.45, 111320.0, 110540.0
KX = METRES_PER_DEGREE_LON * math.cos(math.radians(LAT0))
KY = METRES_PER_DEGREE_LAT
EARTH_RADIUS_M = 6371000.0


def project_x(lon) -> Column:
    return (col(lon) - LON0) * KX


def project_y(lat) -> Column:
    return (col(lat) - LAT0) * KY


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((col(x2) - col(x1)) * (col(x2) - col(x1)) + (col(y2) - col(y1)) * (col(y2) - col(y1)))


def distance_to_line(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to the line piece a-b (projection clamped to the ends)."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    share = ((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (ax + share * dx), py - (ay + share * dy)
    return F.sqrt(ex * ex + ey * ey)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(half))


def point_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"cell_x": F.floor(F.col(x) / size), "cell_y": F.floor(F.col(y) / size)})


def covering_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, reach: float, size: float) -> DataFrame:
    """One row per cell that the bounding box of a line piece, widened by ``reach``, touches.

    A point within ``reach`` of the piece always lies in one of these cells, and looks up only its own cell, so the join is an
    equi-join that meets every pair once.
    """
    def cells(a, b):
        return F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size))

    return (df.withColumn("cell_x", F.explode(cells(F.col(x1), F.col(x2))))
              .withColumn("cell_y", F.explode(cells(F.col(y1), F.col(y2)))))
