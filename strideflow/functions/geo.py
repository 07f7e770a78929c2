"""Great-circle distance and the grid used by radius joins, as SQL expressions.

Arguments are SQL texts (column names or literals). A whole formula is one expression, which is
parsed in one step; building it operator by operator from Python costs a round trip for each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideflow.schemas import EARTH_RADIUS_KM

METRES_PER_DEGREE = EARTH_RADIUS_KM * 1000.0 * math.pi / 180.0


def double(value: float) -> str:
    return f"{float(value)!r}D"


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Metres between two points; null where a coordinate is missing."""
    half_lat, half_lng = f"sin(radians({lat2} - {lat1}) / 2D)", f"sin(radians({lng2} - {lng1}) / 2D)"
    h = f"({half_lat} * {half_lat} + {half_lng} * {half_lng} * cos(radians({lat1})) * cos(radians({lat2})))"
    # Rounding may lift h above 1 for opposite points.
    return f"{double(2.0 * EARTH_RADIUS_KM)} * atan2(sqrt({h}), sqrt(greatest(1D - {h}, 0D))) * 1000D"


def haversine_m(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    return F.expr(haversine_sql(lat1, lng1, lat2, lng2))


def within_sql(lat1: str, lng1: str, lat2: str, lng2: str, distance_m: float, compare: str = "<") -> str:
    """Condition that two points are less than (or at most) ``distance_m`` apart.

    Latitudes alone rule most pairs out before the trigonometry; the margin keeps that test on
    the safe side of rounding.
    """
    degrees = distance_m / METRES_PER_DEGREE * (1 + 1e-6) + 1e-9
    return (
        f"abs({lat1} - {lat2}) <= {double(degrees)}"
        f" AND {haversine_sql(lat1, lng1, lat2, lng2)} {compare} {double(distance_m)}"
    )


def nearer_sql(left: str, right: str, distance_m: float) -> str:
    """``within_sql`` for rows with ``…latitude``, ``…longitude`` and ``…cos_lat`` (cosine of latitude).

    Replacing the sine of half an angle by the half angle gives a sum of squares that is never
    below the exact term and, within one degree, less than 0.01 % above it. Nearly all pairs are
    decided by it with a few multiplications; the others get the exact distance.
    """
    dlat, dlng = f"({left}latitude - {right}latitude)", f"({left}longitude - {right}longitude)"
    squares = f"({dlat} * {dlat} + {dlng} * {dlng} * {left}cos_lat * {right}cos_lat)"
    # Squared degrees of whole angles on both sides.
    half_angle = math.sin(min(distance_m / (2000.0 * EARTH_RADIUS_KM), math.pi / 2))
    bound = (2.0 * half_angle * 180.0 / math.pi) ** 2
    surely = f"{squares} < {double(bound * (1 - 1e-9))}"
    never = f"({squares} > {double(bound * 1.001)} AND abs({dlat}) < 1D AND abs({dlng}) < 1D)"
    exact = within_sql(f"{left}latitude", f"{left}longitude", f"{right}latitude", f"{right}longitude", distance_m)
    return f"({surely} OR (NOT {never} AND {exact}))"


def latitude_band(lat: str, cell_m: float) -> str:
    return f"floor(({lat} + 90D) / {double(cell_m / METRES_PER_DEGREE)})"


def band_columns(band: str, cell_m: float) -> str:
    """How many longitude cells of at least ``cell_m`` metres fit around a latitude band."""
    step = double(cell_m / METRES_PER_DEGREE)
    south = f"(CAST({band} AS DOUBLE) * {step} - 90D)"
    widest = f"least(greatest(abs({south}), abs({south} + {step})), 90D)"
    around = double(360.0 * METRES_PER_DEGREE / cell_m)
    return f"greatest(floor({around} * cos(radians({widest}))), 1L)"


def longitude_cell(lng: str, columns: str) -> str:
    """Cell number before wrapping; apply ``pmod(…, columns)`` to join across the date line."""
    return f"floor(({lng} + 180D) / 360D * CAST({columns} AS DOUBLE))"
