"""Spatio-temporal neighbourhoods as a bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions.geo import haversine_m, nearer_sql
from strideflow.operators.timeline import floor_div, floor_sql
from strideflow.schemas import MAX_DISTANCE_M, MAX_TIME_DIFFERENCE_MS, STREAM_KEYS


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], distance_m: float, time_ms: int,
               how: str = "inner") -> DataFrame:
    """Pairs of one stream with ``|dt| < time_ms``, ``dt <> 0`` and distance below ``distance_m``.

    Equi-join on stream and time bucket: a left row looks into the two or three buckets it can
    reach, so no bucket holds more than ``time_ms`` rows and none is compared with the whole
    stream. Left columns get the prefix ``l_``, right columns ``r_``. Hand in the smaller side
    as ``left``, it is the one that is repeated. With ``how="left"`` each repetition of a left
    row that finds nothing is kept, without right columns.
    """
    reach = time_ms - 1
    first, last = floor_sql(f"timestamp - {reach}L", time_ms), floor_sql(f"timestamp + {reach}L", time_ms)
    cos_lat = F.expr("cos(radians(latitude))")
    probes = left.select(
        *keys, F.expr(f"explode(sequence({first}, {last}))").alias("bucket"),
        *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys], cos_lat.alias("l_cos_lat"),
    )
    targets = right.select(
        *[F.col(k).alias(f"r_{k}") for k in keys], floor_div("timestamp", time_ms).alias("r_bucket"),
        *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], cos_lat.alias("r_cos_lat"),
    )
    same = " AND ".join(f"{k} = r_{k}" for k in [*keys, "bucket"])
    near = nearer_sql("l_", "r_", distance_m)
    apart = f"abs(l_timestamp - r_timestamp) BETWEEN 1 AND {reach}"
    joined = probes.join(targets, F.expr(f"{same} AND {apart} AND {near}"), how)
    return joined.drop("bucket", "r_bucket", "l_cos_lat", "r_cos_lat", *[f"r_{k}" for k in keys])


def st_neighbours(traces: DataFrame, distance_m: float = MAX_DISTANCE_M, time_ms: int = MAX_TIME_DIFFERENCE_MS,
                  keys: list[str] = STREAM_KEYS) -> DataFrame:
    """One row per ordered pair of neighbours; a record is not its own neighbour."""
    points = traces.select(*keys, "timestamp", "latitude", "longitude")
    pairs = near_pairs(points, points, keys, distance_m, time_ms)
    return pairs.select(
        *keys, F.col("l_timestamp").alias("timestamp"), F.col("r_timestamp").alias("neighbour_ts"),
        haversine_m("l_latitude", "l_longitude", "r_latitude", "r_longitude").alias("distance_m"),
    )
