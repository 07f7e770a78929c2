"""Accelerometer, motion and combined feature vectors, one row per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.functions.geo import double, haversine_sql
from strideflow.operators.poi import count_around, poi_tf
from strideflow.operators.segments import WINDOW
from strideflow.schemas import MIN_WINDOW_RECORDS, NOISE_CLUSTER, PEAK_RATIO, POI_RADIUS_M, STREAM_KEYS

AXES = ("x", "y", "z")
ACCEL_FEATURES = [
    *[f"mean_{a}" for a in AXES], *[f"std_{a}" for a in AXES], *[f"var_{a}" for a in AXES],
    *[f"absdiff_{a}" for a in AXES], "resultant", *[f"peak_{a}" for a in AXES],
]
MOTION_FEATURES = ["avg_speed", "max_speed", "sd_speed", "total_distance"]
TF_FEATURES = [f"tf_{i}" for i in range(8)]
BASIC_FEATURES = ACCEL_FEATURES
LOCATION_AWARE_FEATURES = TF_FEATURES + MOTION_FEATURES + ACCEL_FEATURES


def kmh(metres: str, ms: str) -> str:
    """Speed in km/h; no elapsed time gives no speed."""
    return f"try_divide({metres}, ({ms}) / 1000D) * 3.6D"


def steps(windowed: DataFrame, group: list[str]) -> DataFrame:
    """Add distance and time since the previous record of the same group (null on its first)."""
    w = Window.partitionBy(*group).orderBy("timestamp")
    rows = windowed.withColumns({
        "prev_ts": F.lag("timestamp").over(w),
        "prev_lat": F.lag("latitude").over(w),
        "prev_lng": F.lag("longitude").over(w),
    })
    moved = haversine_sql("prev_lat", "prev_lng", "latitude", "longitude")
    rows = rows.withColumn("step_m", F.expr(
        f"CASE WHEN prev_lat = latitude AND prev_lng = longitude THEN 0D ELSE {moved} END"
    ))
    return rows.withColumn("step_kmh", F.expr(kmh("step_m", "timestamp - prev_ts")))


def speeds(windowed: DataFrame, keys: list[str] = STREAM_KEYS) -> DataFrame:
    """Speed of every record since the previous one of its window; 0.0 for the first."""
    rows = steps(windowed, _group(windowed, keys))
    speed = F.expr("CASE WHEN prev_ts IS NULL THEN 0D ELSE step_kmh END")
    return rows.select(*keys, *WINDOW, "timestamp", speed.alias("speed_kmh"))


def _group(windowed: DataFrame, keys: list[str]) -> list[str]:
    # chunk follows from the window, it only spares the shuffle.
    return [*keys, *(["chunk"] if "chunk" in windowed.columns else []), *WINDOW]


def window_features(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                    min_records: int = MIN_WINDOW_RECORDS, legacy_ms_speed: bool = False) -> DataFrame:
    """All accelerometer and motion statistics of each window with at least ``min_records`` records.

    Means, maxima and totals that other statistics refer to are window columns over the same
    partitioning as the final aggregate. Selecting fewer columns prunes the work.
    ``legacy_ms_speed`` divides the average speed by milliseconds instead of seconds.
    """
    group = _group(windowed, keys)
    whole = Window.partitionBy(*group)
    duration = f"(max(timestamp) - min(timestamp)) * {1000 if legacy_ms_speed else 1}"
    # Records that share a time are one moment for the peaks: the first of them stands for their maximum.
    moment = Window.partitionBy(*group, "timestamp")
    rows = steps(windowed, group).withColumns({
        "m_first": F.row_number().over(moment.orderBy("timestamp")) == 1,
        **{f"m_max_{a}": F.max(a).over(moment) for a in AXES},
    }).withColumns({
        "w_size": F.count("*").over(whole),
        "w_metres": F.sum("step_m").over(whole),
        "w_first": F.min("timestamp").over(whole),
        "w_last": F.max("timestamp").over(whole),
        **{f"w_mean_{a}": F.avg(a).over(whole) for a in AXES},
        **{f"w_max_{a}": F.max(a).over(whole) for a in AXES},
    }).where(F.col("w_size") >= min_records)

    mean_speed = kmh("w_metres", f"(w_last - w_first) * {1000 if legacy_ms_speed else 1}")
    aggregates = {
        "window_start": "min(timestamp)",
        "window_end": "max(timestamp)",
        "n_records": "count(*)",
        "first_lat": "max(CASE WHEN prev_ts IS NULL THEN latitude END)",
        "first_lng": "max(CASE WHEN prev_ts IS NULL THEN longitude END)",
        "duration_ms": "max(timestamp) - min(timestamp)",
        "total_distance": "coalesce(sum(step_m), 0D)",
        "avg_speed": f"coalesce({kmh('sum(step_m)', duration)}, 0D)",
        "max_speed": "greatest(max(step_kmh), 0D)",
        "sd_speed": f"coalesce(sqrt(sum(pow(step_kmh - {mean_speed}, 2)) / count(*)), 0D)",
        "resultant": "avg(sqrt(x * x + y * y + z * z))",
    }
    for a in AXES:
        peak = f"CASE WHEN m_first AND m_max_{a} > {double(PEAK_RATIO)} * w_max_{a} THEN timestamp END"
        aggregates |= {
            f"mean_{a}": f"avg({a})",
            f"std_{a}": f"stddev_pop({a})",
            f"var_{a}": f"coalesce(var_samp({a}), 0D)",
            f"absdiff_{a}": f"avg(abs({a} - w_mean_{a}))",
            f"peak_{a}": f"coalesce(try_divide(max({peak}) - min({peak}), count({peak}) - 1), 0D)",
        }
    out = rows.groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in aggregates.items()])
    return out.drop("chunk")


def _id(keys):
    return [*keys, *WINDOW]


def accel_features(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                   min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), *ACCEL_FEATURES)


def peak_interval(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                  min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    """Mean time between samples above 0.9 of the window maximum, 0.0 with fewer than two."""
    return window_features(windowed, keys, min_records).select(*_id(keys), *[f"peak_{a}" for a in AXES])


def motion_features(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                    min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), "duration_ms", *MOTION_FEATURES)


def trip_duration(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                  min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), "duration_ms")


def avg_speed_kmh(windowed, keys=STREAM_KEYS, min_records=MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), "avg_speed")


def max_speed_kmh(windowed, keys=STREAM_KEYS, min_records=MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), "max_speed")


def speed_stddev(windowed, keys=STREAM_KEYS, min_records=MIN_WINDOW_RECORDS) -> DataFrame:
    return window_features(windowed, keys, min_records).select(*_id(keys), "sd_speed")


def features_basic(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                   min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    """The 16 location-free features."""
    return window_features(windowed, keys, min_records).select(
        *_id(keys), "window_start", "window_end", "n_records", *BASIC_FEATURES
    )


def features_location_aware(windowed: DataFrame, pois: DataFrame, keys: list[str] = STREAM_KEYS,
                            min_records: int = MIN_WINDOW_RECORDS, radius_m: float = POI_RADIUS_M,
                            legacy_ms_speed: bool = False) -> DataFrame:
    """The 28 features: place shares, motion, accelerometer.

    ``cluster_id`` must be among the keys: -1 is a trip and has no place shares, anything else
    is a stay and has no motion. Shares are taken at the first record of the window.
    """
    windows = window_features(windowed, keys, min_records, legacy_ms_speed)
    trip = f"cluster_id = {NOISE_CLUSTER}"
    described = windows.withColumns({
        **{m: F.expr(f"CASE WHEN {trip} THEN {m} ELSE 0D END") for m in MOTION_FEATURES},
        "latitude": F.expr(f"CASE WHEN NOT {trip} THEN first_lat END"),
        "longitude": F.expr(f"CASE WHEN NOT {trip} THEN first_lng END"),
    }).drop("first_lat", "first_lng", "duration_ms")
    counted = count_around(described, _id(keys), pois, radius_m)
    return poi_tf(counted).select(
        *_id(keys), "window_start", "window_end", "n_records", *LOCATION_AWARE_FEATURES
    )
