"""Place counts of coordinates, kept from one poll to the next.

The table has a part for each state of the places and each radius. A poll looks up its distinct coordinates there, meets only
those that are missing with the places, and adds them as a run. When a place is added, moved or changes its types, the
state has another name, and counts of the former one are not read any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.operators.poi import SPOT, poi_counts
from strideflow.schemas import OTHER_ID, POI_RADIUS_M
from strideflow.session import stage
from strideflow.sources.committed import read_runs, write_run

COUNTS = [f"n_{i}" for i in range(OTHER_ID + 1)]
CACHED = T.StructType([*[T.StructField(c, T.DoubleType()) for c in SPOT], *[T.StructField(c, T.LongType()) for c in COUNTS]])


def places_state(pois: DataFrame) -> str:
    """A name for the content of the place table, whatever the order of its rows: their number and the sum of their hashes."""
    h = F.xxhash64("poi_id", *SPOT, "types").cast("decimal(38,0)")
    n, total = pois.agg(F.count("*"), F.sum(h)).first()
    return f"{n}_{int(total or 0) % 2**64:016x}"


def cached_poi_counts(points: DataFrame, pois: DataFrame, path: str, radius_m: float = POI_RADIUS_M,
                      run: str | None = None) -> DataFrame:
    """``poi_counts`` with "Other" for every distinct coordinate of ``points``; ``run`` tells when each was looked up.

    Coordinates that two polls look up at the same time are kept twice and read once, the earlier name counts.
    """
    spark = points.sparkSession
    table = f"{path}/{places_state(pois)}/{radius_m!r}"
    asked = stage(points.select(*SPOT).where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct(), "coordinates")
    missing = stage(asked.join(read_runs(spark, table, CACHED).select(*SPOT), SPOT, "left_anti"), "missing")
    if not missing.isEmpty():
        write_run(poi_counts(missing, pois, radius_m, include_other=True).select(*CACHED.fieldNames()), table, run or f"poll-{uuid.uuid4().hex}")
    known = read_runs(spark, table, CACHED).groupBy(*SPOT).agg(F.min("run").alias("run"), *[F.min(c).alias(c) for c in COUNTS])
    return asked.join(known, SPOT).select(*SPOT, *COUNTS, "run")
