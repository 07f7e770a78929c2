import numpy as np
import pytest
from helpers import metres
from pyspark.sql import functions as F

from strideflow.functions.geo import haversine_m, nearer_sql, within_sql

PAIR = "l_latitude double, l_longitude double, r_latitude double, r_longitude double"
ENDS = ["l_latitude", "l_longitude", "r_latitude", "r_longitude"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def test_distance(spark):
    rows = [(47.3, 8.5, 47.3, 8.5), (47.3, 8.5, 46.2, 6.1), (0.0, 179.9, 0.0, -179.9), (90.0, 0.0, -90.0, 0.0), (10.0, 20.0, -10.0, -160.0)]
    got = [r.d for r in pairs(spark, rows).select(haversine_m(*ENDS).alias("d")).collect()]
    assert got == pytest.approx([metres(r[:2], r[2:]) for r in rows], rel=1e-8, abs=1e-9)


def test_a_missing_coordinate_has_no_distance(spark):
    assert pairs(spark, [(1.0, 2.0, 3.0, None)]).select(haversine_m(*ENDS).alias("d")).first().d is None


@pytest.mark.parametrize("distance", [0.5, 40.0, 40000.0, 5e6])
@pytest.mark.parametrize("lat,lng", [(0.0, 180.0), (47.0, 8.0), (85.0, -180.0), (-89.999, 0.0)])
def test_the_cheap_test_decides_as_the_distance(spark, distance, lat, lng):
    rng = np.random.default_rng(2)
    n, spread = 3000, 1.5 * distance / 111195.0
    wide = min(spread / max(np.cos(np.radians(lat)), 1e-4), 179.0)
    ends = []
    for _ in range(2):
        ends.append(np.clip(lat + rng.uniform(-spread, spread, n), -90, 90))
        ends.append((lng + rng.uniform(-wide, wide, n) + 180) % 360 - 180)
    df = pairs(spark, [tuple(map(float, r)) for r in zip(*ends)]).selectExpr(
        "*", "cos(radians(l_latitude)) AS l_cos_lat", "cos(radians(r_latitude)) AS r_cos_lat")
    df = df.withColumns({
        "cheap": F.expr(nearer_sql("l_", "r_", distance)), "within": F.expr(within_sql(*ENDS, distance)),
        "exact": haversine_m(*ENDS) < distance,
    })
    counts = df.agg(F.count_if(F.col("exact")).alias("n"), F.expr("count_if(cheap <> exact OR within <> exact)").alias("wrong")).first()
    assert counts.wrong == 0 and 0 < counts.n < n
