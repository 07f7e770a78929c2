import math

import numpy as np
import pytest
from helpers import frame, metres

from strideflow.functions.dimensions import poi_type_to_activity
from strideflow.operators import poi as P
from strideflow.schemas import ACTIVITIES

POI_DDL = "poi_id long, latitude double, longitude double, types array<string>"


def places(spark, rows):
    return spark.createDataFrame(rows, POI_DDL)


@pytest.mark.parametrize("lat,lng,radius", [
    (47.0, 8.0, 20.0), (0.0, 180.0, 150.0), (-65.0, -180.0, 150.0), (89.9995, 20.0, 100.0), (-90.0, 0.0, 60.0),
])
def test_radius_join_matches_all_pairs(spark, lat, lng, radius):
    """Also across the date line and around the poles."""
    rng = np.random.default_rng(3)
    spread = 4 * radius / 111195.0

    def around(n):
        lats = np.clip(lat + rng.uniform(-spread, spread, n), -90, 90)
        wide = spread / max(math.cos(math.radians(lat)), 1e-9)
        lngs = lng + rng.uniform(-1, 1, n) * min(wide, 180)
        return [(float(a), float((b + 180) % 360 - 180)) for a, b in zip(lats, lngs)]

    points, spots = around(60), around(60)
    got = P.poi_within(
        frame(spark, [{"timestamp": i, "latitude": a, "longitude": b} for i, (a, b) in enumerate(points)]),
        places(spark, [(i, a, b, []) for i, (a, b) in enumerate(spots)]), radius, salts=3,
    ).collect()
    want = {(p, i) for p in points for i, s in enumerate(spots) if metres(p, s) <= radius}
    assert {((r.latitude, r.longitude), r.poi_id) for r in got} == want
    assert len(got) == len(want) > 10


def test_types_map_to_activities(spark):
    t = spark.createDataFrame([("cafe",), (" Library ",), ("STADIUM",), ("atm",), (None,), ("shoe_store",)], "t string")
    got = [r.a for r in t.select(poi_type_to_activity(t.t).alias("a")).collect()]
    assert got == [ACTIVITIES[a] for a in ("Dinning", "Studying", "Entertainment", "Other", "Other", "Shopping")]


def test_counts_shares_and_other(spark):
    pois = places(spark, [
        (1, 47.0, 8.0, ["cafe", "bar", "store"]), (2, 47.0, 8.0, ["atm"]), (3, 47.01, 8.0, ["school"]),
    ])
    points = frame(spark, [{"timestamp": 0, "latitude": 47.0, "longitude": 8.0}, {"timestamp": 1, "latitude": 40.0, "longitude": 8.0}])
    counts = {r.latitude: r for r in P.poi_counts(points, pois).collect()}
    assert (counts[47.0].n_1, counts[47.0].n_2, counts[47.0].n_4) == (2, 1, 0)
    assert "n_8" not in counts[47.0].asDict()
    tf = {r.latitude: [r[f"tf_{i}"] for i in range(8)] for r in P.poi_tf(P.poi_counts(points, pois)).collect()}
    assert tf[47.0] == pytest.approx([0, 2 / 3, 1 / 3, 0, 0, 0, 0, 0])
    assert tf[40.0] == [0.0] * 8
    with_other = {r.latitude: r for r in P.poi_tf(P.poi_counts(points, pois, include_other=True), True).collect()}
    assert (with_other[47.0].tf_1, with_other[47.0].tf_8) == (0.5, 0.25)


def test_map_covers_every_record(spark):
    pois = places(spark, [(1, 47.0, 8.0, ["cafe"])])
    points = frame(spark, [{"timestamp": t, "latitude": 47.0 + (t % 2), "longitude": 8.0} for t in range(10)])
    got = {r.timestamp: r.n_1 for r in P.poi_map(points, pois, chunk_ms=3).collect()}
    assert got == {t: 1 - t % 2 for t in range(10)}


def test_tfidf_weights(spark):
    pois = places(spark, [(1, 47.0, 8.0, ["cafe", "school"]), (2, 48.0, 8.0, ["cafe"])])
    points = frame(spark, [{"timestamp": t, "latitude": lat, "longitude": 8.0} for t, lat in enumerate([47.0, 48.0, 49.0])])
    got = {r.timestamp: r for r in P.poi_tfidf(P.poi_map(points, pois), ["user"]).collect()}
    assert got[0].tfidf_1 == pytest.approx(0.5 * math.log(3 / 2))
    assert got[0].tfidf_4 == pytest.approx(0.5 * math.log(3))
    assert got[1].tfidf_1 == pytest.approx(math.log(3 / 2))
    assert got[2].tfidf_1 == 0.0


def test_sweep_agrees_with_single_radii(spark, traces, pois):
    points = traces.select(*P.SPOT)
    rows = P.poi_sweep(points, pois, (5.0, 20.0, 100.0)).collect()
    for radius, other in ((5.0, False), (20.0, True), (100.0, False)):
        got = {(r.latitude, r.longitude): [r[f"tf_{i}"] for i in range(8 + other)] for r in rows
               if r.radius_m == radius and r.include_other == other}
        single = P.poi_tf(P.poi_counts(points, pois, radius, other), other).collect()
        assert got == {(r.latitude, r.longitude): [r[f"tf_{i}"] for i in range(8 + other)] for r in single}
