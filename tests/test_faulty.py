"""Missing keys, missing fixes and records sent twice: nothing vanishes, nothing multiplies."""

import pytest
from pyspark.sql import functions as F

from strideflow.operators import clustering, features, poi, segments
from strideflow.schemas import STREAM_KEYS, TRACE
from strideflow.sources import traces as S
from strideflow.streaming.segments import split_by_clock

RECORD = [*STREAM_KEYS, "timestamp"]


def table(spark, rows):
    """Rows ``(user, hand, timestamp, latitude, longitude)``."""
    full = [dict(user=u, dominanthand=h, timestamp=t, x=1.0, y=2.0, z=9.0, latitude=a, longitude=b) for u, h, t, a, b in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in TRACE.fields) for r in full], TRACE)


def test_a_missing_key_is_refused_not_lost(spark, pois):
    for user, hand in ((None, True), ("a", None)):
        rows = table(spark, [("a", True, 10, 47.0, 8.0), (user, hand, 20, 47.0, 8.0)])
        for run in (segments.gap_segments, segments.windowed_traces, lambda t: poi.poi_map(t, pois), clustering.st_dbscan, S.latest_traces):
            with pytest.raises(Exception, match="no user, dominanthand or timestamp"):
                run(rows).collect()


def test_admitted_and_put_aside_make_all(spark):
    rows = table(spark, [("a", True, 10, 47.0, 8.0), (None, True, 20, 47.0, 8.0), ("a", None, 30, 47.0, 8.0), ("a", True, 40, None, None)])
    good, bad = S.admit_traces(rows)
    assert sorted(r.timestamp for r in good.collect()) == [10, 40] and sorted(r.timestamp for r in bad.collect()) == [20, 30]
    assert S.malformed_traces(rows).exceptAll(bad).isEmpty()
    with pytest.raises(Exception, match="malformed"):
        S.conform_traces(rows).collect()


def drop_out(n=40):
    """A place, one record without a fix, a place a degree away; 10 ms apart."""
    rows = [("a", True, 10 * k, 47.0, 8.0) for k in range(n)] + [("a", True, 10 * n, None, None)]
    return rows + [("a", True, 10 * (n + 1 + k), 48.0, 8.0) for k in range(n)]


def labels(df):
    return [r.cluster_id for r in df.orderBy("timestamp").collect()]


def test_a_jump_across_a_drop_out_parts_clusters(spark):
    rows = table(spark, drop_out())
    assert labels(clustering.st_dbscan(rows, min_points=60)) == [-1] * 81
    assert labels(clustering.st_dbscan(rows, min_points=35)) == [0] * 40 + [-1] + [1] * 40


def test_records_sent_twice_keep_their_number_and_share_a_label(spark):
    rows = drop_out()
    twice = table(spark, rows + rows[::3])
    once = {r.timestamp: r.cluster_id for r in clustering.st_dbscan(table(spark, rows)).collect()}
    got = clustering.st_dbscan(twice).collect()
    assert len(got) == len(rows) + len(rows[::3]) and all(r.cluster_id == once[r.timestamp] for r in got)


def test_records_without_a_fix_have_place_counts(spark, pois):
    out = poi.poi_map(table(spark, drop_out(5)), pois)
    assert out.count() == 11 and out.where("timestamp = 50 AND n_0 = 0").count() == 1


def test_peaks_count_moments(spark):
    rows = [("a", True, 100 * k, 47.0, 8.0) for k in range(20)]
    plain = features.peak_interval(segments.windowed_traces(table(spark, rows))).collect()
    twice = features.peak_interval(segments.windowed_traces(table(spark, rows + rows[5:9]))).collect()
    assert [(r.peak_x, r.peak_z) for r in plain] == [(r.peak_x, r.peak_z) for r in twice] == [(100.0, 100.0)]


def test_place_types_are_stripped_like_control_characters(spark):
    from strideflow.functions.dimensions import poi_type_to_activity

    t = spark.createDataFrame([("bar",), ("\tbar",), ("bar\n",), ("\x01 Bar \x1f",)], "t string")
    assert len({r.a for r in t.select(poi_type_to_activity(F.col("t")).alias("a")).collect()} - {8}) == 1


def test_a_wrong_clock_is_put_aside(spark):
    rows = table(spark, [("a", True, 1_000, 47.0, 8.0), ("bad", True, 10_000_000, 47.0, 8.0)])
    kept, ahead = split_by_clock(rows, 5_000, now=F.lit(2_000))
    assert [r.user for r in kept.collect()] == ["a"] and [r.user for r in ahead.collect()] == ["bad"]
