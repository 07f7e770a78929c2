import pytest
from helpers import by_user, frame, random_streams
from pyspark.sql import functions as F

from strideflow.functions.dimensions import activity_dim, activity_id, activity_label
from strideflow.schemas import ACTIVITIES, TRACE_COLUMNS
from strideflow.sources import traces as S


def test_csv_layout(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("u1,1500,Dinning,true,47.5,7.9,0.1,-0.2,9.8,Cafe\nu2,1600,Biking,false,47.6,7.8,1,2,3,Road\n")
    r = S.read_trace_csv(spark, str(path), with_place=True).orderBy("timestamp").collect()
    assert (r[0].user, r[0].timestamp, r[0].activity, r[0].dominanthand) == ("u1", 1500, "Dinning", True)
    assert (r[0].latitude, r[0].longitude, r[0].x, r[0].z, r[1].place) == (47.5, 7.9, 0.1, 9.8, "Road")


def test_malformed_csv_is_an_error(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("u1,late,Dinning,true,47.5,7.9,0.1,-0.2,9.8\n")
    with pytest.raises(Exception, match="(?i)malformed|NumberFormat|cast"):
        S.read_trace_csv(spark, str(path)).collect()


def test_ticks_are_cut_to_whole_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("10,1.9\n20,-1.9\n")
    assert [r.value for r in S.read_ticks_csv(spark, str(path)).orderBy("timestamp").collect()] == [1, -1]


def test_traces_round_trip(spark, traces, tmp_path):
    S.write_traces(traces, str(tmp_path / "t"))
    back = S.read_traces(spark, str(tmp_path / "t"), labelled=True)
    assert back.count() == traces.count() and back.exceptAll(traces.select(*back.columns)).isEmpty()


def test_conform_keeps_one_of_several_copies(spark):
    rows = frame(spark, [{"timestamp": 1, "x": 2.0}, {"timestamp": 1, "x": 1.0}, {"timestamp": 2}])
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    got = S.conform_traces(text, deduplicate=True).orderBy("timestamp").collect()
    assert [(r.timestamp, r.x) for r in got] == [(1, 1.0), (2, 0.0)]


def test_malformed_rows_are_found_and_refused(spark):
    rows = frame(spark, [{"timestamp": 1}, {"timestamp": 2}])
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    text = text.withColumn("x", F.when(F.col("timestamp") == "2", F.lit("n/a")).otherwise(F.col("x")))
    assert [r.timestamp for r in S.malformed_traces(text).collect()] == ["2"]
    with pytest.raises(Exception, match="malformed"):
        S.conform_traces(text).collect()


def test_between_is_open_at_both_ends_and_newest_first(spark):
    t = frame(spark, [{"timestamp": i} for i in range(6)] + [{"timestamp": 3, "dominanthand": False}])
    got = S.traces_between(t, "a", True, 1, 5)
    assert [r.timestamp for r in got.collect()] == [4, 3, 2] and got.columns == TRACE_COLUMNS


@pytest.mark.parametrize("n,chunk_ms", [(1, 10), (7, 10), (25, 33), (500, 1000)])
def test_latest(spark, n, chunk_ms):
    data = random_streams(8, users=20, n=60, max_step=15)
    got = S.latest_traces(frame(spark, data), n, chunk_ms=chunk_ms).collect()
    want = {(u, t) for u, g in by_user(data).items() for t in list(g["timestamp"])[-n:]}
    assert len(got) == len(want) and {(r.user, r.timestamp) for r in got} == want


def test_training_selection(spark):
    rows = [("a", True, i, 0.0, 0.0, 0.0, 0.0, 0.0, l) for i, l in enumerate(["Biking", "Other", "Cooking", "Biking"])]
    t = spark.createDataFrame(rows, "user string, dominanthand boolean, timestamp long, x double, y double, z double, latitude double, longitude double, activity string")
    assert sorted(r.timestamp for r in S.training_traces(t).collect()) == [0, 2, 3]
    assert [r.timestamp for r in S.training_traces(t, "a", True, "Biking", 0, 9).collect()] == [3]
    assert S.training_traces(t, dominanthand=False).isEmpty()


def test_activity_labels_and_ids(spark):
    dim = activity_dim(spark)
    assert {r.activity: r.activity_id for r in dim.collect()} == ACTIVITIES
    again = dim.select("activity", activity_id(F.col("activity")).alias("i"), activity_label(F.col("activity_id")).alias("l"))
    assert all(r.i == ACTIVITIES[r.activity] and r.l == r.activity for r in again.collect())
    with pytest.raises(Exception, match="unknown activity id"):
        spark.range(1).select(activity_label(F.lit(9))).collect()
    with pytest.raises(Exception, match="unknown activity label"):
        spark.range(1).select(activity_id(F.lit("Flying"))).collect()


def test_results_round_trip(spark, tmp_path):
    row = ("u", 5, "Biking", "m", True, False, 1, 2)
    df = spark.createDataFrame(
        [row], "user string, timestamp int, activity string, model string, dominanthand boolean, locationaware boolean, window_start long, window_end long")
    path = str(tmp_path / "r")
    S.write_results(df, path, "a")
    S.write_results(df, path, "a")
    assert [tuple(r) for r in S.read_results(spark, path).collect()] == [row]
    S.write_results(df, path, "b")
    assert sorted(tuple(r) for r in S.read_results(spark, path, with_run=True).collect()) == [(*row, "a"), (*row, "b")]
