import pytest
from helpers import TRACE_DDL, by_user, frame, random_streams, times

from strideflow.operators.segments import gap_segments, segment_summary, windowed_traces
from strideflow.plans import models as M
from strideflow.plans import recognition as R
from strideflow.plans import training as Tr
from strideflow.schemas import RESULT, TRACE_COLUMNS
from strideflow.sources.committed import read_runs
from strideflow.sources.traces import read_results
from strideflow.streaming.recognition import stream_latest, stream_recognise
from strideflow.streaming.segments import milliseconds, stream_features, stream_segments, stream_windows

FAR = 4_000_000_000_000


class Feed:
    """A folder of trace files read as a stream, one file per micro-batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path / "in"), 0
        times(spark, []).write.parquet(self.path)

    def add(self, rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(TRACE_DDL).option("maxFilesPerTrigger", 1).parquet(self.path)


def finish(df, path):
    out = str(path / "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(path / "cp")) \
        .trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def feed_in_order(spark, tmp_path, data, parts=4):
    feed = Feed(spark, tmp_path)
    data = sorted(data, key=lambda r: r["timestamp"])
    size = len(data) // parts + 1
    for i in range(0, len(data), size):
        feed.add(data[i:i + size])
    feed.add([{"user": "end", "timestamp": FAR}])
    feed.add([{"user": "end", "timestamp": FAR + 1}])
    return feed.stream()


def test_stream_segments_equal_batch_segments(spark, tmp_path):
    data = random_streams(4, users=5, n=60, max_step=300, start_ms=5000)
    got = finish(stream_segments(feed_in_order(spark, tmp_path, data), 200, "1 second"), tmp_path).where("user <> 'end'")
    want = segment_summary(gap_segments(frame(spark, data), 200)).drop("seg_id")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == want.count() > 20


def test_session_at_exactly_the_gap(spark, tmp_path):
    data = [{"timestamp": t} for t in (10, 810, 1611, 2410)]
    got = finish(stream_segments(feed_in_order(spark, tmp_path, data, 1)), tmp_path).where("user <> 'end'").collect()
    assert sorted((r.start_ts, r.end_ts, r.n_records) for r in got) == [(10, 810, 2), (1611, 2410, 2)]


@pytest.mark.parametrize("parts", [1, 6])
def test_stream_windows_equal_batch_windows(spark, tmp_path, parts):
    data = random_streams(6, users=4, n=90, max_step=220, start_ms=5000)
    got = finish(stream_windows(feed_in_order(spark, tmp_path, data, parts), 200, 700, "500 milliseconds"), tmp_path)
    got = got.where("user <> 'end'")
    want = windowed_traces(frame(spark, data), 200, 700).select(*got.columns)
    assert got.count() == len(data) and got.exceptAll(want).isEmpty()


def test_records_out_of_order_within_the_delay(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    ts = list(range(100, 4100, 100))
    feed.add([{"timestamp": t} for t in ts if t % 200])
    feed.add([{"timestamp": t} for t in ts if t % 200 == 0])
    feed.add([{"user": "end", "timestamp": FAR}])
    feed.add([{"user": "end", "timestamp": FAR + 1}])
    got = finish(stream_windows(feed.stream(), 200, 1000, "10 seconds"), tmp_path).where("user <> 'end'").collect()
    assert sorted((r.timestamp, r.win_id) for r in got) == [(t, max((t - 100 + 999) // 1000 - 1, 0)) for t in ts]


def test_a_window_comes_out_while_its_segment_goes_on(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"timestamp": t} for t in range(0, 3000, 100)])
    feed.add([{"timestamp": t} for t in range(3000, 6000, 100)])
    got = finish(stream_windows(feed.stream(), 200, 1000, "0 seconds"), tmp_path)
    assert sorted({r.win_id for r in got.collect()})[:2] == [0, 1]


def drained(df, path, name="sides"):
    """Rows of a finite run, and the state rows each micro-batch wrote and kept."""
    query = df.writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / f"{name}-cp")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    state = [(p["numInputRows"], sum(s["numRowsUpdated"] for s in p["stateOperators"]), sum(s["numRowsTotal"] for s in p["stateOperators"]))
             for p in query.recentProgress]
    return df.sparkSession.read.schema(df.schema).parquet(str(path / name)).collect(), state


@pytest.mark.parametrize("operator", [stream_windows, stream_segments])
def test_every_record_is_a_result_late_or_ahead(spark, tmp_path, operator):
    feed = Feed(spark, tmp_path)
    ts = list(range(100_000, 160_000, 100))
    behind = [t for t in ts if t < 140_000 and t % 1300 == 0]
    feed.add([{"timestamp": t} for t in ts if t not in behind and t < 150_000])
    feed.add([{"timestamp": t, "user": u} for t in ts if t >= 150_000 for u in "ab"] + [{"timestamp": t} for t in behind])
    feed.add([{"timestamp": 10**12 + t} for t in ts[:7]] + [{"timestamp": 300_000, "user": "end"}])
    out, _ = drained(operator(feed.stream(), delay="1 second", sides=True, ahead_ms=1000, now=M.F.lit(400_000).cast("long")), tmp_path)
    count = {}
    for r in out:
        if r.user != "end":
            count[r.user, r.side] = count.get((r.user, r.side), 0) + (r.n_records if operator is stream_segments else 1)
    result = "segment" if operator is stream_segments else "window"
    assert count == {("a", result): len(ts) - len(behind), ("a", "late"): len(behind), ("a", "ahead"): 7, ("b", result): 100}
    if operator is stream_windows:
        assert {r.timestamp for r in out if r.side == "late"} == set(behind) and all(r.win_id is None for r in out if r.side != "window")


def test_state_does_not_grow_with_the_backlog(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"timestamp": t} for t in range(0, 600_000, 100)])
    feed.add([{"timestamp": t} for t in range(600_000, 601_000, 100)])
    out, state = drained(stream_windows(feed.stream(), delay="2 seconds"), tmp_path)
    # six thousand records at once, and what stays is the delay and an open window
    assert max(n for n, _, _ in state) == 6000 and all(total < 150 for _, _, total in state)
    assert len(out) > 5900 and len({(r.timestamp, r.win_id) for r in out}) == len(out)


def test_a_timer_closes_what_gets_no_more_records(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"user": "quiet", "timestamp": t} for t in range(0, 3000, 100)] + [{"user": "busy", "timestamp": 2900}])
    feed.add([{"user": "busy", "timestamp": t} for t in range(3000, 40_000, 100)])
    out, state = drained(stream_windows(feed.stream(), 200, 1000, "1 second"), tmp_path)
    assert len([r for r in out if r.user == "quiet"]) == 30
    out, _ = drained(stream_segments(feed.stream(), 200, "1 second"), tmp_path, "segments")
    assert [(r.user, r.start_ts, r.end_ts, r.n_records) for r in out] == [("quiet", 0, 2900, 30)]


def test_random_order_within_the_delay(spark, tmp_path):
    import random

    rng = random.Random(2)
    data = random_streams(12, users=3, n=120, max_step=300, start_ms=5000)
    data.sort(key=lambda r: r["timestamp"] + rng.randrange(-900, 900))
    feed = Feed(spark, tmp_path)
    for i in range(0, len(data), 37):
        feed.add(data[i:i + 37])
    feed.add([{"user": "end", "timestamp": FAR}])
    got, _ = drained(stream_windows(feed.stream(), 200, 700, "2 seconds", sides=True), tmp_path)
    want = windowed_traces(frame(spark, data), 200, 700).select("user", "timestamp", "seg_start", "win_id").collect()
    assert sorted((r.user, r.timestamp, r.seg_start, r.win_id) for r in got if r.user != "end") == sorted(map(tuple, want))
    assert {r.side for r in got} == {"window"}


def test_one_new_record_writes_one_entry(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"timestamp": t, "user": u} for t in range(0, 5000, 100) for u in "abc"])
    feed.add([{"timestamp": 5000}])
    feed.add([{"timestamp": 5000}, {"timestamp": 10}])
    sizes = []
    query = stream_latest(feed.stream(), 20).writeStream.foreachBatch(lambda b, i: sizes.append(b.count())) \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    # of the first batch the newest 20 of each; then one record, the expiry and its timer (kept by time and by key)
    assert written[0] <= 3 * (20 + 4) and written[1] <= 5 and written[2] <= 1, written
    assert [n for n in sizes if n] == [60, 20, 20]


def test_a_stream_that_others_left_far_behind_is_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"user": "old", "timestamp": t} for t in range(5)])
    feed.add([{"user": "new", "timestamp": 10_000}])
    feed.add([{"user": "new", "timestamp": 10_001}])
    feed.add([{"user": "old", "timestamp": 10_002}])
    got = []
    stream_latest(feed.stream(), 20, "1 second").writeStream.foreachBatch(lambda b, i: got.append(sorted((r.user, r.timestamp) for r in b.collect()))) \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [x for x in got if x][-1] == [("old", 10_002)]


def test_wrong_clocks_take_no_part_in_recognition(spark, traces, pois, tmp_path):
    labelled = traces
    models = {(a, True): M.train_decision_tree(Tr.training_set(labelled, pois if a else None, a, True), a) for a in (False, True)}
    rows = labelled.select(*TRACE_COLUMNS)
    wrong = rows.limit(3).withColumn("timestamp", M.F.col("timestamp") + 10**11)
    rows.union(wrong).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TRACE_DDL).parquet(str(tmp_path / "in"))
    stream_recognise(stream, pois, models, str(tmp_path / "out"), str(tmp_path / "cp"), clock=lambda: 50_000, available_now=True,
                     ahead_path=str(tmp_path / "ahead"), now=M.F.lit(1_500_001_000_000).cast("long")).start().awaitTermination()
    assert read_runs(spark, str(tmp_path / "ahead"), rows.schema).count() == 3
    cols = [*RESULT.fieldNames(), "window_start", "window_end"]
    got, want = read_results(spark, str(tmp_path / "out")).select(*cols), R.recognise_all(rows, pois, models, 50_000).select(*cols)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_spans():
    assert [milliseconds(s) for s in ("10 seconds", "1 minute", "500 milliseconds", "7 days")] == [10_000, 60_000, 500, 604_800_000]
    with pytest.raises(ValueError):
        milliseconds("soon")


def test_stream_features_equal_batch(spark, traces, pois, tmp_path):
    from strideflow.operators import features as Fe
    from strideflow.operators.clustering import label_regions

    keys = ["user", "dominanthand", "activity", "cluster_id"]
    rows = label_regions(traces)
    for k in range(3):
        rows.where(M.F.expr(f"timestamp div 20000 % 3 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows.limit(1).withColumn("timestamp", M.F.lit(FAR)).withColumn("user", M.F.lit("end")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_features(stream, pois, str(tmp_path / "out"), str(tmp_path / "cp"), keys, delay="1 day").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id", "seg_start")
    want = Fe.features_location_aware(windowed_traces(rows, keys=keys), pois, keys).drop("seg_id")
    key = lambda r: (r.activity, r.window_start)
    got, want = sorted(got.select(*want.columns).collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) > 5
    for a, b in zip(got, want):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b)), (a, b)


def test_latest_of_a_stream(spark, tmp_path):
    data = random_streams(9, users=3, n=50, max_step=20)
    got = {}

    def keep(batch, batch_id):
        rows = batch.collect()
        for u in {r.user for r in rows}:
            got[u] = sorted(r.timestamp for r in rows if r.user == u)

    feed = Feed(spark, tmp_path)
    data = sorted(data, key=lambda r: r["timestamp"])
    feed.add(data[:60])
    feed.add(data[50:])
    stream_latest(feed.stream(), 20).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert got == {u: list(g["timestamp"])[-20:] for u, g in by_user(data).items()}


def test_stream_recognition_equals_batch(spark, traces, pois, tmp_path):
    labelled = traces
    vectors = {aware: Tr.training_set(labelled, pois if aware else None, aware) for aware in (False, True)}
    models = {(a, h): M.train_decision_tree(vectors[a], a) for a, h in M.VARIANTS}
    rows = labelled.select(*TRACE_COLUMNS)
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    results = str(tmp_path / "results")
    stream = spark.readStream.schema(TRACE_DDL).parquet(path)
    stream_recognise(stream, pois, models, results, str(tmp_path / "cp"), clock=lambda: 50_000, available_now=True) \
        .start().awaitTermination()
    cols = [*RESULT.fieldNames(), "window_start", "window_end"]
    got = read_results(spark, results).select(*cols)
    want = R.recognise_all(rows, pois, models, 50_000).select(*cols)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


