import pytest
from helpers import by_user, frame, random_streams, segment_ids, times, window_ids

from strideflow.operators import segments as S


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("user", "timestamp").select(*columns).collect()]


def test_equal_gap_stays_longer_gap_cuts(spark):
    out = S.gap_segments(times(spark, [0, 800, 1601, 2400]), 800)
    assert rows(out, "timestamp", "seg_id", "seg_start") == [
        (0, 0, 0), (800, 0, 0), (1601, 1, 1601), (2400, 1, 1601)]


def test_window_edge_belongs_to_the_earlier_window(spark):
    segs = S.gap_segments(times(spark, [0, 5000, 5001]), 5000)
    assert rows(S.anchored_windows(segs, 5000, gap_ms=5000), "win_id") == [(0,), (0,), (1,)]


def test_windows_lag_after_a_long_pause(spark):
    segs = S.gap_segments(times(spark, [0, 35, 36, 37]), 100)
    assert rows(S.anchored_windows(segs, 10), "win_id") == [(0,), (1,), (2,), (3,)]


def test_windows_need_ten_records(spark):
    t = times(spark, range(0, 90, 10), "nine").union(times(spark, range(0, 100, 10), "ten"))
    assert [r.user for r in S.window_sizes(S.windowed_traces(t)).collect()] == ["ten"]


def test_first_timestamps_may_be_small_or_negative(spark):
    out = S.gap_segments(times(spark, [-900, -100, 0, 801]), 800, chunk_ms=800)
    assert rows(out, "seg_id") == [(0,), (0,), (0,), (1,)]


def test_empty_input(spark):
    assert S.window_sizes(S.windowed_traces(times(spark, []))).count() == 0


@pytest.mark.parametrize("chunk_ms", [20, 37, 1000])
def test_segments_and_windows_across_chunk_borders(spark, chunk_ms):
    gap, duration = 12, 20
    data = random_streams(1, users=40, n=80, max_step=14)
    t = frame(spark, data)
    want = {}
    for user, g in by_user(data).items():
        ts = list(g["timestamp"])
        seg = segment_ids(ts, gap)
        for s in set(seg):
            part = [x for x, k in zip(ts, seg) if k == s]
            want |= {(user, x): (s, part[0], w) for x, w in zip(part, window_ids(part, duration))}
    segs = S.gap_segments(t, gap, chunk_ms=chunk_ms)
    got = S.anchored_windows(segs, duration, gap_ms=gap)
    assert {(r.user, r.timestamp): (r.seg_id, r.seg_start, r.win_id) for r in got.collect()} == want
    tiled = S.windowed_traces(t, gap, duration, chunk_ms=chunk_ms).collect()
    assert len(tiled) == len(want)
    assert {(r.user, r.timestamp): (r.seg_id, r.seg_start, r.win_id) for r in tiled} == want
    # A window is whole in one chunk.
    assert len({(r.user, r.seg_id, r.win_id, r.chunk) for r in tiled}) == len({(r.user, r.seg_id, r.win_id) for r in tiled})


@pytest.mark.parametrize("chunk_ms", [60, 1000])
def test_lagging_windows_across_chunk_borders(spark, chunk_ms):
    gap, duration = 60, 10
    data = random_streams(2, users=30, n=60, max_step=40) + random_streams(3, users=30, n=120, max_step=8)
    data = [r | {"user": r["user"] + ("s" if i < 1800 else "f")} for i, r in enumerate(data)]
    want = {}
    for user, g in by_user(data).items():
        ts = list(g["timestamp"])
        seg = segment_ids(ts, gap)
        for s in set(seg):
            part = [x for x, k in zip(ts, seg) if k == s]
            want |= {(user, x): w for x, w in zip(part, window_ids(part, duration))}
    segs = S.gap_segments(frame(spark, data), gap, chunk_ms=chunk_ms)
    got = S.anchored_windows(segs, duration, chunk_ms=chunk_ms)
    assert {(r.user, r.timestamp): r.win_id for r in got.collect()} == want
    owned = S.windowed_traces(frame(spark, data), gap, duration, chunk_ms=chunk_ms).collect()
    assert {(r.user, r.timestamp): r.win_id for r in owned} == want
