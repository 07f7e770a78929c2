import math

import numpy as np
import pytest
from helpers import by_user, frame, metres, random_streams, segment_ids, window_ids

from strideflow.operators import features as Fe
from strideflow.operators.segments import windowed_traces


def stats(g, gap_records):
    ts = g["timestamp"].to_numpy()
    out = {"n_records": len(g), "duration_ms": int(ts[-1] - ts[0])}
    for a in "xyz":
        v = g[a].to_numpy()
        peaks = ts[v > 0.9 * v.max()]
        deltas = np.diff(peaks)
        out |= {
            f"mean_{a}": v.mean(), f"std_{a}": v.std(), f"var_{a}": v.var(ddof=1),
            f"absdiff_{a}": np.abs(v - v.mean()).mean(), f"peak_{a}": deltas.mean() if len(deltas) else 0.0,
        }
    out["resultant"] = np.sqrt((g[["x", "y", "z"]] ** 2).sum(axis=1)).mean()
    at = list(zip(g["latitude"], g["longitude"]))
    steps = [metres(p, q) for p, q in zip(at, at[1:])]
    speeds = [m / (dt / 1000) * 3.6 for m, dt in zip(steps, np.diff(ts))]
    mean = sum(steps) / ((ts[-1] - ts[0]) / 1000) * 3.6
    out |= {
        "total_distance": sum(steps), "avg_speed": mean, "max_speed": max(speeds),
        "sd_speed": math.sqrt(sum((s - mean) ** 2 for s in speeds) / len(g)),
    }
    return out


@pytest.mark.parametrize("chunk_ms", [400, 5000])
def test_window_statistics(spark, chunk_ms):
    gap, duration = 60, 400
    data = random_streams(5, users=12, n=150, max_step=62, spread_m=4.0)
    got = Fe.window_features(windowed_traces(frame(spark, data), gap, duration, chunk_ms=chunk_ms), min_records=5)
    got = {(r.user, r.window_start): r.asDict() for r in got.collect()}
    seen = 0
    for user, g in by_user(data).items():
        g = g.assign(seg=segment_ids(list(g["timestamp"]), gap))
        for _, s in g.groupby("seg"):
            for _, w in s.groupby(window_ids(list(s["timestamp"]), duration)):
                key = (user, int(w["timestamp"].iloc[0]))
                assert (key in got) == (len(w) >= 5)
                if len(w) >= 5:
                    seen += 1
                    for name, value in stats(w, gap).items():
                        assert got[key][name] == pytest.approx(value, rel=1e-6, abs=1e-6), name
    assert seen == len(got) > 20


def one_window(spark, **columns):
    n = len(next(iter(columns.values())))
    ts = columns.pop("timestamp", range(0, 10 * n, 10))
    data = [{"timestamp": t, **{c: v[i] for c, v in columns.items()}} for i, t in enumerate(ts)]
    return Fe.window_features(windowed_traces(frame(spark, data)), min_records=1).first()


def test_no_peaks_below_a_negative_maximum(spark):
    assert one_window(spark, x=[-1.0, -2.0, -1.0]).peak_x == 0.0


def test_peak_interval_is_the_mean_gap(spark):
    r = one_window(spark, x=[10.0, 0.0, 10.0, 9.5], timestamp=[0, 50, 100, 300])
    assert r.peak_x == 150.0


def test_a_single_record(spark):
    r = one_window(spark, x=[1.0])
    assert (r.var_x, r.std_x, r.peak_x, r.avg_speed, r.max_speed, r.sd_speed, r.total_distance) == (0.0,) * 7


def test_constant_place_has_no_motion(spark):
    r = one_window(spark, latitude=[47.3] * 4)
    assert (r.avg_speed, r.max_speed, r.sd_speed, r.total_distance) == (0.0,) * 4


def test_speed_of_the_first_record_is_zero(spark):
    data = [{"timestamp": 0, "latitude": 0.0}, {"timestamp": 500, "latitude": 0.001}]
    got = Fe.speeds(windowed_traces(frame(spark, data))).orderBy("timestamp").collect()
    assert got[0].speed_kmh == 0.0
    assert got[1].speed_kmh == pytest.approx(metres((0, 0), (0.001, 0)) / 0.5 * 3.6)


def test_average_speed_by_milliseconds_on_request(spark):
    data = [{"timestamp": t, "latitude": t / 1e6} for t in range(0, 1000, 50)]
    w = windowed_traces(frame(spark, data))
    plain = Fe.window_features(w).first()
    legacy = Fe.window_features(w, legacy_ms_speed=True).first()
    assert legacy.avg_speed == pytest.approx(plain.avg_speed / 1000)
    assert legacy.max_speed == plain.max_speed


def test_vector_layouts():
    assert len(Fe.LOCATION_AWARE_FEATURES) == 28
    assert len(Fe.BASIC_FEATURES) == 16
    assert Fe.LOCATION_AWARE_FEATURES[12:] == Fe.BASIC_FEATURES
    assert Fe.BASIC_FEATURES[:4] == ["mean_x", "mean_y", "mean_z", "std_x"]
