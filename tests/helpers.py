"""Plain Python counterparts, written from the definitions, for small random inputs."""

import math

import numpy as np
import pandas as pd

TRACE_DDL = (
    "user string, dominanthand boolean, timestamp long, x double, y double, z double,"
    " latitude double, longitude double"
)


def frame(spark, rows):
    """Traces from dicts; what is not given is 0."""
    filled = [
        (r.get("user", "a"), r.get("dominanthand", True), r["timestamp"], *[float(r.get(c, 0.0)) for c in
         ("x", "y", "z", "latitude", "longitude")]) for r in rows
    ]
    return spark.createDataFrame(filled, TRACE_DDL)


def times(spark, ts, user="a"):
    return frame(spark, [{"user": user, "timestamp": t} for t in ts])


def random_streams(seed, users, n, max_step, spread_m=0.0, jump=0.0, start_ms=0):
    """Traces of several users with random pauses, drifting and jumping between two places."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        ts = start_ms + 1000 * u + np.cumsum(rng.integers(1, max_step + 1, n)) - rng.integers(0, 500)
        place = 0
        for t in ts:
            if rng.random() < jump:
                place = 1 - place
            rows.append({
                "user": f"u{u}", "timestamp": int(t), "x": rng.normal(), "y": rng.normal() - 3, "z": rng.normal() + 9,
                "latitude": 47.0 + place * 0.001 + rng.normal() * spread_m / 111195.0,
                "longitude": 8.0 + rng.normal() * spread_m / 75000.0,
            })
    return rows


def metres(a, b):
    """Great-circle distance by the haversine formula, radius 6371 km."""
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def segment_ids(ts, gap):
    return list(np.cumsum([0] + [int(b - a > gap) for a, b in zip(ts, ts[1:])]))


def window_ids(ts, duration):
    """Windows of one segment: passing the end closes a window and moves the end on by one duration."""
    end, win, out = ts[0] + duration, 0, []
    for t in ts:
        if t > end:
            win, end = win + 1, end + duration
        out.append(win)
    return out


def clusters(points, min_points, distance, ms):
    """Cluster ids of one stream, ``points`` = [(ts, lat, lng)] in ascending order."""
    n = len(points)
    near = [
        [j for j in range(n) if j != i and abs(points[i][0] - points[j][0]) < ms
         and metres(points[i][1:], points[j][1:]) < distance]
        for i in range(n)
    ]
    core = [len(x) >= min_points for x in near]
    label, found = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = found
            while todo:
                for k in near[todo.pop()]:
                    if core[k] and label[k] < 0:
                        label[k] = found
                        todo.append(k)
            found += 1
    return [
        label[i] if core[i] else max((label[k] for k in near[i] if core[k]), default=-1) for i in range(n)
    ]


def by_user(rows):
    df = pd.DataFrame(rows)
    return {u: g.sort_values("timestamp") for u, g in df.groupby("user")}
