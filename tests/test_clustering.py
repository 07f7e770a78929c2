import pytest
from helpers import by_user, clusters, frame, random_streams

from strideflow.operators import clustering as C
from strideflow.operators.components import connected_components
from strideflow.operators.neighbours import st_neighbours


def ids(df):
    return {(r.user, r.timestamp): r.cluster_id for r in df.collect()}


def expected(data, min_points, distance, ms):
    want = {}
    for user, g in by_user(data).items():
        points = list(zip(g["timestamp"], g["latitude"], g["longitude"]))
        want |= {(user, int(p[0])): c for p, c in zip(points, clusters(points, min_points, distance, ms))}
    return want


@pytest.mark.parametrize("chunk_ms,spread_m,jump,min_points", [
    (60, 5.0, 0.0, 12),    # distance hardly binds: decided on the time line
    (61, 25.0, 0.1, 7),    # distance binds, two places
    (500, 8.0, 0.5, 6),    # records alternate between two places: many runs per cluster
    (10_000, 30.0, 0.3, 4),
])
def test_clusters_match_the_definition(spark, chunk_ms, spread_m, jump, min_points):
    data = random_streams(int(spread_m), users=60, n=70, max_step=9, spread_m=spread_m, jump=jump)
    want = expected(data, min_points, 40.0, 30)
    got = ids(C.st_dbscan(frame(spark, data), min_points, 40.0, 30, chunk_ms=chunk_ms))
    assert got == want
    assert len({c for c in want.values()}) > 2


def test_border_record_goes_to_the_higher_cluster(spark):
    # Two dense groups; one record between them reaches cores of both and is not core itself.
    ts = [0, 1, 2, 3, 4, 13, 22, 23, 24, 25, 26]
    data = [{"timestamp": t} for t in ts]
    got = ids(C.st_dbscan(frame(spark, data), 4, 40.0, 10))
    assert got == expected([d | {"user": "a", "latitude": 0.0, "longitude": 0.0} for d in data], 4, 40.0, 10)
    assert [got["a", t] for t in ts] == [0] * 5 + [1] + [1] * 5


def test_early_record_is_reclaimed_by_a_later_core(spark):
    data = [{"timestamp": t} for t in [0, 8, 9, 10, 11, 12]]
    got = ids(C.st_dbscan(frame(spark, data), 4, 40.0, 10))
    assert got["a", 0] == 0


def test_streams_are_clustered_apart(spark):
    data = [{"timestamp": t, "user": u} for u in ("a", "b") for t in range(0, 20, 4)]
    got = ids(C.st_dbscan(frame(spark, data), 5, 40.0, 30))
    assert set(got.values()) == {-1}


def test_neighbours_exclude_self_and_both_limits(spark):
    data = [{"timestamp": t, "latitude": lat} for t, lat in [(0, 0.0), (799, 0.0), (800, 0.0), (801, 40.1 / 111194.9)]]
    got = {(r.timestamp, r.neighbour_ts) for r in st_neighbours(frame(spark, data)).collect()}
    assert got == {(0, 799), (799, 0), (799, 800), (800, 799)}


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([("a", i + 1, i) for i in range(n)] + [("b", 7, 3), ("b", 9, 7)], "user string, hi long, lo long")
    got = {(r.user, r.node): r.component for r in connected_components(edges, ["user"]).collect()}
    assert got == {("a", i): 0 for i in range(n + 1)} | {("b", k): 3 for k in (3, 7, 9)}


def test_label_regions(spark):
    t = spark.createDataFrame([("Biking",), ("Cooking",), ("Walking",)], "activity string")
    assert [r.cluster_id for r in C.label_regions(t).collect()] == [-1, 1, -1]
    assert [r.cluster_id for r in C.label_regions(t, False).collect()] == [-1, -1, -1]


def test_cluster_summary(spark):
    data = [{"timestamp": t, "latitude": t / 1e9} for t in [0, 1, 2, 3, 50]]
    got = C.cluster_summary(frame(spark, data), [(2, 40.0, 10), (9, 40.0, 10)]).collect()
    sizes = {(r.min_points, r.cluster): (r["size"], r.duration, r.start_time, r.end_time, r.end_lat) for r in got}
    assert sizes == {(2, "0"): (4, 3, 0, 3, 3e-9), (2, "noise"): (1, 0, 50, 50, 5e-8), (9, "noise"): (5, 50, 0, 50, 5e-8)}


def summarised(rows, clusters_of, grid):
    """The report from labelled records, row by row."""
    out = []
    for p, d, ms in grid:
        for user, g in by_user(rows).items():
            points = list(zip(g["timestamp"], g["latitude"], g["longitude"]))
            label = clusters_of(points, p, d, ms)
            for c in set(label):
                own = [x for x, k in zip(points, label) if k == c]
                out.append((p, d, ms, user, "noise" if c == -1 else str(c), len(own), own[-1][0] - own[0][0], own[0][0], own[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("chunk_ms", [70, 1000])
def test_a_grid_in_one_pass_equals_single_runs(spark, chunk_ms):
    grid = [(4, 40.0, 30), (9, 40.0, 30), (6, 25.0, 35), (6, 60.0, 12), (500, 40.0, 30)]
    data = random_streams(21, users=25, n=80, max_step=9, spread_m=20.0, jump=0.2)
    got = C.cluster_summary(frame(spark, data), grid, chunk_ms=chunk_ms).collect()
    got = sorted((r.min_points, r.distance_m, r.time_ms, r.user, r.cluster, r["size"], r.duration, r.start_time, r.end_time) for r in got)
    assert got == summarised(data, clusters, grid)


def test_clustering_shuffles_samples_once_and_writes_two_tables(spark, monkeypatch):
    staged, written = [], []
    stage = C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: (staged.append(name), written.append(df), stage(df, name))[-1])
    data = random_streams(22, users=5, n=80, max_step=9, spread_m=20.0)
    for run, tables in ((lambda: C.st_dbscan(frame(spark, data), 4, 40.0, 30), 2),
                        (lambda: C.cluster_summary(frame(spark, data), [(4, 40.0, 30)] * 3), 2),
                        (lambda: C.cluster_summary(frame(spark, data), [(4 + i, 40.0, 30) for i in range(30)]), 2)):
        staged.clear(), written.clear()
        run()
        assert len(staged) == tables, staged
        text = written[0]._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and text.count("Scan ExistingRDD") == 1


def test_odd_records_and_columns_that_clash(spark):
    rows = [("a", True, t, 47.0, 8.0, "n") for t in range(0, 40, 4)] + [("a", True, 4, None, 8.0, "m"), ("a", True, 4, 47.0, 8.0, "n"), ("a", True, 500, None, None, None)]
    t = spark.createDataFrame(rows, "user string, dominanthand boolean, timestamp long, latitude double, longitude double, names_of string")
    got = C.st_dbscan(t, 3, 40.0, 30).collect()
    assert len(got) == len(rows) and t.columns + ["cluster_id"] == C.st_dbscan(t, 3, 40.0, 30).columns
    assert {(r.timestamp, r.cluster_id) for r in got} == {(t, 0) for t in range(0, 40, 4)} | {(500, -1)}
    assert C.st_dbscan(t.limit(0), 3, 40.0, 30).count() == C.cluster_summary(t.limit(0), [(3, 40.0, 30)]).count() == 0
