"""Runs that are there as a whole or not at all; zones that choose files; coordinates that are looked up once."""

import os
import random

import pytest
from helpers import frame, random_streams
from pyspark.sql import functions as F

from strideflow.operators.poi import SPOT, poi_counts
from strideflow.sources import committed as C
from strideflow.sources import place_cache as P
from strideflow.sources import zones as Z
from strideflow.sources.traces import latest_traces, traces_between


def test_a_failed_run_leaves_nothing_and_a_repeated_one_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).withColumn("v", F.lit("first"))
    assert C.read_runs(spark, path, rows.schema).count() == 0 and C.vacuum(spark, path) == 0
    C.write_run(rows, path, "a")
    broken = spark.range(100).repartition(4).withColumn("v", F.when(F.col("id") < 99, F.lit("half")).otherwise(F.raise_error(F.lit("lost")).cast("string")))
    for run in ("a", "b"):
        with pytest.raises(Exception, match="lost"):
            C.write_run(broken, path, run)
    # a run whose rows are written but whose entry is not
    rows.withColumn("v", F.lit("half")).write.parquet(f"{path}/runs/a/{'0' * 32}/data")
    got = C.read_runs(spark, path, rows.schema).collect()
    assert len(got) == 100 and {(r.v, r.run) for r in got} == {("first", "a")}
    before = C.read_runs(spark, path, rows.schema)
    C.write_run(rows.withColumn("v", F.lit("second")), path, "a")
    assert {r.v for r in C.read_runs(spark, path, rows.schema).collect()} == {"second"}
    assert {r.v for r in before.collect()} == {"first"}  # who reads the old rows reads them to the end
    assert C.vacuum(spark, path) >= 2 and C.read_runs(spark, path, rows.schema).count() == 100 and C.vacuum(spark, path) == 0
    with pytest.raises(ValueError):
        C.write_run(rows, path, "../x")
    assert C.read_runs(spark, path, rows.schema, runs=["other"]).count() == 0


def opened(df):
    return {os.path.basename(f) for f in df.inputFiles()}


def test_selections_open_only_the_files_they_need(spark, tmp_path):
    path = str(tmp_path / "t")
    data = random_streams(41, users=6, n=400, max_step=20)
    for k in range(2):
        Z.write_indexed(frame(spark, data[k::2]), path, f"run-{k}", files=12)
    whole = frame(spark, data)
    everything = opened(Z.read_zones(spark, path).sparkSession.read.parquet(*[f"{f}/data" for f in C.committed(spark, path).values()]))
    assert len(everything) == 24 and Z.read_zones(spark, path).agg(F.sum("n")).first()[0] == len(data)
    some = sorted(r["timestamp"] for r in data if r["user"] == "u3")[100:140]
    got = Z.indexed_between(spark, path, "u3", True, some[0], some[-1])
    assert got.collect() == traces_between(whole, "u3", True, some[0], some[-1]).collect() and got.count() == 38
    assert 1 <= len(opened(got)) <= 6
    assert Z.indexed_between(spark, path, "nobody", True, 0, 10**15).count() == 0
    for n in (1, 5, 30, 10_000):
        got = Z.indexed_latest(spark, path, n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latest_traces(whole, n).collect()))
    assert len(opened(Z.indexed_latest(spark, path, 5))) <= 14
    assert Z.indexed_latest(spark, str(tmp_path / "none")).count() == 0


def test_zones_of_the_latest_are_enough_and_few(spark):
    rng = random.Random(8)
    zones, records = [], {}
    for f in range(200):
        user = rng.choice("ab")
        base = rng.randrange(950)
        ts = sorted(rng.sample(range(base, base + 50), rng.randrange(1, 30)))
        zones.append((user, True, f"f{f}", ts[0], ts[-1], len(ts)))
        records.setdefault(user, []).extend((t, f"f{f}") for t in ts)
    table = spark.createDataFrame(zones, Z.ZONE)
    for n in (1, 10, 500, 100_000):
        kept = {(r.user, r.file) for r in Z.latest_zones(table, n).collect()}
        for user, own in records.items():
            newest = sorted((t for t, _ in own), reverse=True)[:n]
            assert {f for t, f in own if t > newest[-1] or n >= len(own)} <= {f for u, f in kept if u == user}
    assert len({r.file for r in Z.latest_zones(table, 1).collect()}) < 30


def test_known_coordinates_are_not_looked_up_again(spark, traces, pois, tmp_path, monkeypatch):
    asked = []
    plain = P.poi_counts
    monkeypatch.setattr(P, "poi_counts", lambda points, *a, **k: (asked.append(points.count()), plain(points, *a, **k))[1])
    path = str(tmp_path / "c")
    spots = traces.select(*SPOT).distinct()
    half = spots.where(F.pmod(F.xxhash64(*SPOT), F.lit(2)) == 0)
    want = {tuple(r) for r in poi_counts(traces, pois, include_other=True).collect()}
    first = P.cached_poi_counts(half, pois, path)
    n_half, n = half.count(), spots.count()
    assert first.count() == n_half and asked == [n_half]
    both = P.cached_poi_counts(traces.union(traces), pois, path).drop("run")
    assert {tuple(r) for r in both.collect()} == want and asked == [n_half, n - n_half]
    again = P.cached_poi_counts(spots, pois.repartition(3), path).drop("run")
    assert {tuple(r) for r in again.collect()} == want and len(asked) == 2
    P.cached_poi_counts(half, pois, path, radius_m=35.0)
    assert asked[2:] == [n_half]
    moved = pois.withColumn("latitude", F.when(F.col("poi_id") == 1, 0.0).otherwise(F.col("latitude")))
    changed = P.cached_poi_counts(spots, moved, path).drop("run")
    assert asked[3:] == [n]
    assert {tuple(r) for r in changed.collect()} == {tuple(r) for r in poi_counts(traces, moved, include_other=True).collect()}
    nothing = P.cached_poi_counts(spark.createDataFrame([(None, 1.0)], "latitude double, longitude double"), pois, path)
    assert nothing.count() == 0
