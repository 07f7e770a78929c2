"""Spatio-temporal density clustering (ST-DBSCAN) and stay/trip labelling.

A record is *core* when it has at least ``min_points`` neighbours. Clusters are the connected
components of core records under the neighbour relation, numbered per stream by their first
core timestamp. A record that is not core joins the highest-numbered cluster among its core
neighbours, and everything else is noise.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.operators import density
from strideflow.operators.components import connected_components
from strideflow.operators.timeline import chunk_length, named_streams, ordinal, tile
from strideflow.schemas import (
    MAX_DISTANCE_M, MAX_TIME_DIFFERENCE_MS, MIN_POINTS, NOISE_CLUSTER, STREAM_KEYS, TRIP_ACTIVITIES,
)
from strideflow.session import stage

# Functions that run in tasks travel with their code, so executors need no copy of the package.
for module in (density, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _opened(table: pa.Table, grid: list[tuple[int, float, int]], chunk_ms: int):
    """The distinct moments of a chunk and its clusters for each row of the grid."""
    chunk = table.column("chunk")[0].as_py()
    ts = table.column("timestamp").to_numpy()
    found = density.Chunk(
        *density.moments(ts, _numbers(table, "latitude"), _numbers(table, "longitude")),
        chunk * chunk_ms, (chunk + 1) * chunk_ms, max(ms for _, _, ms in grid),
    )
    return ts, found, found.clusters(grid)


def _local_clusters(params: tuple[int, float, int], chunk_ms: int, columns: list[str], keys: list[str]):
    """Own records with the names of their local components; and claims, records without values of their own."""

    def local(table: pa.Table) -> pa.Table:
        ts, chunk, [(core, component, beside, beside_of)] = _opened(table, [params], chunk_ms)
        names = [[] for _ in chunk.ts]
        for k in np.flatnonzero(core & chunk.own):
            names[k] = [int(chunk.ts[component[k]])]
        for k, c in zip(beside.tolist(), chunk.ts[beside_of].tolist()):
            names[k].append(c)
        start = table.column("chunk")[0].as_py() * chunk_ms
        own = np.flatnonzero((ts >= start) & (ts < start + chunk_ms))
        at = np.searchsorted(chunk.ts, ts[own])
        met = at < len(chunk.ts)
        met[met] = chunk.ts[at[met]] == ts[own][met]
        listed = [names[k] if m else [] for k, m in zip(at.tolist(), met.tolist())]
        rows = table.take(pa.array(own)).append_column("names", pa.array(listed, pa.list_(pa.int64())))
        rows = rows.append_column("claim", pa.array(np.zeros(len(own), bool)))
        claims = np.flatnonzero(core & chunk.shared) if len(own) else np.zeros(0, np.int64)
        made = {"timestamp": pa.array(chunk.ts[claims], pa.int64()), "claim": pa.array(np.ones(len(claims), bool)),
                "names": pa.array([[int(x)] for x in chunk.ts[component[claims]]], pa.list_(pa.int64()))}
        given = {c: pa.chunked_array([pa.array([table.column(c)[0].as_py()] * len(claims), table.schema.field(c).type)]) for c in [*keys, "chunk"]}
        plain = pa.table({
            f.name: made.get(f.name, given.get(f.name, None)) if f.name in made or f.name in given else pa.nulls(len(claims), f.type)
            for f in rows.schema
        }, schema=rows.schema)
        return pa.concat_tables([rows, plain]).select([*columns, "chunk", "names", "claim"])

    return local


def _numbered(claims: DataFrame, used: DataFrame, keys: list[str], chunk_ms: int) -> DataFrame:
    """``(keys, chunk, names)``: the cluster number of every local component that a chunk uses, as a map.

    ``claims`` has (keys, timestamp, name), at most one row for each of the two chunks that share a record; ``used``
    has (keys, chunk, name). Local components that claim a record together are one cluster, named by its first core.
    """
    both = claims.groupBy(*keys, "timestamp").agg(F.max("name").alias("hi"), F.min("name").alias("lo")).where("hi > lo")
    merged = connected_components(both.select(*keys, "hi", "lo"), keys)
    used = used.distinct()
    if merged is None:
        named = used.withColumn("component", F.col("name"))
    else:
        merged = merged.withColumnRenamed("node", "name")
        named = used.join(merged, [*keys, "name"], "left").withColumn("component", F.coalesce("component", "name"))
    named = stage(named, "local-clusters")
    numbers = ordinal(named.select(*keys, "component").distinct(), keys, "component", chunk_ms, "cluster_id")
    entry = F.struct("name", "cluster_id")
    return named.join(numbers, [*keys, "component"]).groupBy(*keys, "chunk").agg(F.map_from_entries(F.collect_list(entry)).alias("numbers"))


def st_dbscan(traces: DataFrame, min_points: int = MIN_POINTS, distance_m: float = MAX_DISTANCE_M,
              time_ms: int = MAX_TIME_DIFFERENCE_MS, keys: list[str] = STREAM_KEYS,
              chunk_ms: int | None = None) -> DataFrame:
    """Add ``cluster_id``: 0, 1, … per stream, -1 for noise. Streams are clustered on their own.

    Records without a fix are noise; records that share a time share a label. Samples are shuffled once, with all their
    columns, to their time chunk, where the clusters within reach of the chunk are found. The call itself runs
    jobs: that table is written, and the few claims of neighbouring chunks are resolved into cluster numbers.
    """
    chunk_ms = chunk_length(chunk_ms, 2 * time_ms)
    rows = tile(named_streams(traces, keys), chunk_ms, before=2 * time_ms, after=2 * time_ms)
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema.fields],
        T.StructField("names", T.ArrayType(T.LongType())), T.StructField("claim", T.BooleanType()),
    ])
    found = rows.groupBy(*keys, "chunk").applyInArrow(
        _local_clusters((min_points, float(distance_m), time_ms), chunk_ms, traces.columns, keys), schema
    )
    local = stage(found, "chunk-clusters")
    claims = local.where("claim").select(*keys, "timestamp", F.col("names")[0].alias("name"))
    used = local.where("NOT claim").select(*keys, "chunk", F.explode("names").alias("name"))
    numbers = _numbered(claims, used, keys, chunk_ms)
    label = F.array_max(F.transform("names", lambda n: F.try_element_at("numbers", n)))
    return local.where("NOT claim").join(numbers, [*keys, "chunk"], "left").select(
        *traces.columns, F.coalesce(label, F.lit(NOISE_CLUSTER)).cast("int").alias("cluster_id")
    )


PARTIAL = "size long, start_time long, start_lat double, start_lng double, end_time long, end_lat double, end_lng double"


def _local_summaries(grid: list[tuple[int, float, int]], chunk_ms: int, keys: list[str]):
    """Per row of the grid: sums of each set of records with the same local names (none is noise); and claims."""

    def local(table: pa.Table) -> pa.Table:
        ts, chunk, clusters = _opened(table, grid, chunk_ms)
        start = table.column("chunk")[0].as_py() * chunk_ms
        lat, lng = _numbers(table, "latitude"), _numbers(table, "longitude")
        own = np.flatnonzero((ts >= start) & (ts < start + chunk_ms))
        own = own[np.lexsort((lng[own], lat[own], ts[own]))]
        at = np.searchsorted(chunk.ts, ts[own])
        met = at < len(chunk.ts)
        met[met] = chunk.ts[at[met]] == ts[own][met]
        out = []
        for g, (core, component, beside, beside_of) in enumerate(clusters):
            sets: list[tuple] = [()] * len(chunk.ts)
            for k in np.flatnonzero(core & chunk.own).tolist():
                sets[k] = (int(chunk.ts[component[k]]),)
            for k, c in zip(beside.tolist(), chunk.ts[beside_of].tolist()):
                sets[k] += (c,)
            rows: dict[tuple, list[int]] = {}
            for r, k, m in zip(own.tolist(), at.tolist(), met.tolist()):
                rows.setdefault(sets[k] if m else (), []).append(r)
            for names, members in rows.items():
                a, b = members[0], members[-1]
                out.append((g, list(names), False, None, len(members), int(ts[a]), lat[a], lng[a], int(ts[b]), lat[b], lng[b]))
            if len(own):
                for k in np.flatnonzero(core & chunk.shared).tolist():
                    out.append((g, [int(chunk.ts[component[k]])], True, int(chunk.ts[k]), *[None] * 7))
        made = pa.table(list(map(list, zip(*out))) if out else [[]] * 11, schema=pa.schema([
            ("grid", pa.int32()), ("names", pa.list_(pa.int64())), ("claim", pa.bool_()), ("timestamp", pa.int64()), ("size", pa.int64()),
            ("start_time", pa.int64()), ("start_lat", pa.float64()), ("start_lng", pa.float64()), ("end_time", pa.int64()),
            ("end_lat", pa.float64()), ("end_lng", pa.float64()),
        ]))
        for c in reversed([*keys, "chunk"]):
            made = made.add_column(0, c, pa.array([table.column(c)[0].as_py()] * made.num_rows, table.schema.field(c).type))
        return made

    return local


def cluster_summary(traces: DataFrame, grid: Iterable[tuple[int, float, int]], keys: list[str] = STREAM_KEYS,
                    chunk_ms: int | None = None) -> DataFrame:
    """Size, duration, first and last place of every cluster for each ``(min_points, metres, ms)``.

    One pass for the whole grid: a chunk has its neighbours within the widest reach, counts them for every row of the grid
    and hands on sums of its local clusters. Positions of records that share a time are the smallest and the largest.
    """
    grid = [(int(p), float(d), int(ms)) for p, d, ms in grid]
    widest = max(ms for _, _, ms in grid)
    chunk_ms = chunk_length(chunk_ms, 2 * widest)
    points = named_streams(traces.select(*keys, "timestamp", "latitude", "longitude"), keys)
    rows = tile(points, chunk_ms, before=2 * widest, after=2 * widest)
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "chunk"])
    found = rows.groupBy(*keys, "chunk").applyInArrow(
        _local_summaries(grid, chunk_ms, keys), f"{ddl}, grid int, names array<bigint>, claim boolean, timestamp long, {PARTIAL}"
    )
    local = stage(found, "chunk-summaries")
    of = ["grid", *keys]
    claims = local.where("claim").select(*of, "timestamp", F.col("names")[0].alias("name"))
    used = local.where("NOT claim").select(*of, "chunk", F.explode("names").alias("name"))
    numbers = _numbered(claims, used, of, chunk_ms)
    label = F.array_max(F.transform("names", lambda n: F.try_element_at("numbers", n)))
    parts = local.where("NOT claim").join(numbers, [*of, "chunk"], "left").withColumn("cluster_id", F.coalesce(label, F.lit(NOISE_CLUSTER)))
    first, last = (F.struct(*[f"{side}_{c}" for c in ("time", "lat", "lng")]) for side in ("start", "end"))
    summed = parts.groupBy(*of, "cluster_id").agg(F.sum("size").alias("size"), F.min(first).alias("first"), F.max(last).alias("last"))
    rows_of = F.array(*[F.struct(F.lit(p).alias("min_points"), F.lit(d).alias("distance_m"), F.lit(ms).alias("time_ms")) for p, d, ms in grid])
    return summed.withColumn("of", F.get(rows_of, F.col("grid"))).select(
        "of.min_points", "of.distance_m", "of.time_ms", *keys,
        F.when(F.col("cluster_id") == NOISE_CLUSTER, F.lit("noise")).otherwise(F.col("cluster_id").cast("string")).alias("cluster"),
        "size", (F.col("last.end_time") - F.col("first.start_time")).alias("duration"),
        F.col("first.start_time").alias("start_time"), F.col("first.start_lat").alias("start_lat"), F.col("first.start_lng").alias("start_lng"),
        F.col("last.end_time").alias("end_time"), F.col("last.end_lat").alias("end_lat"), F.col("last.end_lng").alias("end_lng"),
    )


def stay_region(activity: Column) -> Column:
    """1 for activities done in one place, -1 for those that are a trip."""
    return F.when(activity.isin(*TRIP_ACTIVITIES), F.lit(NOISE_CLUSTER)).otherwise(F.lit(1))


def label_regions(traces: DataFrame, location_aware: bool = True) -> DataFrame:
    """Training rule: the label tells stay from trip; without locations everything is one trip."""
    region = stay_region(F.col("activity")) if location_aware else F.lit(NOISE_CLUSTER)
    return traces.withColumn("cluster_id", region)


def recognise_regions(traces: DataFrame, location_aware: bool = True, keys: list[str] = STREAM_KEYS,
                      chunk_ms: int | None = None, **density) -> DataFrame:
    """Recognition rule: clusters are stays, noise is a trip; without locations everything is one trip."""
    if location_aware:
        return st_dbscan(traces, keys=keys, chunk_ms=chunk_ms, **density)
    return traces.withColumn("cluster_id", F.lit(NOISE_CLUSTER))
