"""Density regions of live streams, kept up to date instead of clustered anew.

State per stream are the newest records and the clusters found in them, both by time chunk. A micro-batch changes the
chunks that its records fall in and those that the oldest records leave; only these and the chunks beside them are
clustered again. The clusters of the others stay as they are stored, and what neighbouring chunks claim together is
merged each time, which takes a few numbers per chunk. So records can come in any order, and the regions are at all
times those that the batch operator finds in the same records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strideflow.operators import density
from strideflow.operators.timeline import chunk_length
from strideflow.schemas import (
    LATEST_TRACES, MAX_DISTANCE_M, MAX_TIME_DIFFERENCE_MS, MIN_POINTS, NOISE_CLUSTER, STREAM_KEYS, TRACE,
)
from strideflow.streaming.segments import batch_of, milliseconds, plain, with_clock

cloudpickle.register_pickle_by_value(density)

NAMES = ["timestamp", *[f.name for f in TRACE.fields if f.name not in (*STREAM_KEYS, "timestamp")]]
ARRAYS = ", ".join(f"{n} array<{TRACE[n].dataType.simpleString()}>" for n in NAMES)
FOUND = ["core", "component", "beside", "beside_of", "claimed", "claimed_by"]
REACHES = 16


def resolved(found: list[dict[str, list[int]]]) -> dict[int, int]:
    """Cluster number of every time that has one, from the clusters of all chunks."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    claims: dict[int, int] = {}
    for chunk in found:
        for ts, name in zip(chunk["claimed"], chunk["claimed_by"]):
            a, b = root(claims.setdefault(ts, name)), root(name)
            if a != b:
                parent[max(a, b)] = min(a, b)
    number = {c: i for i, c in enumerate(sorted({root(c) for chunk in found for c in chunk["component"]}))}
    labels: dict[int, int] = {}
    for chunk in found:
        labels.update((ts, number[root(c)]) for ts, c in zip(chunk["core"], chunk["component"]))
    for chunk in found:
        for ts, c in zip(chunk["beside"], chunk["beside_of"]):
            labels[ts] = max(labels.get(ts, NOISE_CLUSTER), number[root(c)])
    return labels


class Regions(StatefulProcessor):
    def __init__(self, min_points: int, distance_m: float, time_ms: int, latest: int, chunk_ms: int, idle_ms: int):
        self.params, self.latest, self.chunk_ms, self.idle_ms = (min_points, float(distance_m), time_ms), latest, chunk_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "chunk long", ARRAYS)
        self.found = handle.getMapState("found", "chunk long", ", ".join(f"{n} array<bigint>" for n in FOUND))
        self.expiry = handle.getValueState("expiry", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Every call to the store takes its time, so a stream that has nothing there is not asked for.
        there = self.expiry.get() is not None
        held = [values for _, values in self.records.iterator()] if there else []
        known = pd.DataFrame({n: [v for values in held for v in values[i]] for i, n in enumerate(NAMES)})
        new = batch_of(rows, NAMES).drop_duplicates("timestamp")
        # A record sent twice stays one record.
        if len(known):
            new = new[~new["timestamp"].isin(known["timestamp"])]
        newest = pd.concat([known, new], ignore_index=True) if len(known) else new
        if len(newest) > self.latest:
            newest = newest.nlargest(self.latest, "timestamp")
        newest = newest.sort_values("timestamp", ignore_index=True)
        newest = newest.astype({n: "int64" if n == "timestamp" else "float64" for n in NAMES})
        oldest = newest["timestamp"].iloc[0]
        moved = [*new["timestamp"][new["timestamp"] >= oldest], *known["timestamp"][known["timestamp"] < oldest]]
        yield self.clustered(key, newest, {int(t) // self.chunk_ms for t in moved}, there)
        self.wake(int(newest["timestamp"].iloc[-1]), timerValues.getCurrentWatermarkInMs())

    def clustered(self, key: tuple, newest: pd.DataFrame, changed: set[int], known: bool) -> pd.DataFrame:
        chunk = (newest["timestamp"] // self.chunk_ms).to_numpy()
        ts, lat, lng = (newest[c].to_numpy() for c in ("timestamp", "latitude", "longitude"))
        there = set(chunk.tolist())
        columns = [plain(newest[n]) for n in NAMES]
        for c in changed:
            if c in there:
                first, last = np.searchsorted(chunk, [c, c + 1]).tolist()
                self.records.updateValue((c,), tuple(values[first:last] for values in columns))
            else:
                self.records.removeKey((c,))
        found = {k[0]: dict(zip(FOUND, values)) for k, values in self.found.iterator()} if known else {}
        for c in [c for c in found if c not in there]:
            self.found.removeKey((c,))
            del found[c]
        for c in {c + d for c in changed for d in (-1, 0, 1)} & there:
            found[c] = self.around(ts, lat, lng, c)
            self.found.updateValue((c,), tuple(found[c][n] for n in FOUND))
        labels = resolved(list(found.values()))
        label = np.array([labels.get(t, NOISE_CLUSTER) for t in ts.tolist()], np.int32)
        out = pd.DataFrame({**dict(zip(STREAM_KEYS, key)), **{n: newest[n].array for n in NAMES}, "cluster_id": label})
        return out[[*TRACE.fieldNames(), "cluster_id"]]

    def around(self, ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, c: int) -> dict[str, list[int]]:
        """The clusters in reach of one chunk, by times."""
        start, end, halo = c * self.chunk_ms, (c + 1) * self.chunk_ms, 2 * self.params[2]
        near = (ts >= start - halo) & (ts < end + halo)
        chunk = density.Chunk(*density.moments(ts[near], lat[near], lng[near]), start, end, self.params[2])
        [(core, component, beside, beside_of)] = chunk.clusters([self.params])
        own, shared = core & chunk.own, core & chunk.shared
        parts = [chunk.ts[own], chunk.ts[component[own]], chunk.ts[beside], chunk.ts[beside_of], chunk.ts[shared], chunk.ts[component[shared]]]
        return dict(zip(FOUND, (p.tolist() for p in parts)))

    def wake(self, last: int, watermark: int) -> None:
        at, held = max(last + self.idle_ms, watermark) + 1, self.expiry.get()
        if held is not None and held[0] == at:
            return
        if held is not None and held[0] > watermark:
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(at)
        self.expiry.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.expiry.get()
        if held is not None and held[0] <= timerValues.getCurrentWatermarkInMs():
            for state in (self.records, self.found, self.expiry):
                state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_regions(traces: DataFrame, latest: int = LATEST_TRACES, min_points: int = MIN_POINTS,
                   distance_m: float = MAX_DISTANCE_M, time_ms: int = MAX_TIME_DIFFERENCE_MS,
                   chunk_ms: int | None = None, idle: str = "7 days") -> DataFrame:
    """The newest records of every stream that got new ones, with the ``cluster_id`` that ``st_dbscan`` gives them."""
    chunk_ms = REACHES * time_ms if chunk_ms is None else chunk_length(chunk_ms, 2 * time_ms)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRACE.fields)
    return with_clock(traces.select(*TRACE.fieldNames())).groupBy(*STREAM_KEYS).transformWithStateInPandas(
        Regions(min_points, distance_m, time_ms, latest, chunk_ms, milliseconds(idle)), f"{ddl}, cluster_id int", "append", "EventTime"
    )
