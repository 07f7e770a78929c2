"""Continuous recognition of arriving traces."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from strideflow.plans.models import RANDOM_FOREST
from strideflow.plans.recognition import recognise_latest
from strideflow.schemas import LATEST_TRACES, STREAM_KEYS, TRACE
from strideflow.session import scratch, stage
from strideflow.sources.committed import write_run
from strideflow.sources.traces import write_results
from strideflow.streaming.regions import stream_regions
from strideflow.streaming.segments import batch_of, milliseconds, split_by_clock, with_clock

VALUES = [f for f in TRACE.fields if f.name not in STREAM_KEYS and f.name != "timestamp"]
TRACE_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRACE.fields)
IDLE = "7 days"


class Latest(StatefulProcessor):
    """The newest records of a stream, one state entry each, keyed by their time.

    A micro-batch writes the entries that are new and removes those that are no longer among the newest. The value is the
    timer at which a stream that sent nothing more is forgotten; it is set again with each record and goes by event
    time, so it costs no micro-batches of its own and works in runs that end by themselves.
    """

    def __init__(self, latest: int, idle_ms: int):
        self.latest, self.idle_ms = latest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "timestamp long", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VALUES))
        self.expiry = handle.getValueState("expiry", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["timestamp", *[f.name for f in VALUES]]
        new = batch_of(rows, names).drop_duplicates("timestamp").nlargest(self.latest, "timestamp")
        known = pd.DataFrame([(*k, *v) for k, v in self.records.iterator()], columns=names)
        # A record sent twice stays one record.
        new = new[~new["timestamp"].isin(known["timestamp"])]
        newest = (pd.concat([known, new]) if len(known) else new).nlargest(self.latest, "timestamp")
        added = new[new["timestamp"].isin(newest["timestamp"])]
        plain = added.astype(object).where(added.notna(), None)
        for timestamp, *values in plain.itertuples(index=False, name=None):
            self.records.updateValue((timestamp,), tuple(values))
        for timestamp in known["timestamp"][~known["timestamp"].isin(newest["timestamp"])].tolist():
            self.records.removeKey((timestamp,))
        self.wake(int(newest["timestamp"].max()), timerValues.getCurrentWatermarkInMs())
        out = newest.sort_values("timestamp")
        for name, value in zip(STREAM_KEYS, key):
            out[name] = value
        yield out[TRACE.fieldNames()]

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
        # A timer of before the last records is not the stream's any more.
        if held is not None and held[0] <= timerValues.getCurrentWatermarkInMs():
            self.records.clear()
            self.expiry.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_latest(traces: DataFrame, latest: int = LATEST_TRACES, idle: str = IDLE) -> DataFrame:
    """The newest ``latest`` records of every stream that got new ones in this micro-batch.

    They are kept in the state store, so what a micro-batch writes follows its own records, however long the history.
    A stream is forgotten when others are ahead of its last record by ``idle``.
    """
    return with_clock(traces.select(*TRACE.fieldNames())).groupBy(*STREAM_KEYS).transformWithStateInPandas(
        Latest(latest, milliseconds(idle)), TRACE_DDL, "append", "EventTime"
    )


def batch_run(batch_id: int) -> str:
    """The run of a micro-batch; names sort as the batches do."""
    return f"batch-{batch_id:012d}"


def recognise_batch(batch: DataFrame, batch_id: int, pois: DataFrame, models: dict[tuple[bool, bool], PipelineModel] | DataFrame,
                    results_path: str, run_start: int, algorithm: str = RANDOM_FOREST, ahead_path: str | None = None) -> None:
    """Recognise one micro-batch and write its results as a run of their own.

    The batch is written once before it is used several times. A repeated batch replaces its
    run, so nothing is written twice; its intermediate tables are deleted with the batch.
    """
    with scratch(batch.sparkSession, "batch"):
        rows = stage(batch, "latest")
        if ahead_path is not None:
            ahead, rows = rows.where("side = 'ahead'").drop("side"), rows.where("side = 'latest'").drop("side")
            if not ahead.isEmpty():
                write_run(ahead.drop("cluster_id"), ahead_path, batch_run(batch_id))
        if rows.isEmpty():
            return
        results = recognise_latest(rows, pois, models, run_start, algorithm)
        write_results(results, results_path, batch_run(batch_id))


def stream_recognise(traces: DataFrame, pois: DataFrame, models: dict[tuple[bool, bool], PipelineModel] | DataFrame,
                     results_path: str, checkpoint: str, latest: int = LATEST_TRACES,
                     clock: Callable[[], int] = lambda: int(time.time() * 1000), period: str = "10 seconds",
                     available_now: bool = False, algorithm: str = RANDOM_FOREST, ahead_path: str | None = None,
                     ahead_ms: int = 60_000, now: Column | None = None) -> DataStreamWriter:
    """Every ``period``, recognise the latest traces of the users that sent some.

    Their density regions are part of the state and kept up to date with the records.
    With ``ahead_path`` records more than ``ahead_ms`` beyond the clock take no part; they are written there.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        recognise_batch(batch, batch_id, pois, models, results_path, clock(), algorithm, ahead_path)

    if ahead_path is None:
        newest = stream_regions(traces, latest)
    else:
        on_time, ahead = split_by_clock(traces.select(*TRACE.fieldNames()), ahead_ms, now)
        early = ahead.withColumns({"cluster_id": F.lit(None).cast("int"), "side": F.lit("ahead")})
        newest = stream_regions(on_time, latest).withColumn("side", F.lit("latest")).union(early)
    writer = newest.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=period)
