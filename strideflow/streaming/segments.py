"""Closed segments, closed windows and window features of live trace streams.

Records may come out of order by up to a delay. Per stream, everything up to a *horizon* is taken to be there: the largest time
of the stream itself, or of all streams in earlier micro-batches, less the delay. What the horizon has passed comes out, whole
and once; what arrives behind it is *late*, and what is further ahead than the clock allows is *ahead*. With ``sides=True`` such
records come out too, marked in the column ``side``, so that every record that went in is accounted for.

State lives in the keyed state store: a list of what is still open, a value with the end of what came out, and one event-time
timer per stream for the next thing to close. As the horizon follows a stream's own records within a micro-batch, the state is
bounded by delay, gap and duration, however large the backlog that is read in one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from strideflow.operators.features import features_basic, features_location_aware
from strideflow.schemas import MIN_WINDOW_RECORDS, POI_RADIUS_M, SEGMENT_GAP_MS, STREAM_KEYS, WINDOW_MS
from strideflow.session import ROCKSDB, STATE_STORE, scratch, stage

# Before any time.
NO_TIME = -(2**62)
# Event times are moved ahead by as much as the watermark lags behind, so that the watermark is the largest time of
# all records and Spark drops none of them: what is late is for the operators to say.
FAR_DAYS = 36_500
FAR_MS = FAR_DAYS * 24 * 3600 * 1000
# Records of a state entry.
ENTRY_RECORDS = 1000
UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(span: str) -> int:
    """A span such as "10 seconds" as a number."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", span)
    if not found or found[2] not in UNITS:
        raise ValueError(f"not a span of time: {span!r}")
    return int(found[1]) * UNITS[found[2]]


def with_clock(traces: DataFrame) -> DataFrame:
    """``traces`` with an event time whose watermark is the largest time of all records of earlier micro-batches.

    Keyed state needs the RocksDB store; a session that was set up without it gets it for the queries it starts from now on.
    """
    conf = traces.sparkSession.conf
    if "RocksDB" not in conf.get(STATE_STORE, ""):
        conf.set(STATE_STORE, ROCKSDB)
    return traces.withColumn("event_time", F.timestamp_millis(F.col("timestamp") + FAR_MS)).withWatermark("event_time", f"{FAR_DAYS} days")


def split_by_clock(traces: DataFrame, ahead_ms: int, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records up to ``ahead_ms`` beyond the clock, and those further ahead.

    The horizon follows the largest time of all streams, so one wrong clock would make the records of every other
    stream late. Records without a time are in the first part, where operators refuse them.
    """
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    ahead = F.coalesce(F.col("timestamp") > now + F.lit(ahead_ms), F.lit(False))
    return traces.where(~ahead), traces.where(ahead)


def batch_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """All rows of one key in a micro-batch."""
    parts = [b[columns] for b in batches]
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def plain(values: pd.Series) -> list:
    """The values of a column as Python has them, None for a missing one."""
    listed, missing = values.tolist(), values.isna().to_numpy()
    return [None if m else v for v, m in zip(listed, missing.tolist())] if missing.any() else listed


class Closing(StatefulProcessor):
    """What segments and windows share: the horizon, the late records and the timer."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def horizon_before(self, seen: int | None, watermark: int) -> int:
        return max(NO_TIME if seen is None else seen, watermark - self.delay_ms)

    def wake(self, handle: StatefulProcessorHandle, old: int | None, at: int | None, watermark: int) -> int | None:
        """Have the stream looked at when the horizon has passed ``at``; its earlier timer goes."""
        new = None if at is None else max(at + self.delay_ms, watermark) + 1
        if old is not None and old != new and old > watermark:
            handle.deleteTimer(old)
        if new is not None and (old != new or old <= watermark):
            handle.registerTimer(new)
        return new

    def close(self) -> None:
        pass


class Segments(Closing):
    """Open segments of a stream as ``(start, end, records)``."""

    def __init__(self, keys: list[str], gap_ms: int, delay_ms: int):
        super().__init__(delay_ms)
        self.keys, self.gap_ms = keys, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start_ts long, end_ts long, n_records long")
        self.at = handle.getValueState("at", "horizon long, wake long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.step(key, batch_of(rows, ["timestamp"])["timestamp"].to_numpy(np.int64), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key, np.zeros(0, np.int64), timerValues.getCurrentWatermarkInMs())

    def step(self, key: tuple, ts: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        seen, old = self.at.get() or (None, None)
        horizon = self.horizon_before(seen, watermark)
        late, ts = ts[ts <= horizon], ts[ts > horizon]
        horizon = max(horizon, int(ts.max()) - self.delay_ms) if len(ts) else horizon
        held = np.array(list(self.open.get()), np.int64).reshape(-1, 3)
        starts, ends, counts = (np.concatenate([held[:, i], x]) for i, x in enumerate((ts, ts, np.ones(len(ts), np.int64))))
        order = np.argsort(starts, kind="stable")
        starts, ends, counts = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends, counts[order]
        first = np.flatnonzero(np.concatenate(([True], starts[1:] - ends[:-1] > self.gap_ms))) if len(starts) else np.zeros(0, np.int64)
        merged = np.column_stack([
            starts[first], ends[np.append(first[1:], len(ends)) - 1] if len(first) else ends, np.add.reduceat(counts, first) if len(first) else counts,
        ]).astype(np.int64)
        closed = merged[:, 1] + self.gap_ms < horizon
        out = pd.DataFrame(merged[closed], columns=["start_ts", "end_ts", "n_records"]).assign(side="segment")
        if len(late):
            out = pd.concat([out, pd.DataFrame({"start_ts": late, "end_ts": late, "n_records": 1, "side": "late"})], ignore_index=True)
        rest = merged[~closed]
        if len(rest):
            self.open.put([tuple(r) for r in rest.tolist()])
            self.at.update((horizon, self.wake(self.handle, old, int(rest[:, 1].min()) + self.gap_ms, watermark)))
        else:
            # The watermark of the next micro-batch covers the horizon, so nothing need be remembered.
            self.wake(self.handle, old, None, watermark)
            self.open.clear()
            self.at.clear()
        if len(out):
            for name, value in zip(self.keys, key):
                out[name] = value
            yield out[[*self.keys, "start_ts", "end_ts", "n_records", "side"]]


class Windows(Closing):
    """Records of a stream whose window is open, by columns, some hundreds to a state entry."""

    def __init__(self, keys: list[str], payload: list[tuple[str, str]], gap_ms: int, duration_ms: int, delay_ms: int):
        super().__init__(delay_ms)
        self.keys, self.payload = keys, payload
        self.gap_ms, self.duration_ms = gap_ms, duration_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ", ".join(f"{n} array<{t}>" for n, t in [("timestamp", "long"), *self.payload]))
        # The last record that came out, the start of its segment, the horizon, the timer.
        self.at = handle.getValueState("at", "last_ts long, seg_start long, horizon long, wake long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = batch_of(rows, ["timestamp", *[n for n, _ in self.payload]])
        yield from self.step(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key, None, timerValues.getCurrentWatermarkInMs())

    def step(self, key: tuple, new: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        names = ["timestamp", *[n for n, _ in self.payload]]
        at = self.at.get()
        last_ts, seg_start, seen, old = at or (None, None, None, None)
        horizon = self.horizon_before(seen, watermark)
        # Every call to the store takes its time, so a stream that has nothing there is not asked for.
        held = list(self.open.get()) if at else []
        # One frame, so that a column that is missing in one entry has the type it has in the others.
        parts = [pd.DataFrame({n: [v for entry in held for v in entry[i]] for i, n in enumerate(names)})] if held else []
        if new is not None:
            late = (new["timestamp"] <= horizon).to_numpy()
            if late.any():
                yield self.out(key, new[late], "late", None, None)
            if not late.all():
                parts.append(new[~late] if late.any() else new)
                horizon = max(horizon, int(new["timestamp"].max()) - self.delay_ms)
        if not parts:
            if last_ts is not None and last_ts + self.gap_ms >= horizon:  # the segment may go on
                self.at.update((last_ts, seg_start, horizon, self.wake(self.handle, old, last_ts + self.gap_ms, watermark)))
            else:
                self.forget(old, watermark, at, held)
            return
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        ts = rows["timestamp"].to_numpy(np.int64)
        if (ts[1:] < ts[:-1]).any():
            rows = rows.iloc[np.argsort(ts, kind="stable")]
            ts = rows["timestamp"].to_numpy(np.int64)
        before = np.concatenate([[ts[0] - self.gap_ms - 1 if last_ts is None else last_ts], ts[:-1]])
        starts = np.maximum.accumulate(np.where(ts - before > self.gap_ms, ts, NO_TIME if seg_start is None else seg_start))
        win = np.maximum((ts - starts + self.duration_ms - 1) // self.duration_ms - 1, 0)
        ends = starts + (win + 1) * self.duration_ms
        # A segment is over once the horizon is beyond its last record plus the gap.
        seg_last = ts[np.searchsorted(starts, starts, "right") - 1]
        closed = (ends < horizon) | (seg_last + self.gap_ms < horizon)
        n = len(ts) if closed.all() else int(np.argmin(closed))
        if n:
            yield self.out(key, rows.iloc[:n], "window", starts[:n], win[:n])
            last_ts, seg_start = int(ts[n - 1]), int(starts[n - 1])
        if n == len(ts) and last_ts + self.gap_ms < horizon:
            self.forget(old, watermark, at, held)
            return
        rest = rows.iloc[n:]
        if len(rest):
            columns = [plain(rest[name]) for name in names]
            self.open.put([tuple(c[i:i + ENTRY_RECORDS] for c in columns) for i in range(0, len(rest), ENTRY_RECORDS)])
        elif held:
            self.open.clear()
        closes = int(min(ends[n], seg_last[n] + self.gap_ms)) if len(rest) else last_ts + self.gap_ms
        self.at.update((last_ts, seg_start, horizon, self.wake(self.handle, old, closes, watermark)))

    def forget(self, old: int | None, watermark: int, at: tuple | None, held: list) -> None:
        self.wake(self.handle, old, None, watermark)
        if held:
            self.open.clear()
        if at:
            self.at.clear()

    def out(self, key: tuple, rows: pd.DataFrame, side: str, starts: np.ndarray | None, win: np.ndarray | None) -> pd.DataFrame:
        none = pd.array([pd.NA] * len(rows), "Int64") if starts is None or win is None else None
        return pd.DataFrame({
            **dict(zip(self.keys, key)), **{n: rows[n].array for n in ("timestamp", *[n for n, _ in self.payload])},
            "seg_start": none if starts is None else starts, "win_id": none.astype("Int32") if win is None else win.astype(np.int32), "side": side,
        })


def _guarded(traces: DataFrame, ahead_ms: int | None, now: Column | None) -> tuple[DataFrame, DataFrame | None]:
    return (traces, None) if ahead_ms is None else split_by_clock(traces, ahead_ms, now)


def stream_segments(traces: DataFrame, gap_ms: int = SEGMENT_GAP_MS, delay: str = "10 seconds", keys: list[str] = STREAM_KEYS,
                    sides: bool = False, ahead_ms: int | None = None, now: Column | None = None) -> DataFrame:
    """Segments that the horizon has closed: records at most ``gap_ms`` apart share one.

    A stream without a pause stays one open segment, a single row of state; use ``stream_windows`` for such streams.
    With ``sides`` a late or early record is a row of its own, marked in ``side``; others are marked "segment".
    """
    rows, ahead = _guarded(traces.select(*keys, "timestamp"), ahead_ms, now)
    ddl = ", ".join(f"{k} {traces.schema[k].dataType.simpleString()}" for k in keys)
    out = with_clock(rows).groupBy(*keys).transformWithStateInPandas(
        Segments(keys, gap_ms, milliseconds(delay)), f"{ddl}, start_ts long, end_ts long, n_records long, side string", "append", "EventTime",
    )
    if not sides:
        return out.where("side = 'segment'").drop("side")
    if ahead is None:
        return out
    early = ahead.select(*keys, F.col("timestamp").alias("start_ts"), F.col("timestamp").alias("end_ts"), F.lit(1).cast("long").alias("n_records"), F.lit("ahead").alias("side"))
    return out.union(early)


def stream_windows(traces: DataFrame, gap_ms: int = SEGMENT_GAP_MS, duration_ms: int = WINDOW_MS, delay: str = "10 seconds",
                   keys: list[str] = STREAM_KEYS, sides: bool = False, ahead_ms: int | None = None, now: Column | None = None) -> DataFrame:
    """Records of closed windows with ``seg_start`` and ``win_id``, also while a segment goes on.

    A window comes out, whole and once, when the horizon passes its end. With ``sides`` late and early records come out
    too, without a window and marked in ``side``; others are marked "window".
    """
    if gap_ms > duration_ms:
        raise ValueError("gap_ms must not exceed duration_ms")
    payload = [(f.name, f.dataType.simpleString()) for f in traces.schema.fields if f.name not in (*keys, "timestamp")]
    rows, ahead = _guarded(traces, ahead_ms, now)
    ddl = ", ".join(f"{n} {t}" for n, t in [*[(k, traces.schema[k].dataType.simpleString()) for k in keys], ("timestamp", "long"), *payload])
    out = with_clock(rows).groupBy(*keys).transformWithStateInPandas(
        Windows(keys, payload, gap_ms, duration_ms, milliseconds(delay)), f"{ddl}, seg_start long, win_id int, side string", "append", "EventTime",
    )
    if not sides:
        return out.where("side = 'window'").drop("side")
    if ahead is None:
        return out
    none = [F.lit(None).cast("long").alias("seg_start"), F.lit(None).cast("int").alias("win_id"), F.lit("ahead").alias("side")]
    return out.union(ahead.select(*keys, "timestamp", *[n for n, _ in payload], *none))


def stream_features(traces: DataFrame, pois: DataFrame | None, path: str, checkpoint: str, keys: list[str] = STREAM_KEYS,
                    gap_ms: int = SEGMENT_GAP_MS, duration_ms: int = WINDOW_MS, delay: str = "10 seconds",
                    min_records: int = MIN_WINDOW_RECORDS, radius_m: float = POI_RADIUS_M) -> DataStreamWriter:
    """Features of closed windows, written to one folder per micro-batch below ``path``; ``seg_start`` names a segment.

    With places, the 28 features: ``cluster_id`` must then be among the keys. The windows that a micro-batch closes are whole, so
    they meet the places in the same joins as in batch, each coordinate once. A repeated batch replaces its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession, "features"):
            closed = stage(batch.withColumnRenamed("seg_start", "seg_id"), "closed")
            if closed.isEmpty():
                return
            if pois is None:
                found = features_basic(closed, keys, min_records)
            else:
                found = features_location_aware(closed, pois, keys, min_records, radius_m)
            found.withColumnRenamed("seg_id", "seg_start").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    windows = stream_windows(traces, gap_ms, duration_ms, delay, keys)
    return windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
