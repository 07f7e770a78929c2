"""Gap segmentation and segment-anchored time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.operators.timeline import (
    attach_carry, by_chunk, carry_from_earlier_chunks, chunk_length, earlier, floor_div, floor_sql,
    in_own_chunk, named_streams, running, tile,
)
from strideflow.schemas import MIN_WINDOW_RECORDS, SEGMENT_GAP_MS, STREAM_KEYS, WINDOW_MS

SEGMENT = ["seg_id"]
WINDOW = ["seg_id", "win_id"]


def _opens(ts: str, gap_ms: int) -> Column:
    return F.expr(f"previous IS NULL OR {ts} - previous > {gap_ms}")


def _segment_carry(traces: DataFrame, keys: list[str], gap_ms: int, chunk_ms: int) -> DataFrame:
    """Per chunk: the last earlier timestamp, the start of the segment it lies in, segments so far.

    Rows that share a bucket of ``gap_ms`` can never be separated by a gap, so the smallest and
    largest timestamp of each bucket tell every segment start. The bucket aggregate combines on
    the map side; single samples are not shuffled for it.
    """
    bucket = floor_div("timestamp", max(gap_ms, 1)).alias("bucket")
    pieces = tile(traces.select(*keys, "timestamp"), chunk_ms).groupBy(*keys, "chunk", bucket).agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    ).drop("chunk")
    # A piece also goes to the next chunk when it can still reach over the border.
    pieces = tile(pieces, chunk_ms, before=gap_ms, lo="lo", hi="hi")
    pieces = pieces.withColumn("previous", F.lag("hi").over(by_chunk(keys, "lo"))).where(in_own_chunk(chunk_ms, "lo"))
    starts = pieces.withColumn("start", F.when(_opens("lo", gap_ms), F.col("lo")))
    chunks = starts.groupBy(*keys, "chunk").agg(
        F.max("hi").alias("last_ts"), F.max("start").alias("last_start"), F.count("start").alias("n_starts")
    )
    return carry_from_earlier_chunks(
        chunks, keys, carry_ts=F.max("last_ts"), carry_start=F.max("last_start"), carry_n=F.sum("n_starts")
    )


def _segment_tiles(traces, keys, gap_ms, chunk_ms, after=0):
    """Rows partitioned by ``(keys, chunk)`` with ``seg_id`` (0-based per stream) and ``seg_start``."""
    traces = named_streams(traces, keys)
    rows = attach_carry(
        tile(traces, chunk_ms, after=after), _segment_carry(traces, keys, gap_ms, chunk_ms), [*keys, "chunk"]
    )
    w = by_chunk(keys)
    rows = rows.withColumn("previous", F.coalesce(F.lag("timestamp").over(w), F.col("carry_ts")))
    rows = rows.withColumn("opens", F.when(_opens("timestamp", gap_ms), F.col("timestamp"))).drop("previous")
    seen = F.count("opens").over(running(w)) + F.coalesce(F.col("carry_n"), F.lit(0))
    return rows.withColumns({
        "seg_id": (seen - 1).cast("int"),
        "seg_start": F.coalesce(F.max("opens").over(running(w)), F.col("carry_start")),
    }).drop("opens", "carry_ts", "carry_start", "carry_n")


def gap_segments(traces: DataFrame, gap_ms: int = SEGMENT_GAP_MS, keys: list[str] = STREAM_KEYS,
                 chunk_ms: int | None = None) -> DataFrame:
    """Open a new segment where the time since the previous record exceeds ``gap_ms`` (an equal gap stays)."""
    chunk_ms = chunk_length(chunk_ms, gap_ms)
    return _segment_tiles(traces, keys, gap_ms, chunk_ms).drop("chunk")


def grid_window(duration_ms: int) -> str:
    """Window number on the grid anchored at the segment start.

    Window ``k`` covers ``(start + k*d, start + (k+1)*d]``; the first one also holds the start.
    """
    return f"greatest({floor_sql(f'timestamp - seg_start + {duration_ms - 1}L', duration_ms)} - 1L, 0L)"


def anchored_windows(segments: DataFrame, duration_ms: int = WINDOW_MS, keys: list[str] = STREAM_KEYS,
                     gap_ms: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Add ``win_id`` to rows that carry ``seg_id`` and ``seg_start``.

    Closing a window moves the next end by one duration only, so after a pause longer than a
    duration the count lags behind the grid by one window per record. Such pauses cannot occur
    when the segments were cut at ``gap_ms <= duration_ms``; then the grid is the answer.
    Otherwise row ``i`` of a segment gets ``i + min(grid_j - j for j <= i)``.
    """
    if gap_ms is not None and gap_ms <= duration_ms:
        return segments.withColumn("win_id", F.expr(f"CAST({grid_window(duration_ms)} AS INT)"))
    chunk_ms = chunk_length(chunk_ms, duration_ms)
    segment = [*keys, *SEGMENT]
    w = by_chunk(segment)
    rows = tile(segments, chunk_ms).withColumn("at", F.row_number().over(w) - F.lit(1))
    rows = rows.withColumn("slack", F.min(F.expr(f"{grid_window(duration_ms)} - at")).over(running(w)))
    over = earlier(Window.partitionBy(*segment).orderBy("chunk"))
    carry = (
        rows.groupBy(*segment, "chunk")
        .agg(F.count("*").alias("n"), F.min("slack").alias("least"))
        .withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
        .withColumn("carry_slack", F.min(F.col("least") - F.col("before")).over(over))
        .drop("n", "least")
    )
    joined = attach_carry(rows, carry, [*segment, "chunk"])
    slack = F.least(F.col("carry_slack"), F.col("slack") - F.col("before"))
    return joined.withColumn("win_id", (F.col("at") + F.col("before") + slack).cast("int")).drop(
        "chunk", "at", "slack", "before", "carry_slack"
    )


def windowed_traces(traces: DataFrame, gap_ms: int = SEGMENT_GAP_MS, duration_ms: int = WINDOW_MS,
                    keys: list[str] = STREAM_KEYS, chunk_ms: int | None = None) -> DataFrame:
    """Rows with ``seg_id``, ``win_id`` and the ``chunk`` that owns the window.

    A window belongs to the chunk its nominal start falls in; the halo brings the rest of it
    there. So everything up to the window aggregates runs on one shuffle of the samples.
    """
    chunk_ms = chunk_length(chunk_ms, gap_ms, duration_ms)
    if gap_ms <= duration_ms:
        rows = _segment_tiles(traces, keys, gap_ms, chunk_ms, after=duration_ms)
        rows = rows.withColumn("win_id", F.expr(f"CAST({grid_window(duration_ms)} AS INT)"))
    else:
        rows = anchored_windows(gap_segments(traces, gap_ms, keys, chunk_ms), duration_ms, keys, gap_ms, chunk_ms)
    owner = floor_div(f"seg_start + win_id * {duration_ms}L", chunk_ms)
    if gap_ms <= duration_ms:
        return rows.where(F.col("chunk") == owner)
    return rows.withColumn("chunk", owner)


def segment_summary(segments: DataFrame, keys: list[str] = STREAM_KEYS) -> DataFrame:
    return segments.groupBy(*keys, *SEGMENT).agg(
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_records")
    )


def window_sizes(windowed: DataFrame, keys: list[str] = STREAM_KEYS,
                 min_records: int = MIN_WINDOW_RECORDS) -> DataFrame:
    """Windows with at least ``min_records`` records."""
    return windowed.groupBy(*keys, *WINDOW).agg(
        F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"),
        F.count("*").alias("n_records"),
    ).where(F.col("n_records") >= min_records)
