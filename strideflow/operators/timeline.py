"""Cutting long trace streams into time chunks.

One stream (a user's wrist) may hold a large share of all rows, so no operator partitions by
the stream alone. Rows are partitioned by ``(keys, chunk)`` where a chunk is a fixed span of
time: with one row per millisecond and stream at most, a chunk of ``chunk_ms`` holds at most
``chunk_ms`` rows. Two things let results cross chunk borders exactly:

* a halo: rows near a border are also handed to the neighbouring chunk (``tile``);
* a carry: one small row per chunk that says what the earlier chunks left open. Only these
  rows are ever ordered over a whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_MS = 600_000


def chunk_length(chunk_ms: int | None, *spans_ms: int) -> int:
    """Default chunk length, grown so that it is long against the given time spans."""
    needed = max(spans_ms, default=1)
    if chunk_ms is None:
        return max(DEFAULT_CHUNK_MS, 8 * needed)
    if chunk_ms < needed:
        raise ValueError(f"chunk_ms={chunk_ms} must not be shorter than {needed}")
    return chunk_ms


def floor_sql(value: str, width: int) -> str:
    """SQL for an integer division that rounds down, also for negative values."""
    return f"(({value}) - pmod({value}, {width}L)) div {width}L"


def floor_div(value: str, width: int) -> Column:
    return F.expr(floor_sql(value, width))


def tile(df: DataFrame, chunk_ms: int, before: int = 0, after: int = 0, lo: str = "timestamp",
         hi: str = "timestamp") -> DataFrame:
    """Add ``chunk``; a row within ``before``/``after`` ms of a chunk also goes to that chunk.

    Chunk ``c`` gets the rows with ``c*chunk_ms - before <= hi`` and ``lo < (c+1)*chunk_ms + after``.
    """
    if before == 0 and after == 0 and lo == hi:
        return df.withColumn("chunk", floor_div(lo, chunk_ms))
    first, last = floor_sql(f"{lo} - {after}L", chunk_ms), floor_sql(f"{hi} + {before}L", chunk_ms)
    return df.withColumn("chunk", F.expr(f"explode(sequence({first}, {last}))"))


def named_streams(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` whose rows fail with a clear error where a key or the time is missing.

    Operators join on these columns, and a join would lose such rows without a word;
    ``admit_traces`` puts them aside beforehand.
    """
    def given(name: str) -> Column:
        error = F.raise_error(F.lit(f"a record has no {', '.join(keys)} or timestamp: {name} is missing"))
        # Part of the column itself, so that no filter for missing keys can come before it.
        return F.coalesce(F.col(name), error.cast(df.schema[name].dataType))

    return df.withColumns({name: given(name) for name in [*keys, "timestamp"]})


def in_own_chunk(chunk_ms: int, ts: str = "timestamp") -> Column:
    return F.expr(f"chunk = {floor_sql(ts, chunk_ms)}")


def by_chunk(keys: list[str], order: str = "timestamp"):
    return Window.partitionBy(*keys, "chunk").orderBy(order)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def count_within(flag: Column, window, reach_ms: int) -> Column:
    """How many flagged rows lie at most ``reach_ms`` before or after the current row.

    Difference of two growing frames, so each row costs constant work however dense the data.
    """
    hits = F.when(flag, F.lit(1))
    upto = F.count(hits).over(window.rangeBetween(Window.unboundedPreceding, reach_ms))
    past = F.count(hits).over(window.rangeBetween(Window.unboundedPreceding, -reach_ms - 1))
    return upto - past


def carry_from_earlier_chunks(chunks: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """Evaluate aggregates over all earlier chunks of the same stream, one row per chunk."""
    w = earlier(by_stream(keys))
    return chunks.select(*keys, "chunk", *[c.over(w).alias(name) for name, c in columns.items()])


def by_stream(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("chunk")


def attach_carry(rows: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Join the one-row-per-chunk carry; its hash table is tiny against the rows it meets."""
    return rows.join(carry.hint("shuffle_hash"), on, "inner")


def ordinal(df: DataFrame, keys: list[str], ts: str, chunk_ms: int, name: str) -> DataFrame:
    """0-based rank by ``ts`` (unique per stream) without ordering a whole stream in one task."""
    rows = df.withColumn("chunk", floor_div(ts, chunk_ms))
    carry = carry_from_earlier_chunks(
        rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n")), keys, ranked=F.sum("n")
    )
    place = F.row_number().over(by_chunk(keys, ts)) - F.lit(1)
    return (
        attach_carry(rows, carry, [*keys, "chunk"])
        .withColumn(name, (place + F.coalesce(F.col("ranked"), F.lit(0))).cast("int"))
        .drop("chunk", "ranked")
    )
