"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import pickle
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import strideflow.llm

# Functions that run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(strideflow.llm)

# Texts handed to one vectorised step hold about so many bytes together; a longer text is a step of its own.
STEP_BYTES = 4_000_000
# A table of at most so many narrow rows or array entries is broadcast: tens of megabytes. Beyond it Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """``crc32(doc_id as text) mod n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % F.lit(n)


def held_out(n: int) -> Column:
    """Rows whose fold is 2 are never learnt from; a row without an id is learnt from."""
    return F.coalesce(fold(n) == 2, F.lit(False))


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into ranges of about ``most`` bytes, at least one row each."""
    sizes = pc.binary_length(texts).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def release() -> None:
    """Hand unused memory back: a Python worker lives on after its task, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of a class of this package: with its code, as executors may lack the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast: Broadcast) -> Any:
    """The object that ``share`` handed out."""
    return pickle.loads(broadcast.value)


class Covered:
    """Whether a span overlaps one of a list of spans ``(start, end)``; sorted and merged once, looked up by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def matching(texts: pa.Array, pattern: str) -> list[int]:
    """Indices of the texts in which the pattern is found; a linear scan outside Python."""
    return pc.indices_nonzero(pc.match_substring_regex(texts, pattern)).to_pylist()


def bounded(staged: DataFrame, entries: Column | None = None) -> DataFrame:
    """A staged table as a broadcast side if it is small: its counted rows, or the ``entries`` of their arrays, together."""
    n = staged.agg(F.count("*").alias("n") if entries is None else F.sum(1 + entries).alias("n")).first()["n"] or 0
    return F.broadcast(staged) if n <= BROADCAST_ROWS else staged
