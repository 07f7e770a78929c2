"""Trace tables and files in, results out, and the row selections jobs start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.operators.timeline import chunk_length, named_streams, tile
from strideflow.schemas import (
    LATEST_TRACES, OTHER, POI, RESULT, STREAM_KEYS, TICKS_CSV, TRACE, TRACE_COLUMNS, TRACE_CSV,
    TRACE_CSV_WITH_PLACE, TRAINING_TRACE, XYZ_CSV,
)
from strideflow.session import stage
from strideflow.sources.committed import read_runs, write_run


def read_traces(spark: SparkSession, path: str, labelled: bool = False, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(TRAINING_TRACE if labelled else TRACE).load(path)


def write_traces(traces: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    traces.write.format(fmt).mode(mode).save(path)


def read_trace_csv(spark: SparkSession, path: str, with_place: bool = False) -> DataFrame:
    """Header-less positional text files; a malformed line is an error."""
    schema = TRACE_CSV_WITH_PLACE if with_place else TRACE_CSV
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def read_xyz_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(XYZ_CSV).option("mode", "FAILFAST").csv(path)


def read_ticks_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(timestamp, value)`` files; the value is cut to a whole number."""
    rows = spark.read.schema(TICKS_CSV).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("value", F.col("value").cast("bigint"))


def read_pois(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(POI).load(path)


def conform_traces(rows: DataFrame, labelled: bool = False, deduplicate: bool = False) -> DataFrame:
    """Typed trace columns from any table that has them.

    A value that does not convert is an error, and so is a missing user, hand, time or (where
    labelled) activity; a missing fix or sample is not. ``malformed_traces`` lists just the rows
    refused here, ``admit_traces`` parts the two.

    ``deduplicate`` keeps one record per stream and timestamp. Which one depends on the values
    alone, so a repeated task gives the same result, and copies combine before the shuffle.
    """
    fields = (TRAINING_TRACE if labelled else TRACE).fields
    kept = rows.where(F.when(_faulty(fields), F.raise_error(F.lit("a trace record is malformed")).cast("boolean")).otherwise(True))
    typed = kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    if not deduplicate:
        return typed
    key = [*STREAM_KEYS, "timestamp"]
    rest = [f.name for f in fields if f.name not in key]
    kept = typed.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r"))
    return kept.select(*key, "r.*").select(*[f.name for f in fields])


def malformed_traces(rows: DataFrame, labelled: bool = False) -> DataFrame:
    """The rows ``conform_traces`` refuses."""
    return rows.where(_faulty((TRAINING_TRACE if labelled else TRACE).fields))


def _faulty(fields: list[T.StructField]) -> Column:
    bad = F.lit(False)
    for f in fields:
        given = F.col(f.name).isNotNull()
        bad = bad | (given & F.col(f.name).cast("string").try_cast(f.dataType).isNull())
        if f.name in (*STREAM_KEYS, "timestamp", "activity"):
            bad = bad | ~given
    return bad


def admit_traces(rows: DataFrame, labelled: bool = False, deduplicate: bool = False) -> tuple[DataFrame, DataFrame]:
    """The conformed good rows, and the malformed ones as they came; together all rows."""
    bad = _faulty((TRAINING_TRACE if labelled else TRACE).fields)
    return conform_traces(rows.where(~bad), labelled, deduplicate), rows.where(bad)


def traces_between(traces: DataFrame, user: str, dominanthand: bool, start: int, end: int) -> DataFrame:
    """Records of one stream strictly between two times, newest first."""
    return (
        traces.where((F.col("user") == user) & (F.col("dominanthand") == dominanthand))
        .where((F.col("timestamp") > start) & (F.col("timestamp") < end))
        .select(*TRACE_COLUMNS).orderBy(F.desc("timestamp"))
    )


def latest_traces(traces: DataFrame, n: int = LATEST_TRACES, keys: list[str] = STREAM_KEYS,
                  chunk_ms: int | None = None) -> DataFrame:
    """The ``n`` newest records of every stream.

    Counts per time chunk tell which chunks can hold them, so only those rows are ranked and no
    task ranks a whole stream. The list of chunks is written first: its size is then known, and
    the samples are filtered where they are read if it is small enough to broadcast, or meet it
    in a join by stream and chunk if it is not.
    """
    chunk_ms = chunk_length(chunk_ms)
    rows = tile(named_streams(traces, keys), chunk_ms)
    counts = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("newer") < n)
    near_end = rows.join(stage(wanted.select(*keys, "chunk"), "chunks"), [*keys, "chunk"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("timestamp")))
    return near_end.withColumn("rank", rank).where(F.col("rank") <= n).drop("chunk", "rank")


def distinct_users(traces: DataFrame) -> DataFrame:
    return traces.select("user").distinct()


def training_traces(traces: DataFrame, user: str | None = None, dominanthand: bool | None = None,
                    activity: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Labelled records without "Other", each condition only where it is given; times are exclusive."""
    rows = traces.where(F.col("activity") != OTHER)
    for column, value in (("user", user), ("dominanthand", dominanthand), ("activity", activity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("timestamp") > start)
    if stop is not None:
        rows = rows.where(F.col("timestamp") < stop)
    return rows.select(*TRAINING_TRACE.fieldNames())


def conform_results(results: DataFrame) -> DataFrame:
    fixed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT.fields]
    extra = [F.col(c) for c in results.columns if c not in RESULT.fieldNames()]
    return results.select(*fixed, *extra)


RESULTS = T.StructType(RESULT.fields + [T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType())])


def write_results(results: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """The results of one run. A repeated run replaces its rows; a failed one leaves none."""
    write_run(conform_results(results), path, run, fmt)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", with_run: bool = False) -> DataFrame:
    """The results of all runs that were written to the end."""
    rows = read_runs(spark, path, RESULTS, fmt)
    return rows if with_run else rows.drop("run")
