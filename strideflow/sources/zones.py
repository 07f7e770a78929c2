"""Trace tables with a zone index: which streams and times each file holds, so that a selection opens only the files it needs.

Files are written sorted by stream and time, so a file holds few streams, or a stretch of one. The index of a run is
a small table beside its data and is committed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.schemas import LATEST_TRACES, STREAM_KEYS, TRACE
from strideflow.sources.committed import committed, write_run
from strideflow.sources.traces import latest_traces, traces_between

ZONE = T.StructType([
    *[TRACE[k] for k in STREAM_KEYS], T.StructField("file", T.StringType()), T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()), T.StructField("n", T.LongType()),
])


def write_indexed(traces: DataFrame, path: str, run: str, files: int | None = None) -> str:
    """Write ``traces`` as a run of an indexed table, in ``files`` files (by default Spark's shuffle partitions)."""
    spark, order = traces.sparkSession, [*STREAM_KEYS, "timestamp"]
    # Salted beyond the stream by time itself: a range of one long stream is as good a file as one of many short ones.
    spread = traces.repartitionByRange(files, *order) if files else traces.repartitionByRange(*order)

    def zones(data: str) -> DataFrame:
        written = spark.read.schema(traces.schema).parquet(data).select(*order, F.col("_metadata.file_path").alias("file"))
        return written.groupBy(*STREAM_KEYS, "file").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"))

    return write_run(spread.sortWithinPartitions(*order), path, run, zones=zones)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{f}/zones" for f in committed(spark, path).values()]
    return spark.read.schema(ZONE).parquet(*folders) if folders else spark.createDataFrame([], ZONE)


def _opened(spark: SparkSession, zones: DataFrame, schema: T.StructType) -> DataFrame:
    """The files of some zones as a table; their names come to the driver, where Spark lists the files of a scan anyway."""
    files = sorted(r["file"] for r in zones.select("file").distinct().collect())
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def indexed_between(spark: SparkSession, path: str, user: str, dominanthand: bool, start: int, end: int,
                    schema: T.StructType = TRACE) -> DataFrame:
    """``traces_between`` on the files whose zone holds such a record."""
    stream = (F.col("user") == user) & (F.col("dominanthand") == dominanthand)
    zones = read_zones(spark, path).where(stream & (F.col("hi") > start) & (F.col("lo") < end))
    return traces_between(_opened(spark, zones, schema), user, dominanthand, start, end)


def latest_zones(zones: DataFrame, n: int) -> DataFrame:
    """The zones that can hold one of the ``n`` newest records of their stream.

    Where files that begin at ``t`` or later hold ``n`` records, the newest ``n`` are at ``t`` or later: a zone that ends before is
    not needed.
    """
    newer = Window.partitionBy(*STREAM_KEYS).orderBy(F.desc("lo")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = zones.withColumn("held", F.sum("n").over(newer))
    bound = counted.where(F.col("held") >= n).groupBy(*STREAM_KEYS).agg(F.max("lo").alias("since"))
    return zones.join(bound, STREAM_KEYS, "left").where("since IS NULL OR hi >= since").drop("since")


def indexed_latest(spark: SparkSession, path: str, n: int = LATEST_TRACES, schema: T.StructType = TRACE) -> DataFrame:
    """``latest_traces`` on the files that can hold one of them."""
    return latest_traces(_opened(spark, latest_zones(read_zones(spark, path), n), schema), n)
