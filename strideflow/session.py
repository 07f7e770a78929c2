"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


# Set while ``scratch`` is in use: the folder that intermediate tables go to.
SCRATCH = "spark.strideflow.scratch"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "strideflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # State of streams on disk, with only what changed written per micro-batch.
        .config(STATE_STORE, ROCKSDB)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="strideflow-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_dir(spark.conf.get("spark.app.id", ""))


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get(SCRATCH, None) or f"{shared_dir(spark)}/strideflow"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """Intermediate tables staged inside go to one folder, which is deleted at the end.

    Only for work whose results are written inside: what was staged cannot be read afterwards.
    """
    outer, path = spark.conf.get(SCRATCH, None), scratch_path(spark, name)
    spark.conf.set(SCRATCH, path)
    try:
        yield path
    finally:
        if outer is None:
            spark.conf.unset(SCRATCH)
        else:
            spark.conf.set(SCRATCH, outer)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the real size of the
    intermediate result (so a join broadcasts only what was measured to be small).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
