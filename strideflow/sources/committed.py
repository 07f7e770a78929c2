"""Tables written in runs, each of which is there as a whole or not at all.

A run is written to a folder of its own attempt and becomes visible by one small file, its entry in the manifest, which is put
in place by a rename. A run that fails leaves no entry; a run that is repeated writes a new attempt and replaces its
entry, so readers see the old rows or the new ones, never both and never half of them. ``vacuum`` removes what no entry names.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.=-]*")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, fs = _fs(spark, path)
    return fs.exists(target)


def _commit(spark: SparkSession, path: str, run: str, entry: dict) -> None:
    """Put the entry of a run in place; one rename, which replaces an older entry."""
    jvm, hidden, fs = _fs(spark, f"{path}/manifest/_{run}-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(hidden, jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{run}.json"), options)


def write_run(df: DataFrame, path: str, run: str, fmt: str = "parquet", **parts: DataFrame) -> str:
    """Write ``df`` as the rows of ``run``; returns the folder. ``parts`` are further tables of the run (callables get its folder)."""
    if not NAME.fullmatch(run):
        raise ValueError(f"not a name for a run: {run!r}")
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    folder = f"runs/{run}/{attempt}"
    df.write.format(fmt).save(f"{path}/{folder}/data")
    for name, part in parts.items():
        (part(f"{path}/{folder}/data") if callable(part) else part).write.parquet(f"{path}/{folder}/{name}")
    _commit(spark, path, run, {"run": run, "folder": folder})
    return f"{path}/{folder}"


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of every run that is there, by its name; a row per run comes to the driver."""
    if not exists(spark, f"{path}/manifest"):
        return {}
    rows = spark.read.schema("run string, folder string").json(f"{path}/manifest").where("run IS NOT NULL").collect()
    return {r["run"]: f"{path}/{r['folder']}" for r in sorted(rows)}


def read_runs(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", part: str = "data",
              runs: list[str] | None = None) -> DataFrame:
    """The rows of all committed runs (or some), with the name of the run in the column ``run``."""
    folders = [folder for name, folder in committed(spark, path).items() if runs is None or name in runs]
    if not folders:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/runs/([^/]+)/[0-9a-f]{{32}}/{part}/", 1)
    return spark.read.format(fmt).schema(schema).load([f"{f}/{part}" for f in folders]).select("*", name.alias("run"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete attempts that no entry names; returns how many. Only for tables that nobody is writing to."""
    kept, removed = set(committed(spark, path).values()), 0
    _, top, fs = _fs(spark, f"{path}/runs")
    if not fs.exists(top):
        return 0
    for run in fs.listStatus(top):
        for attempt in fs.listStatus(run.getPath()):
            if f"{path}/runs/{run.getPath().getName()}/{attempt.getPath().getName()}" not in kept:
                removed += bool(fs.delete(attempt.getPath(), True))
    return removed
