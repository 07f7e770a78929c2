"""The two jobs, each run twice: nothing is doubled."""

import importlib.util
import os

from pyspark.sql import functions as F

from strideflow.sources.traces import read_results

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def job(name):
    spec = importlib.util.spec_from_file_location(name, f"{ROOT}/jobs/{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.main


def test_jobs_can_be_repeated(spark, traces, pois, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    faulty = traces.withColumn("user", F.when(F.col("timestamp") % 3700 != 0, F.col("user")))
    faulty.write.parquet(at("traces"))
    pois.write.parquet(at("pois"))
    n_bad = faulty.where("user IS NULL").count()
    args = ["--traces", at("traces"), "--pois", at("pois"), "--models", at("models")]
    reports = []
    for _ in range(2):
        job("train")([*args, "--report", at("report"), "--quarantine", at("bad")])
        reports.append(sorted(tuple(r) for r in spark.read.parquet(at("report")).collect()))
    assert reports[0] == reports[1] and len(reports[0]) == 8 and n_bad > 0
    assert spark.read.parquet(at("bad")).count() == n_bad
    results = []
    for _ in range(2):
        job("recognise")([*args, "--results", at("results"), "--quarantine", at("bad2"), "--run", "50000"])
        results.append(read_results(spark, at("results")).count())
    assert results[0] == results[1] > 0
    assert spark.read.parquet(at("bad2")).count() == n_bad
