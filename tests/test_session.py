from types import SimpleNamespace

import pytest

from strideflow.session import scratch_path, shared_dir, stage


def fake(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_the_named_folder_is_used():
    spark = fake(**{"spark.checkpoint.dir": "hdfs:///shared/cp/", "spark.master": "yarn"})
    assert shared_dir(spark) == "hdfs:///shared/cp"
    assert scratch_path(spark, "a").startswith("hdfs:///shared/cp/strideflow/a-")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake(**{"spark.master": "yarn"}))


def test_a_local_session_without_it_keeps_one_folder():
    one = fake(**{"spark.master": "local[2]", "spark.app.id": "one"})
    assert shared_dir(one) == shared_dir(one) != shared_dir(fake(**{"spark.master": "local[2]", "spark.app.id": "two"}))


def test_a_staged_table_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "CAST(NULL AS DOUBLE) AS v")
    back = stage(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 5
