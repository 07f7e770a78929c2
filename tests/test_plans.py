"""The shape of the physical plans: what is shuffled, and that nothing is compared all with all."""

import re

from strideflow.operators import features as Fe
from strideflow.operators import poi as P
from strideflow.operators.clustering import label_regions
from strideflow.operators.neighbours import st_neighbours
from strideflow.operators.segments import windowed_traces
from strideflow.plans.training import REGION_KEYS
from strideflow.sources.traces import latest_traces, traces_between, write_traces


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)


def test_samples_are_shuffled_once(traces):
    text = plan(Fe.features_basic(windowed_traces(traces)))
    with_samples = [e for e in text.splitlines() if "Exchange" in e]
    assert len(with_samples) == 5
    # Nothing is shuffled after samples and carry have met.
    top = text[: text.index("ShuffledHashJoin")]
    assert "Exchange" not in top


def test_no_sample_is_shuffled_by_stream_alone(traces, pois):
    windows = windowed_traces(label_regions(traces), keys=REGION_KEYS)
    text = plan(Fe.features_location_aware(windows, pois, REGION_KEYS))
    by_stream = [e for e in exchanges(text) if "chunk" not in e and "seg_id" not in e and "cell" not in e and "user" in e]
    # The one shuffle by stream carries a row per chunk.
    assert len(by_stream) == 1


def test_joins_are_never_all_pairs(traces, pois):
    for df in (st_neighbours(traces), P.poi_within(traces, pois), P.poi_counts(traces, pois), P.poi_sweep(traces.select(*P.SPOT), pois)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_files(spark, traces, tmp_path):
    path = str(tmp_path / "t")
    write_traces(traces.select("user", "dominanthand", "timestamp", "x", "y", "z", "latitude", "longitude"), path)
    stored = spark.read.parquet(path)
    text = formatted(traces_between(stored, "u0", True, 5, 10))
    assert "GreaterThan(timestamp,5)" in text and "EqualTo(user,u0)" in text
    text = formatted(Fe.accel_features(windowed_traces(stored)).select("mean_x"))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert "latitude" not in schema and "z:" not in schema


def test_latest_filters_samples_before_they_are_shuffled(traces):
    text = plan(latest_traces(traces, 10))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert len(exchanges(text)) == 1


def test_recognition_features_shuffle_samples_for_clusters_and_for_windows_only(traces, pois, monkeypatch):
    from strideflow.operators import clustering
    from strideflow.plans import recognition

    staged = []
    for module in (clustering, recognition):
        stage = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name, stage=stage: (staged.append((name, plan(df))), stage(df, name))[-1])
    text = plan(recognition.recognition_features(traces, pois, True))
    assert [n for n, _ in staged] == ["chunk-clusters", "local-clusters", "regions"]
    # once to the chunks; once, from the table of that step, to meet the cluster numbers of their chunk
    assert len(exchanges(staged[0][1])) == 1
    assert len(re.findall(r"FileScan parquet .*chunk-clusters", staged[2][1])) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_shares_are_weighted_without_a_task_for_a_whole_scope(traces, pois):
    text = plan(P.poi_tfidf(P.poi_map(traces, pois), ["user", "dominanthand"]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # Rows meet the weights of their scope by a salt too.
    assert any("salt" in e for e in exchanges(text)) or "BroadcastHashJoin" in text
