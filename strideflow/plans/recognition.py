"""Scoring the latest traces of every user with the four model variants."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.operators.clustering import recognise_regions
from strideflow.operators.features import features_basic, features_location_aware
from strideflow.operators.segments import windowed_traces
from strideflow.plans.models import RANDOM_FOREST, VARIANTS, model_path, predict_activity, predict_compiled
from strideflow.schemas import (
    LATEST_TRACES, MIN_WINDOW_RECORDS, POLL_PERIOD_MS, POI_RADIUS_M, RESULT, SEGMENT_GAP_MS, STREAM_KEYS, WINDOW_MS,
)
from strideflow.session import stage
from strideflow.sources.traces import latest_traces

REGION_KEYS = [*STREAM_KEYS, "cluster_id"]


def recognition_features(traces: DataFrame, pois: DataFrame | None, location_aware: bool,
                         gap_ms: int = SEGMENT_GAP_MS, duration_ms: int = WINDOW_MS,
                         min_records: int = MIN_WINDOW_RECORDS, radius_m: float = POI_RADIUS_M,
                         chunk_ms: int | None = None) -> DataFrame:
    """Feature rows of all streams: regions, segments, windows, features.

    The regions are written once: segments read them twice, and clustering them is most of the work. Traces that
    have their ``cluster_id`` already are not clustered again.
    """
    if location_aware and "cluster_id" in traces.columns:
        regions = traces
    else:
        regions = recognise_regions(traces, location_aware, chunk_ms=chunk_ms)
        if location_aware:
            regions = stage(regions, "regions")
    windowed = windowed_traces(regions, gap_ms, duration_ms, REGION_KEYS, chunk_ms)
    if location_aware:
        return features_location_aware(windowed, pois, REGION_KEYS, min_records, radius_m)
    return features_basic(windowed, REGION_KEYS, min_records)


def recognise(traces: DataFrame, pois: DataFrame | None, model: PipelineModel, location_aware: bool,
              dominanthand: bool, user: str | None = None, latest: int = LATEST_TRACES) -> DataFrame:
    """Recognised activity of every window in the latest traces of one variant (and one user)."""
    rows = traces.where(F.col("dominanthand") == dominanthand)
    if user is not None:
        rows = rows.where(F.col("user") == user)
    rows = latest_traces(rows, latest)
    if location_aware:
        rows = stage(rows, "latest")
    return predict_activity(model, recognition_features(rows, pois, location_aware))


def recognition_results(predictions: DataFrame, model_name: str, location_aware: bool, run_start: int) -> DataFrame:
    """Result rows; ``timestamp`` is one poll period before the run, as every window of a run has it."""
    return predictions.select(
        "user", F.lit(run_start - POLL_PERIOD_MS).cast("bigint").alias("timestamp"),
        F.col("predicted").alias("activity"), F.lit(model_name).alias("model"), "dominanthand",
        F.lit(location_aware).alias("locationaware"), "window_start", "window_end",
    )


def recognise_latest(rows: DataFrame, pois: DataFrame, models: dict[tuple[bool, bool], PipelineModel] | DataFrame,
                     run_start: int, algorithm: str = RANDOM_FOREST, base: str = "models") -> DataFrame:
    """Results of the trained variants for traces already cut to the latest of each stream.

    Each kind of feature is computed once for both hands. ``models`` are the fitted ones, each of which scores the rows of
    its variant, or ``compiled_trees``, which score the rows of all variants in one pass.
    """
    features = {aware: stage(recognition_features(rows, pois, aware), "features") for aware in (False, True)}
    if isinstance(models, DataFrame):
        return _with_compiled(features, models, run_start, algorithm, base)
    out = None
    for (aware, hand), model in models.items():
        scored = predict_activity(model, features[aware].where(F.col("dominanthand") == hand))
        part = recognition_results(scored, model_path(base, algorithm, aware, hand), aware, run_start)
        out = part if out is None else out.unionByName(part)
    return out.select(*RESULT.fieldNames(), "window_start", "window_end")


def _with_compiled(features: dict[bool, DataFrame], trees: DataFrame, run_start: int, algorithm: str, base: str) -> DataFrame:
    both = features[False].withColumn("locationaware", F.lit(False)).unionByName(
        features[True].withColumn("locationaware", F.lit(True)), allowMissingColumns=True
    )
    path = F.lit(None)
    for aware, hand in VARIANTS:
        path = F.when((F.col("locationaware") == aware) & (F.col("dominanthand") == hand), F.lit(model_path(base, algorithm, aware, hand))).otherwise(path)
    return predict_compiled(both, trees).select(
        "user", F.lit(run_start - POLL_PERIOD_MS).cast("bigint").alias("timestamp"), F.col("predicted").alias("activity"),
        path.alias("model"), "dominanthand", "locationaware", "window_start", "window_end",
    )


def recognise_all(traces: DataFrame, pois: DataFrame, models: dict[tuple[bool, bool], PipelineModel] | DataFrame,
                  run_start: int, latest: int = LATEST_TRACES, algorithm: str = RANDOM_FOREST,
                  base: str = "models") -> DataFrame:
    """Recognise the latest traces of all users with the trained variants."""
    rows = stage(latest_traces(traces, latest), "latest")
    return recognise_latest(rows, pois, models, run_start, algorithm, base)
