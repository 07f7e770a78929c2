"""From labelled traces to trained and evaluated models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions.dimensions import activity_id
from strideflow.operators.clustering import label_regions, recognise_regions
from strideflow.operators.features import features_basic, features_location_aware
from strideflow.operators.segments import WINDOW, windowed_traces
from strideflow.plans.models import (
    DECISION_TREE, RANDOM_FOREST, TRAINERS, VARIANTS, accuracy, feature_columns, model_path, save_model,
)
from strideflow.schemas import (
    ACTIVITIES, MIN_WINDOW_RECORDS, OTHER_ID, POI_RADIUS_M, SEGMENT_GAP_MS, SPLIT_WEIGHTS, TRAINING_KEYS, WINDOW_MS,
)
from strideflow.session import stage
from strideflow.sources.traces import training_traces

REGION_KEYS = [*TRAINING_KEYS, "cluster_id"]
VECTOR_ID = [*REGION_KEYS, *WINDOW]
# Tells the classifiers that there are 8 classes, whichever of them the data holds.
LABEL_METADATA = {"ml_attr": {"type": "nominal", "vals": [a for a, i in ACTIVITIES.items() if i != OTHER_ID]}}


def training_set(traces: DataFrame, pois: DataFrame | None, location_aware: bool = True,
                 dominanthand: bool | None = None, regions: str = "label", gap_ms: int = SEGMENT_GAP_MS,
                 duration_ms: int = WINDOW_MS, min_records: int = MIN_WINDOW_RECORDS,
                 radius_m: float = POI_RADIUS_M, chunk_ms: int | None = None,
                 activity: Column | None = None) -> DataFrame:
    """One labelled feature row per window of all users and activities.

    ``regions`` says what tells stays from trips: the "label", or density clustering ("cluster").
    ``activity`` labels windows by an expression over their features instead of by the records' label.
    """
    rows = training_traces(traces, dominanthand=dominanthand)
    if regions == "cluster":
        rows = recognise_regions(rows, location_aware, TRAINING_KEYS, chunk_ms)
    elif regions == "label":
        rows = label_regions(rows, location_aware)
    else:
        raise ValueError(f"regions must be 'label' or 'cluster', not {regions!r}")
    windowed = windowed_traces(rows, gap_ms, duration_ms, REGION_KEYS, chunk_ms)
    if location_aware:
        features = features_location_aware(windowed, pois, REGION_KEYS, min_records, radius_m)
    else:
        features = features_basic(windowed, REGION_KEYS, min_records)
    label = activity_id(F.col("activity") if activity is None else activity).cast("double").alias("label", metadata=LABEL_METADATA)
    return features.select(
        *VECTOR_ID, "window_start", "window_end", "n_records", label, *feature_columns(location_aware)
    )


def split_bucket(ids: Sequence[str], seed: int) -> Column:
    """A number from 0 to 999 that depends on the key of a row alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 1000


def split(vectors: DataFrame, weights: tuple[float, float] = SPLIT_WEIGHTS, seed: int = 42,
          ids: Sequence[str] = tuple(VECTOR_ID)) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a row recomputed after a failure always falls on the same side."""
    bound = round(1000 * weights[0] / sum(weights))
    bucket = split_bucket(ids, seed)
    return vectors.where(bucket < bound), vectors.where(bucket >= bound)


def train_models(traces: DataFrame, pois: DataFrame | None, location_aware: bool, dominanthand: bool,
                 base: str | None = None, algorithms: Sequence[str] = (DECISION_TREE, RANDOM_FOREST),
                 seed: int = 42, **windows) -> tuple[dict, DataFrame]:
    """Train on one split of one variant; returns the models and a table of their accuracies.

    With ``base`` the models are also saved under their variant path.
    """
    vectors = stage(training_set(traces, pois, location_aware, dominanthand, **windows), "vectors")
    return fit_variant(vectors, location_aware, dominanthand, base, algorithms, seed)


def fit_variant(vectors: DataFrame, location_aware: bool, dominanthand: bool, base: str | None = None,
                algorithms: Sequence[str] = (DECISION_TREE, RANDOM_FOREST), seed: int = 42) -> tuple[dict, DataFrame]:
    """Fit and measure the classifiers of one hand on written feature rows.

    A variant without training rows (nobody wears that hand, say) has no model; its row in the table has no accuracy.
    """
    vectors = vectors.where(F.col("dominanthand") == dominanthand)
    train, test = split(vectors, seed=seed)
    n_vectors, untrained = vectors.count(), train.isEmpty()
    models, rows = {}, None
    for algorithm in algorithms:
        if untrained:
            measured = test.agg(F.count("*").alias("n_test"), F.lit(None).cast("double").alias("accuracy"))
        else:
            model = TRAINERS[algorithm](train, location_aware)
            if base:
                save_model(model, model_path(base, algorithm, location_aware, dominanthand))
            models[algorithm] = model
            measured = accuracy(model.transform(test))
        measured = measured.select(
            F.lit(location_aware).alias("locationaware"), F.lit(dominanthand).alias("dominanthand"),
            F.lit(algorithm).alias("algorithm"), "n_test", "accuracy", F.lit(n_vectors).cast("long").alias("n_vectors"),
        )
        rows = measured if rows is None else rows.union(measured)
    return models, rows


def run_training(traces: DataFrame, pois: DataFrame, base: str,
                 algorithms: Sequence[str] = (DECISION_TREE, RANDOM_FOREST), seed: int = 42, **windows) -> DataFrame:
    """Train, save and evaluate all four variants. The features of both hands are computed together."""
    vectors = {
        aware: stage(training_set(traces, pois, aware, None, **windows), "vectors") for aware in (False, True)
    }
    tables = [fit_variant(vectors[aware], aware, hand, base, algorithms, seed)[1] for aware, hand in VARIANTS]
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out
