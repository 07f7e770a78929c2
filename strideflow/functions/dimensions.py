"""The activity and place-type dimensions, and label/id conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.schemas import ACTIVITIES, OTHER_ID, PLACE_TYPES


def activity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, label) for label, i in ACTIVITIES.items()], "activity_id int, activity string"
    )


def place_type_dim(spark: SparkSession) -> DataFrame:
    rows = [(name.upper(), ACTIVITIES[label]) for label, names in PLACE_TYPES.items() for name in names]
    return spark.createDataFrame(rows, "place_type string, activity_id int")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def activity_id(label: Column) -> Column:
    """Id of an activity label; an unknown label is an error."""
    found = F.try_element_at(_literal_map(ACTIVITIES), label)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown activity label: "), label)).cast("int"))


def activity_label(id_: Column) -> Column:
    """Label of an activity id; an unknown id is an error."""
    labels = {i: label for label, i in ACTIVITIES.items()}
    found = F.try_element_at(_literal_map(labels), id_.cast("int"))
    unknown = F.raise_error(F.concat(F.lit("unknown activity id: "), id_.cast("string")))
    return F.coalesce(found, unknown.cast("string"))


def poi_type_to_activity(place_type: Column) -> Column:
    """Activity id a place type stands for; unknown, unmapped or missing types are "Other"."""
    types = {name.upper(): ACTIVITIES[label] for label, names in PLACE_TYPES.items() for name in names}
    table = _literal_map(types)
    # All characters up to the blank are white space here, not only the blank.
    bare = F.regexp_replace(place_type, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.coalesce(F.try_element_at(table, F.upper(bare)), F.lit(OTHER_ID))
