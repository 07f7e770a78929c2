"""Table schemas and the fixed values that are part of the results."""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults of clustering, segmentation and windows.
MAX_DISTANCE_M = 40.0
MAX_TIME_DIFFERENCE_MS = 800
MIN_POINTS = 35
NOISE_CLUSTER = -1
SEGMENT_GAP_MS = 800
WINDOW_MS = 5000
MIN_WINDOW_RECORDS = 10
PEAK_RATIO = 0.9
LATEST_TRACES = 2500
POLL_PERIOD_MS = 10000
POI_RADIUS_M = 20.0
EARTH_RADIUS_KM = 6371.0
SPLIT_WEIGHTS = (0.7, 0.3)

# Activity labels and their ids.
ACTIVITIES = {
    "Cooking": 0,
    "Dinning": 1,
    "Shopping": 2,
    "Entertainment": 3,
    "Studying": 4,
    "Transportation": 5,
    "Walking": 6,
    "Biking": 7,
    "Other": 8,
}
OTHER = "Other"
OTHER_ID = 8
TRIP_ACTIVITIES = ("Transportation", "Walking", "Biking")

# Place types that stand for an activity; every other type is "Other".
PLACE_TYPES = {
    "Entertainment": [
        "movie_theater", "amusement_park", "art_gallery", "casino", "museum", "stadium", "aquarium",
    ],
    "Dinning": ["restaurant", "cafe", "bar"],
    "Studying": ["university", "school", "library"],
    "Shopping": [
        "shopping_mall", "shoe_store", "liquor_store", "store", "pharmacy", "pet_store",
        "jewelry_store", "bakery",
    ],
}

# One trace stream is one wrist of one user.
STREAM_KEYS = ["user", "dominanthand"]
TRAINING_KEYS = ["user", "dominanthand", "activity"]

TRACE = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("dominanthand", T.BooleanType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])
TRACE_COLUMNS = TRACE.fieldNames()

TRAINING_TRACE = T.StructType(TRACE.fields + [T.StructField("activity", T.StringType())])

# Positional layout of the trace text files; place is only present in point-of-interest files.
TRACE_CSV = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("activity", T.StringType()),
    T.StructField("dominanthand", T.BooleanType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])
TRACE_CSV_WITH_PLACE = T.StructType(TRACE_CSV.fields + [T.StructField("place", T.StringType())])
XYZ_CSV = "x double, y double, z double"
TICKS_CSV = "timestamp long, value double"

RESULT = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("activity", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("dominanthand", T.BooleanType()),
    T.StructField("locationaware", T.BooleanType()),
])

POI = T.StructType([
    T.StructField("poi_id", T.LongType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("types", T.ArrayType(T.StringType())),
])
