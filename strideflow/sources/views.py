"""Trace and place tables derived from generic event and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACES_SQL = """
WITH b AS (
  SELECT event_id, user_id, CAST(value AS DOUBLE) AS value,
         CAST(floor(event_id / 250) AS BIGINT)  AS blk,
         CAST(floor(event_id / 1000) AS BIGINT) AS usr,
         event_id % 250 AS k
  FROM {events})
SELECT concat('u', CAST(usr AS VARCHAR(20))) AS user,
       1500000000000 + blk * 40000
         + k * (CASE blk % 3 WHEN 0 THEN 20 WHEN 1 THEN 40 ELSE 100 END)
         + (CASE WHEN blk % 4 = 1 AND k >= 125 THEN 900
                 WHEN blk % 4 = 2 AND k >= 245 THEN 2000 ELSE 0 END) AS timestamp,
       (usr % 2 = 0) AS dominanthand,
       CASE blk % 8 WHEN 0 THEN 'Cooking' WHEN 1 THEN 'Dinning' WHEN 2 THEN 'Shopping'
                    WHEN 3 THEN 'Entertainment' WHEN 4 THEN 'Studying'
                    WHEN 5 THEN 'Transportation' WHEN 6 THEN 'Walking' ELSE 'Biking' END AS activity,
       value / 10e0 - 5e0                               AS x,
       CAST(user_id % 17 AS DOUBLE) / 2e0 - 4e0         AS y,
       931e-2 + CAST(event_id % 13 AS DOUBLE) / 13e0    AS z,
       47e0 + CAST(blk AS DOUBLE) * 1e-2
         + (CASE WHEN blk % 8 >= 5 THEN CAST(k AS DOUBLE) * 2e-5
                 WHEN k >= 200 THEN 1e-3 ELSE 0e0 END)  AS latitude,
       79e-1 + CAST(k % 5 AS DOUBLE) * 1e-6             AS longitude
FROM b
"""

POI_SQL = """
SELECT p_partkey AS poi_id,
       47e0 + CAST(p_partkey % 40 AS DOUBLE) * 1e-2
            + CAST(CAST(floor(p_partkey / 40) AS BIGINT) % 5 AS DOUBLE) * 1e-4 AS latitude,
       79e-1 AS longitude,
       {split}(CASE p_partkey % 7 WHEN 0 THEN 'restaurant,bar' WHEN 1 THEN 'school' WHEN 2 THEN 'store,bakery'
                          WHEN 3 THEN 'museum' WHEN 4 THEN 'atm,point_of_interest'
                          WHEN 5 THEN concat(chr(9), ' Library', chr(10)) ELSE 'cafe,store,unknown_type' END, ',') AS types
FROM {part}
"""


FAULTY_SQL = """
SELECT CASE WHEN timestamp % 3700 = 0 THEN NULL ELSE user END AS user,
       CASE WHEN timestamp % 4100 = 0 THEN NULL ELSE dominanthand END AS dominanthand,
       timestamp, activity, x, y, z,
       CASE WHEN timestamp % 900 = 0 THEN NULL ELSE latitude END AS latitude,
       CASE WHEN timestamp % 900 = 0 THEN NULL ELSE longitude END AS longitude
FROM (SELECT * FROM ({traces}) a UNION ALL SELECT * FROM ({traces}) b WHERE timestamp % 1100 = 0) s
"""


def traces_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled traces over the whole ``events`` table."""
    events = spark.read.schema("event_id long, user_id long, value double").parquet(f"{sf_dir}/events.parquet")
    return spark.sql(TRACES_SQL.format(events="{events}"), events=events)


def faulty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces with records sent twice, missing fixes, and missing users and hands."""
    return spark.sql(FAULTY_SQL.format(traces="SELECT * FROM {t}"), t=traces_view(spark, sf_dir))


def poi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over the whole ``part`` table."""
    part = spark.read.schema("p_partkey long").parquet(f"{sf_dir}/part.parquet")
    return spark.sql(POI_SQL.format(split="split", part="{part}"), part=part)
