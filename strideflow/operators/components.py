"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.session import stage


def _signature(edges: DataFrame):
    h = F.xxhash64(*edges.columns).cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.union(edges.select(*keys, F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(*keys, "hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    above = both.where("lo > hi")
    return above.join(least, [*keys, "hi"]).select(*keys, F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    least = edges.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
    others = edges.join(least, [*keys, "hi"]).where("lo <> m").select(
        *keys, F.col("lo").alias("hi"), F.col("m").alias("lo")
    )
    return others.union(least.select(*keys, "hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """``(keys, hi, lo)`` with ``hi > lo`` in, ``(keys, node, component)`` out; None without any edge.

    A component is named by its smallest node; nodes without edges are not listed. Each round
    is written to the shared folder, so the plan does not grow with the number of rounds.
    """
    edges = stage(edges.select(*keys, "hi", "lo").distinct(), "edges")
    seen = _signature(edges)
    if not seen[0]:
        return None
    while True:
        edges = stage(_small_star(_large_star(edges, keys), keys), "stars")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    members = edges.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = edges.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(centres)
