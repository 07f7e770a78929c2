"""Places around points: radius join, counts per activity, term frequencies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions.dimensions import poi_type_to_activity
from strideflow.functions.geo import (
    METRES_PER_DEGREE, band_columns, double, haversine_m, latitude_band, longitude_cell, within_sql,
)
from strideflow.operators.timeline import chunk_length, named_streams, tile
from strideflow.schemas import OTHER_ID, POI_RADIUS_M, STREAM_KEYS

SPOT = ["latitude", "longitude"]
CELL = ["band", "cell", "salt"]
# Points of one cell are spread over this many groups, so a crowded place is no single task.
SALTS = 8


def _n(i: int) -> str:
    return f"n_{i}"


def categories(include_other: bool) -> list[int]:
    return [i for i in range(OTHER_ID + 1) if include_other or i != OTHER_ID]


def _spread_points(points: DataFrame, ids: list[str], cell_m: float, salts: int) -> DataFrame:
    """Rows without coordinates match nothing; they get negative bands so that they spread too."""
    spread = f"xxhash64({', '.join(ids)})"
    columns = band_columns("band", cell_m)
    return points.withColumns({
        "band": F.expr(f"coalesce({latitude_band('latitude', cell_m)}, -1L - pmod({spread}, {1 << 20}L))"),
        "salt": F.expr(f"pmod({spread}, {salts}L)"),
    }).withColumn("cell", F.expr(f"pmod({longitude_cell('longitude', columns)}, {columns})"))


def _spread_places(places: DataFrame, radius_m: float, cell_m: float, salts: int) -> DataFrame:
    """Repeat each place for every cell its search circle can touch, and every salt."""
    reach = double(radius_m / METRES_PER_DEGREE * (1 + 1e-6) + 1e-9)
    south, north = latitude_band(f"place_lat - {reach}", cell_m), latitude_band(f"place_lat + {reach}", cell_m)
    shrink = f"greatest(cos(radians(least(abs(place_lat) + {reach}, 90D))), 0D)"
    # Close to a pole the circle reaches around it; 181 degrees stands for all longitudes.
    aside = f"least(coalesce(try_divide({reach} * 1.001D, {shrink}), 181D), 181D)"
    west, east = longitude_cell(f"place_lng - {aside}", "columns"), longitude_cell(f"place_lng + {aside}", "columns")
    return (
        places.withColumn("band", F.expr(f"explode(sequence({south}, {north}))"))
        .withColumn("columns", F.expr(band_columns("band", cell_m)))
        .withColumn("cell", F.expr(f"explode(sequence({west}, least({east}, {west} + columns - 1L)))"))
        .withColumn("cell", F.expr("pmod(cell, columns)"))
        .withColumn("salt", F.expr(f"explode(sequence(0L, {salts - 1}L))"))
        .select(*[F.col(c).alias(f"place_{c}") for c in CELL], *places.columns)
    )


def _within(points: DataFrame, ids: list[str], places: DataFrame, radius_m: float, how: str, salts: int) -> DataFrame:
    """Join points to places at most ``radius_m`` away: equal grid cells, then the exact distance."""
    cell_m = 2.0 * radius_m
    left = _spread_points(points, ids, cell_m, salts)
    right = _spread_places(places, radius_m, cell_m, salts)
    same_cell = " AND ".join(f"{c} = place_{c}" for c in CELL)
    near = within_sql("latitude", "longitude", "place_lat", "place_lng", radius_m, "<=")
    return left.join(right, F.expr(f"{same_cell} AND {near}"), how).select(*points.columns, *places.columns)


def poi_within(points: DataFrame, pois: DataFrame, radius_m: float = POI_RADIUS_M, salts: int = SALTS) -> DataFrame:
    """Pairs of distinct point coordinates and the places at most ``radius_m`` away."""
    places = pois.select("poi_id", F.col("latitude").alias("place_lat"), F.col("longitude").alias("place_lng"))
    pairs = _within(points.select(*SPOT).distinct(), SPOT, places, radius_m, "inner", salts)
    distance = haversine_m("latitude", "longitude", "place_lat", "place_lng")
    return pairs.select(*SPOT, "poi_id", distance.alias("distance_m"))


def place_types(pois: DataFrame) -> DataFrame:
    """One row per place and type with the activity it stands for."""
    return pois.select("poi_id", *SPOT, F.explode("types").alias("place_type")).withColumn(
        "activity_id", poi_type_to_activity(F.col("place_type"))
    )


def _spots(pois: DataFrame) -> DataFrame:
    """Type counts per exact place coordinate: many places at one address become one row."""
    return place_types(pois).groupBy(F.col("latitude").alias("place_lat"), F.col("longitude").alias("place_lng")).agg(
        *[F.expr(f"count(CASE WHEN activity_id = {i} THEN 1 END) AS {_n(i)}") for i in range(OTHER_ID + 1)]
    )


def count_around(points: DataFrame, ids: list[str], pois: DataFrame, radius_m: float = POI_RADIUS_M,
                 include_other: bool = False, salts: int = SALTS) -> DataFrame:
    """Add ``n_0 … n_7`` (``n_8``): place types per activity around each point; ``ids`` is its key."""
    wanted = categories(include_other)
    spots = _spots(pois).select("place_lat", "place_lng", *[_n(i) for i in wanted])
    joined = _within(points, ids, spots, radius_m, "left", salts)
    return joined.groupBy(*ids).agg(
        *[F.first(c).alias(c) for c in points.columns if c not in ids],
        *[F.expr(f"coalesce(sum({_n(i)}), 0L) AS {_n(i)}") for i in wanted]
    )


def poi_counts(points: DataFrame, pois: DataFrame, radius_m: float = POI_RADIUS_M, include_other: bool = False,
               salts: int = SALTS) -> DataFrame:
    """Counts for every distinct coordinate of ``points``."""
    return count_around(points.select(*SPOT).distinct(), SPOT, pois, radius_m, include_other, salts)


def poi_map(traces: DataFrame, pois: DataFrame, radius_m: float = POI_RADIUS_M, include_other: bool = False,
            keys: list[str] = STREAM_KEYS, chunk_ms: int | None = None, salts: int = SALTS) -> DataFrame:
    """Counts for every record: ``(keys, timestamp, n_…)``.

    Coordinates are looked up once per stream and time chunk, so one coordinate shared by very
    many records never becomes one join group.
    """
    rows = tile(named_streams(traces, keys).select(*keys, "timestamp", *SPOT), chunk_length(chunk_ms))
    spot = [*keys, "chunk", *SPOT]
    counts = count_around(rows.select(*spot).distinct(), spot, pois, radius_m, include_other, salts)
    counts = counts.select(*[F.col(c).alias(f"at_{c}" if c in spot else c) for c in counts.columns])
    # Records without a fix have their counts too: none.
    same = [f"{c} = at_{c}" for c in (*keys, "chunk")] + [f"{c} <=> at_{c}" for c in SPOT]
    return rows.join(counts, F.expr(" AND ".join(same))).drop("chunk", *SPOT, *[f"at_{c}" for c in spot])


def share(count: str, counts: list[str]) -> str:
    """One count among the sum of all, 0 where there are none."""
    return f"coalesce(try_divide(CAST({count} AS DOUBLE), CAST({' + '.join(counts)} AS DOUBLE)), 0D)"


def poi_tf(counts: DataFrame, include_other: bool = False) -> DataFrame:
    """Turn counts into shares per activity, all zero where no place is near."""
    wanted = categories(include_other)
    names = [_n(i) for i in wanted]
    kept = [c for c in counts.columns if c not in names]
    return counts.select(*kept, *[F.expr(f"{share(_n(i), names)} AS tf_{i}") for i in wanted])


def poi_tfidf(counts: DataFrame, scope: list[str], include_other: bool = False, salts: int = SALTS) -> DataFrame:
    """Shares weighted by ``ln(N / N_c)`` over the regions (rows) of each ``scope``.

    ``N_c`` regions of the ``N`` have a place of the category; none counts as one, a zero
    weight and a scope of one region count as weight one.
    """
    wanted = categories(include_other)
    names = [_n(i) for i in wanted]
    stats = counts.groupBy(*scope).agg(
        F.count("*").alias("regions"),
        *[F.expr(f"greatest(count(CASE WHEN n_{i} > 0 THEN 1 END), 1L) AS with_{i}") for i in wanted],
    )
    weights = stats.select(*scope, *[
        F.expr(f"CASE WHEN regions = with_{i} OR regions <= 1 THEN 1D ELSE ln(regions / with_{i}) END AS idf_{i}")
        for i in wanted
    ])
    kept = [c for c in counts.columns if c not in names]
    # The weights of a scope are repeated, so that a scope with very many rows is spread over several tasks.
    salted = counts.withColumn("salt", F.expr(f"pmod(xxhash64({', '.join(counts.columns)}), {salts}L)"))
    weights = weights.withColumn("salt", F.expr(f"explode(sequence(0L, {salts - 1}L))"))
    return salted.join(weights, [*scope, "salt"]).select(
        *kept, *[F.expr(f"{share(_n(i), names)} * idf_{i} AS tfidf_{i}") for i in wanted]
    )


def poi_sweep(points: DataFrame, pois: DataFrame, radii: Iterable[float] = (8.0, 15.0, 40.0, 90.0),
              salts: int = SALTS) -> DataFrame:
    """Shares for each radius, with and without "Other", per distinct row of ``points``.

    One join at the widest radius serves all of them.
    """
    radii = sorted(radii)
    points = points.distinct()
    joined = _within(points, points.columns, _spots(pois), radii[-1], "left", salts)
    every = categories(True)
    sums = joined.withColumn("distance_m", haversine_m("latitude", "longitude", "place_lat", "place_lng")).groupBy(
        *points.columns
    ).agg(*[
        F.expr(f"coalesce(sum(CASE WHEN distance_m <= {double(r)} THEN n_{i} END), 0L) AS n_{k}_{i}")
        for k, r in enumerate(radii) for i in every
    ])

    def case(k: int, r: float, other: bool) -> str:
        names = [f"n_{k}_{i}" for i in categories(other)]
        shares = [f"{share(n, names)} AS tf_{i}" for i, n in enumerate(names)]
        if not other:
            shares.append(f"CAST(NULL AS DOUBLE) AS tf_{OTHER_ID}")
        return f"struct({double(r)} AS radius_m, {str(other).lower()} AS include_other, {', '.join(shares)})"

    listed = ", ".join(case(k, r, o) for k, r in enumerate(radii) for o in (False, True))
    return sums.select(*points.columns, F.expr(f"explode(array({listed}))").alias("c")).select(*points.columns, "c.*")
