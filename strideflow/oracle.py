"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from strideflow.catalog import FIRST_TIME, HOME, LATEST, OFF_TIES, PERIODS, RUN_START, SUMMARY_GRID
from strideflow.plans.models import DECISION_TREE, RANDOM_FOREST, VARIANTS, model_path
from strideflow.schemas import ACTIVITIES, EARTH_RADIUS_KM, OTHER_ID, PLACE_TYPES, TRIP_ACTIVITIES
from strideflow.sources.views import FAULTY_SQL, POI_SQL, TRACES_SQL

T = f"t AS ({TRACES_SQL.format(events='events')})"
POIS = f"pois AS ({POI_SQL.format(split='string_split', part='part')})"
K = ["user", "dominanthand"]
TRAINING = [*K, "activity"]
REGION = [*TRAINING, "cluster_id"]
CLUSTERED = [*K, "cluster_id"]
AXES = ("x", "y", "z")


def cols(names, alias=""):
    return ", ".join(f"{alias}{n}" for n in names)


def same(names, a, b):
    return " AND ".join(f"{a}.{n} = {b}.{n}" for n in names)


def r6(expression, name=None):
    return f"round({expression} + {OFF_TIES}, 6) + 0e0 AS {name or expression}"


def with_(*ctes, recursive=False):
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def dist(lat1, lng1, lat2, lng2):
    h = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + pow(sin(radians({lng2} - {lng1}) / 2e0), 2)"
        f" * cos(radians({lat1})) * cos(radians({lat2})))"
    )
    return f"(2e0 * {EARTH_RADIUS_KM} * atan2(sqrt({h}), sqrt(1e0 - {h})) * 1e3)"


# --- segments, windows, features --------------------------------------------------------------

def seg(keys=K, source="t", gap=800):
    part = f"PARTITION BY {cols(keys)} ORDER BY timestamp"
    return (
        f"seg0 AS (SELECT *, lag(timestamp) OVER ({part}) AS prev FROM {source}),\n"
        f"seg1 AS (SELECT *, sum(CASE WHEN prev IS NULL OR timestamp - prev > {gap} THEN 1 ELSE 0 END)"
        f" OVER ({part}) - 1 AS sid FROM seg0),\n"
        f"seg AS (SELECT * EXCLUDE (prev, sid), CAST(sid AS INTEGER) AS seg_id,"
        f" min(timestamp) OVER (PARTITION BY {cols(keys)}, sid) AS seg_start FROM seg1)"
    )


GRID = "greatest(CAST(ceil((timestamp - seg_start) / {d}e0) AS BIGINT) - 1, 0)"


def win(duration=5000):
    return f"win AS (SELECT *, CAST({GRID.format(d=duration)} AS INTEGER) AS win_id FROM seg)"


def feat(keys=K, min_records=10):
    kw = cols([*keys, "seg_id", "win_id"])
    moved = dist("plat", "plng", "latitude", "longitude")
    aggregates = []
    for a in AXES:
        aggregates += [
            f"avg({a}) AS mean_{a}", f"stddev_pop({a}) AS std_{a}", f"coalesce(var_samp({a}), 0e0) AS var_{a}",
            f"avg(abs({a} - m{a})) AS absdiff_{a}",
            f"CASE WHEN count(DISTINCT timestamp) FILTER ({a} > 9e-1 * x{a}) > 1 THEN"
            f" (max(timestamp) FILTER ({a} > 9e-1 * x{a}) - min(timestamp) FILTER ({a} > 9e-1 * x{a}))"
            f" / CAST(count(DISTINCT timestamp) FILTER ({a} > 9e-1 * x{a}) - 1 AS DOUBLE) ELSE 0e0 END AS peak_{a}",
        ]
    whole = ", ".join(f"avg({a}) OVER w AS m{a}, max({a}) OVER w AS x{a}" for a in AXES)
    return (
        f"st0 AS (SELECT *, lag(timestamp) OVER (PARTITION BY {kw} ORDER BY timestamp) AS pts,"
        f" lag(latitude) OVER (PARTITION BY {kw} ORDER BY timestamp) AS plat,"
        f" lag(longitude) OVER (PARTITION BY {kw} ORDER BY timestamp) AS plng FROM win),\n"
        f"st1 AS (SELECT *, {moved} AS step FROM st0),\n"
        f"st2 AS (SELECT *, step / ((timestamp - pts) / 1e3) * 3.6e0 AS kmh,"
        f" sum(step) OVER w / (nullif(max(timestamp) OVER w - min(timestamp) OVER w, 0) / 1e3) * 3.6e0 AS mkmh,"
        f" count(*) OVER w AS n, {whole} FROM st1 WINDOW w AS (PARTITION BY {kw})),\n"
        f"feat AS (SELECT {kw}, min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS n_records,"
        f" arg_min(latitude, timestamp) AS first_lat, arg_min(longitude, timestamp) AS first_lng,"
        f" max(timestamp) - min(timestamp) AS duration_ms,"
        f" coalesce(sum(step), 0e0) AS total_distance, coalesce(max(mkmh), 0e0) AS avg_speed,"
        f" greatest(coalesce(max(kmh), 0e0), 0e0) AS max_speed,"
        f" coalesce(sqrt(sum((kmh - mkmh) * (kmh - mkmh)) / count(*)), 0e0) AS sd_speed,"
        f" avg(sqrt(x * x + y * y + z * z)) AS resultant, {', '.join(aggregates)}"
        f" FROM st2 WHERE n >= {min_records} GROUP BY {kw})"
    )


ACCEL = [*[f"{s}_{a}" for s in ("mean", "std", "var", "absdiff") for a in AXES], "resultant", *[f"peak_{a}" for a in AXES]]
MOTION = ["avg_speed", "max_speed", "sd_speed", "total_distance"]
BOUNDS = "window_start, window_end, n_records"
KW = [*K, "seg_id", "win_id"]


def feature_query(columns, extra=""):
    shown = ", ".join([cols(KW)] + ([extra] if extra else []) + [r6(c) for c in columns])
    return with_(T, seg(), win(), feat()) + f"SELECT {shown} FROM feat"


# --- places -----------------------------------------------------------------------------------

def activity_of(place_type):
    cases = " ".join(
        f"WHEN upper(regexp_replace({place_type}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) IN ({', '.join(repr(n.upper()) for n in names)}) THEN {ACTIVITIES[label]}"
        for label, names in PLACE_TYPES.items()
    )
    return f"CAST(CASE {cases} ELSE {OTHER_ID} END AS INTEGER)"


TYPES = f"types AS (SELECT poi_id, latitude, longitude, p AS place_type, {activity_of('p')} AS activity_id" \
        " FROM (SELECT poi_id, latitude, longitude, unnest(types) AS p FROM pois))"
SPOTS = "spots AS (SELECT latitude AS plat, longitude AS plng, " + ", ".join(
    f"count(*) FILTER (activity_id = {i}) AS n_{i}" for i in range(9)) + " FROM types GROUP BY ALL)"
COORDS = "coords AS (SELECT DISTINCT latitude, longitude FROM t)"


def around(points, radius, name="near", measure=None):
    """Places around each coordinate of a table; the band condition only spares distance computations."""
    d = dist("c.latitude", "c.longitude", "s.plat", "s.plng")
    return (
        f"{name} AS (SELECT c.latitude, c.longitude, {d} AS d, s.* FROM {points} c JOIN spots s"
        f" ON abs(c.latitude - s.plat) < {radius / 1e5}e0 + 1e-6 AND {d} <= {radius}e0)"
    )


def counts(points="coords", wanted=range(8), near="near"):
    n = ", ".join(f"CAST(coalesce(sum(n_{i}), 0) AS BIGINT) AS n_{i}" for i in wanted)
    return f"counts AS (SELECT latitude, longitude, {n} FROM {points} LEFT JOIN {near} USING (latitude, longitude) GROUP BY ALL)"


def tf(i, wanted=range(8), prefix="n_"):
    total = " + ".join(f"{prefix}{j}" for j in wanted)
    return f"coalesce({prefix}{i} / CAST(nullif({total}, 0) AS DOUBLE), 0e0)"


PLACES = [POIS, TYPES, SPOTS]


def aware(keys, key_sql=None):
    shown = ", ".join(
        [cols([*keys, "seg_id", "win_id"], "f."), "window_start, window_end, n_records"]
        + [r6(f"CASE WHEN cluster_id = -1 THEN 0e0 ELSE {tf(i)} END", f"tf_{i}") for i in range(8)]
        + [r6(f"CASE WHEN cluster_id = -1 THEN {m} ELSE 0e0 END", m) for m in MOTION] + [r6(c) for c in ACCEL]
    )
    ctes = [
        *PLACES, "coords AS (SELECT DISTINCT first_lat AS latitude, first_lng AS longitude FROM feat)",
        around("coords", 20.0), counts(),
    ]
    return ctes, f"SELECT {shown}{key_sql or ''} FROM feat f JOIN counts c ON c.latitude = f.first_lat AND c.longitude = f.first_lng"


LABELLED = (
    "lab AS (SELECT *, CAST(CASE WHEN activity IN (" + ", ".join(repr(a) for a in TRIP_ACTIVITIES)
    + ") THEN -1 ELSE 1 END AS INTEGER) AS cluster_id FROM t WHERE activity <> 'Other')"
)
UNAWARE = "lab AS (SELECT *, CAST(-1 AS INTEGER) AS cluster_id FROM t WHERE activity <> 'Other')"
ALL_LABELLED = LABELLED.replace(" WHERE activity <> 'Other'", "")
ACTIVITY_ID = "CASE activity " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in ACTIVITIES.items()) + " END"


# --- clusters ---------------------------------------------------------------------------------

def pairs(name="nb", distance=40.0, ms=800, source="t"):
    d = dist("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    return (
        f"{name} AS MATERIALIZED (SELECT {cols(K, 'a.')}, a.timestamp AS ts, b.timestamp AS other, {d} AS d"
        f" FROM {source} a JOIN {source} b ON {same(K, 'a', 'b')} AND b.timestamp BETWEEN a.timestamp - {ms - 1}"
        f" AND a.timestamp + {ms - 1} AND a.timestamp <> b.timestamp WHERE {d} < {distance}e0)"
    )


def dbscan(min_points=35, distance=40.0, ms=800, source="t", s=""):
    """Density clusters from the definition: cores, reachability, border records, noise."""
    k = cols(K)
    return [
        pairs(f"nb{s}", distance, ms, source),
        f"core{s} AS MATERIALIZED (SELECT {k}, ts FROM nb{s} GROUP BY {k}, ts HAVING count(*) >= {min_points})",
        f"link{s} AS MATERIALIZED (SELECT {cols(K, 'n.')}, n.ts, n.other FROM nb{s} n"
        f" JOIN core{s} a ON {same([*K, 'ts'], 'n', 'a')} JOIN core{s} b ON {same(K, 'n', 'b')} AND n.other = b.ts)",
        f"reach{s}({k}, ts, label) USING KEY ({k}, ts) AS (SELECT {k}, ts, ts FROM core{s}"
        f" UNION SELECT {cols(K, 'l.')}, l.other, min(r.label) FROM reach{s} r JOIN link{s} l ON {same([*K, 'ts'], 'l', 'r')}"
        f" JOIN recurring.reach{s} q ON {same(K, 'l', 'q')} AND l.other = q.ts WHERE r.label < q.label"
        f" GROUP BY {cols(K, 'l.')}, l.other)",
        f"num{s} AS (SELECT {k}, ts, dense_rank() OVER (PARTITION BY {k} ORDER BY label) - 1 AS c FROM reach{s})",
        f"border{s} AS (SELECT {cols(K, 'n.')}, n.ts, max(c.c) AS c FROM nb{s} n JOIN num{s} c"
        f" ON {same(K, 'n', 'c')} AND n.other = c.ts GROUP BY {cols(K, 'n.')}, n.ts)",
        f"clus{s} AS (SELECT t.*, CAST(coalesce(n.c, b.c, -1) AS INTEGER) AS cluster_id FROM {source} t"
        f" LEFT JOIN num{s} n ON {same(K, 't', 'n')} AND t.timestamp = n.ts"
        f" LEFT JOIN border{s} b ON {same(K, 't', 'b')} AND t.timestamp = b.ts)",
    ]


def cluster_summary():
    parts, ctes = [], [T]
    for i, (points, metres, ms) in enumerate(SUMMARY_GRID):
        ctes += dbscan(points, metres, ms, s=str(i))
        parts.append(
            f"SELECT CAST({points} AS INTEGER) AS min_points, CAST({metres} AS DOUBLE) AS distance_m,"
            f" CAST({ms} AS INTEGER) AS time_ms, {cols(K)},"
            " CASE WHEN cluster_id = -1 THEN 'noise' ELSE CAST(cluster_id AS VARCHAR) END AS cluster,"
            " count(*) AS size, max(timestamp) - min(timestamp) AS duration, min(timestamp) AS start_time, "
            + r6("arg_min(latitude, timestamp)", "start_lat") + ", " + r6("arg_min(longitude, timestamp)", "start_lng")
            + ", max(timestamp) AS end_time, " + r6("arg_max(latitude, timestamp)", "end_lat") + ", "
            + r6("arg_max(longitude, timestamp)", "end_lng") + f" FROM clus{i} GROUP BY {cols(K)}, cluster_id"
        )
    return with_(*ctes, recursive=True) + "\nUNION ALL\n".join(parts)


# --- all queries ------------------------------------------------------------------------------

NUMBERS = ["x", "y", "z", "latitude", "longitude"]
RECORD = "user, dominanthand, timestamp"
ALL_RECORDS = with_(T) + f"SELECT {RECORD}, activity, {', '.join(r6(c) for c in NUMBERS)} FROM t"
LAST = f"(SELECT *, row_number() OVER (PARTITION BY {cols(K)} ORDER BY timestamp DESC) AS rn FROM t)"


def _split_side():
    ids = [*REGION, "seg_id", "win_id"]
    text = "concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in ids) + ")"
    bucket = f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 1000"
    return (
        with_(T, UNAWARE, seg(REGION, "lab"), win(), feat(REGION))
        + f"SELECT {cols(ids)}, CASE WHEN {bucket} < 700 THEN 'train' ELSE 'test' END AS side FROM feat"
    )


def _sweep():
    radii = (8.0, 15.0, 40.0, 90.0)
    ids = f"{cols(K)}, place, cluster_id, seg_id"
    parts = []
    for r in radii:
        sums = ", ".join(f"coalesce(sum(n_{i}) FILTER (d <= {r}e0), 0) AS n_{i}" for i in range(9))
        for other in (False, True):
            wanted = range(9 if other else 8)
            shown = [r6(tf(i, wanted), f"tf_{i}") if i in wanted else f"CAST(NULL AS DOUBLE) AS tf_{i}" for i in range(9)]
            parts.append(
                f"SELECT {ids}, latitude AS lat0, longitude AS lng0, {r}e0 AS radius_m, {other} AS include_other, {', '.join(shown)}"
                f" FROM (SELECT {ids}, latitude, longitude, {sums} FROM spots_in LEFT JOIN near USING (latitude, longitude) GROUP BY ALL)"
            )
    body = "\nUNION ALL\n".join(parts)
    return (
        with_(T, *PLACES, COORDS, ALL_LABELLED, seg(REGION, "lab"),
              f"spots_in AS (SELECT {cols(K)}, activity AS place, cluster_id, seg_id, arg_min(latitude, timestamp) AS latitude,"
              f" arg_min(longitude, timestamp) AS longitude FROM seg GROUP BY {cols(REGION)}, seg_id)", around("coords", 90.0))
        + f"SELECT * EXCLUDE (lat0, lng0), {r6('lat0', 'latitude')}, {r6('lng0', 'longitude')} FROM ({body})"
    )


def _tfidf():
    idf = ", ".join(
        f"CASE WHEN count(*) <= 1 OR ln(count(*) / CAST(greatest(count(*) FILTER (n_{i} > 0), 1) AS DOUBLE)) = 0 THEN 1e0"
        f" ELSE ln(count(*) / CAST(greatest(count(*) FILTER (n_{i} > 0), 1) AS DOUBLE)) END AS idf_{i}" for i in range(8)
    )
    shown = ", ".join(r6(f"{tf(i)} * idf_{i}", f"tfidf_{i}") for i in range(8))
    return (
        with_(T, *PLACES, COORDS, around("coords", 20.0), counts(),
              "pm AS (SELECT user, dominanthand, timestamp, counts.* FROM t JOIN counts USING (latitude, longitude))",
              f"scope AS (SELECT {cols(K)}, {idf} FROM pm GROUP BY {cols(K)})")
        + f"SELECT {cols(K)}, timestamp, {shown} FROM pm JOIN scope USING ({cols(K)})"
    )


def _lagging():
    g = GRID.format(d=50)
    return (
        with_(T, seg(), f"i AS (SELECT *, row_number() OVER (PARTITION BY {cols(K)}, seg_id ORDER BY timestamp) - 1 AS i, {g} AS g FROM seg)")
        + f"SELECT {RECORD}, seg_id, CAST(i + min(g - i) OVER (PARTITION BY {cols(K)}, seg_id ORDER BY timestamp"
          " ROWS UNBOUNDED PRECEDING) AS INTEGER) AS win_id FROM i"
    )


def _training_set():
    ctes, select = aware(REGION, f", CAST({ACTIVITY_ID} AS DOUBLE) AS label")
    return with_(T, LABELLED, seg(REGION, "lab"), win(), feat(REGION), *ctes) + select


def _model_path():
    parts = [
        f"SELECT {aware_} AS locationaware, dominanthand, CASE WHEN dominanthand THEN"
        f" '{model_path('models', RANDOM_FOREST, aware_, True)}' ELSE '{model_path('models', RANDOM_FOREST, aware_, False)}' END AS path"
        " FROM (SELECT DISTINCT dominanthand FROM t)" for aware_ in (False, True)
    ]
    return with_(T) + " UNION ALL ".join(parts)


def _aware_query(source_ctes, keys, source, recursive=False):
    ctes, select = aware(keys)
    return with_(T, *source_ctes, seg(keys, source), win(), feat(keys), *ctes, recursive=recursive) + select


# --- faulty records ---------------------------------------------------------------------------

FAULTY = f"raw AS ({FAULTY_SQL.format(traces=TRACES_SQL.format(events='events'))})"
GIVEN = "user IS NOT NULL AND dominanthand IS NOT NULL AND timestamp IS NOT NULL AND activity IS NOT NULL"
KEPT = f"t AS (SELECT * FROM raw WHERE {GIVEN})"
KEPT_ONCE = f"t AS (SELECT DISTINCT * FROM raw WHERE {GIVEN})"


def _faulty_dbscan():
    fixes = f"pts AS (SELECT DISTINCT {cols(K)}, timestamp, latitude, longitude FROM t WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"
    return (
        with_(FAULTY, KEPT, fixes, *dbscan(source="pts"), recursive=True)
        + f"SELECT {cols([*K, 'timestamp'], 't.')}, coalesce(c.cluster_id, -1) AS cluster_id FROM t LEFT JOIN clus c"
          f" ON {same([*K, 'timestamp'], 't', 'c')}"
    )


# --- models -----------------------------------------------------------------------------------

VECTOR_ID = [*REGION, "seg_id", "win_id"]
BUCKET = (
    "CAST('0x' || substr(md5(concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in VECTOR_ID)
    + ")), 1, 8) AS BIGINT) % 1000"
)
LABEL = f"CAST({ACTIVITY_ID} AS DOUBLE)"
PERIOD_ID = "CASE " + " ".join(f"WHEN peak_z < {most} THEN {ACTIVITIES[name]}e0" for most, name in PERIODS) + " END"
OWN_LABELS = "count(DISTINCT activity) AS n_labels, count(*) AS n_known"
PERIOD = "CASE " + " ".join(f"WHEN peak_z < {most} THEN '{name}'" for most, name in PERIODS) + " END"


def _per_variant(select):
    """A query over the feature windows ``feat``, without and with locations."""
    parts = []
    for located, lab in ((False, UNAWARE), (True, LABELLED)):
        parts.append("(" + with_(T, lab, seg(REGION, "lab"), win(), feat(REGION)) + select.replace("LOCATED", str(located)) + ")")
    return "\nUNION ALL\n".join(parts)


def _predicted():
    """Test rows under the period rule, which a tree must find, and under their own labels; what is guessed of these is only known."""
    rule = f"{PERIOD_ID} AS label, {PERIOD_ID} AS prediction, {PERIOD} AS predicted, 'period' AS taught, true AS known"
    own = f"{LABEL} AS label, CAST(NULL AS DOUBLE) AS prediction, CAST(NULL AS VARCHAR) AS predicted, 'activity' AS taught, true AS known"
    return _per_variant("\nUNION ALL\n".join(
        f"SELECT {cols(VECTOR_ID)}, {shown}, LOCATED AS locationaware FROM feat WHERE {BUCKET} >= 700" for shown in (rule, own)
    ))


def _test_counts(columns):
    return _per_variant(
        f"SELECT LOCATED AS locationaware, dominanthand, {columns} FROM feat WHERE {BUCKET} >= 700 GROUP BY dominanthand"
    )


def _trained(found):
    """A row for each hand, also for one that nobody wears; such a variant has no model."""
    hands = "(SELECT unnest([true, false]) AS hand) LEFT JOIN feat ON dominanthand = hand"
    value = f"CASE WHEN count(user) FILTER ({BUCKET} < 700) > 0 THEN true END AS {found}"
    parts = []
    for name in ("decisiontree", "randomforest"):
        shown = f"'{name}' AS algorithm, LOCATED AS locationaware, hand AS dominanthand, count(user) AS n_vectors, count(user) FILTER ({BUCKET} >= 700) AS n_test"
        parts.append(_per_variant(f"SELECT {shown}, {value} FROM {hands} GROUP BY hand"))
    return "\nUNION ALL\n".join(parts)


def _bayes():
    """Multinomial Bayes in closed form: scaled features, smoothed shares, the largest posterior."""
    def select(located):
        names = ([f"tf_{i}" for i in range(8)] + MOTION + ACCEL) if located else ACCEL
        tfs = [f"CASE WHEN cluster_id = -1 THEN 0e0 ELSE {tf(i)} END AS tf_{i}" for i in range(8)]
        motion = [f"CASE WHEN cluster_id = -1 THEN {m} ELSE 0e0 END AS {m}" for m in MOTION]
        fields = (tfs + motion + ACCEL) if located else ACCEL
        source = "feat f JOIN counts c ON c.latitude = f.first_lat AND c.longitude = f.first_lng" if located else "feat"
        lo_hi = ", ".join(f"min({n}) AS lo_{n}, max({n}) AS hi_{n}" for n in names)
        unit = ", ".join(
            f"CASE WHEN hi_{n} > lo_{n} THEN greatest(({n} - lo_{n}) / (hi_{n} - lo_{n}), 0e0) ELSE 0e0 END AS u_{n}" for n in names
        )
        sums = ", ".join(f"sum(u_{n}) AS s_{n}" for n in names)
        whole = " + ".join(f"s_{n}" for n in names)
        score = " + ".join(f"u_{n} * (ln(s_{n} + 1e0) - ln({whole} + {len(names)}e0))" for n in names)
        return (
            f"SELECT * EXCLUDE (score, rn) FROM (SELECT {cols(VECTOR_ID, 'q.')}, q.label, m.label AS prediction,"
            " m.name AS predicted, LOCATED AS locationaware, ln(m.n + 1e0) + " + score + " AS score,"
            f" row_number() OVER (PARTITION BY {cols(VECTOR_ID, 'q.')} ORDER BY ln(m.n + 1e0) + {score} DESC, m.label) AS rn"
            " FROM ("
            f"SELECT * FROM scaled WHERE NOT train) q JOIN (SELECT dominanthand, label, any_value(activity) AS name, count(*) AS n, {sums}"
            " FROM scaled WHERE train GROUP BY dominanthand, label) m ON m.dominanthand = q.dominanthand) WHERE rn = 1"
        ), [
            f"vec AS (SELECT {cols(VECTOR_ID)}, {LABEL} AS label, {BUCKET} < 700 AS train, {', '.join(fields)} FROM {source})",
            f"ranges AS (SELECT dominanthand, {lo_hi} FROM vec WHERE train GROUP BY dominanthand)",
            f"scaled AS (SELECT {cols(VECTOR_ID)}, label, train, {unit} FROM vec JOIN ranges USING (dominanthand))",
        ]

    parts = []
    for located, lab in ((False, UNAWARE), (True, LABELLED)):
        body, ctes = select(located)
        near = [*PLACES, "coords AS (SELECT DISTINCT first_lat AS latitude, first_lng AS longitude FROM feat)",
                around("coords", 20.0), counts()] if located else []
        parts.append("(" + with_(T, lab, seg(REGION, "lab"), win(), feat(REGION), *near, *ctes) + body.replace("LOCATED", str(located)) + ")")
    return "\nUNION ALL\n".join(parts)


def _recognised(located, select):
    """Windows of the latest records, in clusters or, without locations, as one trip."""
    if located:
        ctes = [*dbscan(source="recent"), seg(CLUSTERED, "clus")]
    else:
        ctes = ["trip AS (SELECT *, CAST(-1 AS INTEGER) AS cluster_id FROM recent)", seg(CLUSTERED, "trip")]
    return "(" + with_(T, LATEST_ALL, *ctes, win(), feat(CLUSTERED), recursive=located) + select.replace("LOCATED", str(located)) + ")"


def _result(located):
    paths = f"CASE WHEN dominanthand THEN '{model_path('models', DECISION_TREE, located, True)}' ELSE '{model_path('models', DECISION_TREE, located, False)}' END"
    return (
        f"SELECT user, CAST({RUN_START - 10000} AS BIGINT) AS timestamp, {PERIOD} AS activity, {paths} AS model, dominanthand,"
        " LOCATED AS locationaware, window_start, window_end FROM feat"
    )


def _recognise():
    select = f"SELECT {cols(CLUSTERED)}, seg_id, win_id, window_start, window_end, {PERIOD} AS predicted, LOCATED AS locationaware FROM feat"
    return "\nUNION ALL\n".join(_recognised(located, select) for located in (False, True))


def _results():
    return "\nUNION ALL\n".join(_recognised(located, _result(located)) for located in (False, True))


def _located_stream():
    starts = with_(T, LABELLED, seg(REGION, "lab")) + f"SELECT DISTINCT {cols(REGION)}, seg_id, seg_start FROM seg"
    return (
        f"SELECT a.* EXCLUDE (seg_id), s.seg_start FROM ({_aware_query([LABELLED], REGION, 'lab')}) a JOIN ({starts}) s"
        f" ON {same([*REGION, 'seg_id'], 'a', 's')}"
    )


def _stream_sides(kept):
    late = f"timestamp < {FIRST_TIME + 60_000} AND timestamp % 1300 = 0"
    return (
        with_(T) + f"SELECT {cols(K)}, CASE WHEN {late} THEN 'late' WHEN timestamp % 1700 = 0 THEN 'ahead' ELSE '{kept}' END AS side,"
        " count(*) AS n_records FROM t GROUP BY ALL"
    )


LATEST_ALL = f"recent AS (SELECT * EXCLUDE (rn) FROM {LAST} WHERE rn <= 2500)"
SEGMENTS_OUT = f"SELECT {cols(K)}, seg_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_records FROM seg GROUP BY {cols(K)}, seg_id"

ORACLE: dict[str, str] = {
    "read_traces": ALL_RECORDS,
    "read_trace_csv": ALL_RECORDS,
    "read_trace_csv_place": ALL_RECORDS.replace(", activity,", ", activity, concat('at ', activity) AS place,"),
    "read_xyz_csv": with_(T) + f"SELECT {', '.join(r6(a) for a in AXES)} FROM t",
    "read_ticks_csv": with_(T) + "SELECT timestamp, CAST(trunc(x) AS BIGINT) AS value FROM t",
    "conform_traces": ALL_RECORDS,
    "malformed_traces": with_(FAULTY) + "SELECT coalesce(user, 'none') AS user, coalesce(CAST(dominanthand AS VARCHAR), 'none')"
    f" AS dominanthand, timestamp, CASE WHEN {GIVEN} THEN 'kept' ELSE 'quarantined' END AS side, count(*) AS n_records FROM raw GROUP BY ALL",
    "faulty_gap_segments": with_(FAULTY, KEPT_ONCE, seg()) + f"SELECT {RECORD}, seg_id, seg_start FROM seg",
    "faulty_st_dbscan": _faulty_dbscan(),
    "faulty_poi_map": with_(FAULTY, KEPT, *PLACES, COORDS, around("coords", 20.0), counts())
    + f"SELECT {RECORD}, {', '.join(f'coalesce(n_{i}, 0) AS n_{i}' for i in range(8))} FROM t LEFT JOIN counts USING (latitude, longitude)",
    "faulty_peak_interval": with_(FAULTY, KEPT, seg(), win(), feat()) + f"SELECT {cols(KW)}, {', '.join(r6(f'peak_{a}') for a in AXES)} FROM feat",
    "write_results": with_(T, UNAWARE, seg(REGION, "lab"), win(), feat(REGION))
    + f"SELECT user, CAST({RUN_START - 10000} AS BIGINT) AS timestamp, activity, 'labels' AS model, dominanthand,"
      " false AS locationaware, window_start, window_end FROM feat",
    "traces_between": with_(T) + f"SELECT {RECORD}, {', '.join(r6(c) for c in NUMBERS)} FROM t"
    " WHERE user = 'u0' AND dominanthand AND timestamp > 1500000005000 AND timestamp < 1500000090000",
    "latest_traces": with_(T) + f"SELECT {RECORD} FROM {LAST} WHERE rn <= {LATEST}",
    "indexed_between": with_(T) + f"SELECT {RECORD}, {', '.join(r6(c) for c in NUMBERS)} FROM t"
    " WHERE user = 'u0' AND dominanthand AND timestamp > 1500000005000 AND timestamp < 1500000090000",
    "indexed_latest": with_(T) + f"SELECT {RECORD} FROM {LAST} WHERE rn <= {LATEST}",
    "distinct_users": with_(T) + "SELECT DISTINCT user FROM t",
    "training_traces": ALL_RECORDS + " WHERE activity <> 'Other'",
    "activity_dim": with_(T) + f"SELECT activity, count(*) AS n_records, CAST({ACTIVITY_ID} AS INTEGER) AS activity_id,"
    f" CAST({ACTIVITY_ID} AS INTEGER) AS joined_id, activity AS label_again FROM t GROUP BY activity",
    "haversine": with_(T) + f"SELECT {RECORD}, {r6(dist('latitude', 'longitude', f'{HOME[0]}e0', f'{HOME[1]}e0'), 'distance_m')} FROM t",
    "st_neighbours": with_(T, pairs()) + f"SELECT {cols(K)}, ts AS timestamp, count(*) AS n_neighbours, min(other) AS first_ts,"
    f" max(other) AS last_ts, {r6('max(d)', 'furthest_m')} FROM nb GROUP BY {cols(K)}, ts",
    "st_dbscan": with_(T, *dbscan(), recursive=True) + f"SELECT {RECORD}, cluster_id FROM clus",
    "st_dbscan_wide": with_(T, *dbscan(distance=40000.0), recursive=True) + f"SELECT {RECORD}, cluster_id FROM clus",
    "cluster_summary": cluster_summary(),
    "label_regions": with_(T, LABELLED) + f"SELECT {cols(K)}, activity, cluster_id, count(*) AS n_records FROM lab GROUP BY ALL",
    "recognise_regions": with_(T, LATEST_ALL, *dbscan(source="recent"), recursive=True)
    + f"SELECT {cols(K)}, cluster_id, count(*) AS n_records, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM clus GROUP BY ALL",
    "gap_segments": with_(T, seg()) + f"SELECT {RECORD}, seg_id, seg_start FROM seg",
    "segment_summary": with_(T, seg()) + SEGMENTS_OUT,
    "anchored_windows": with_(T, seg(), win()) + f"SELECT {RECORD}, seg_id, win_id FROM win",
    "anchored_windows_lagging": _lagging(),
    "min_window_size": with_(T, seg(), win()) + f"SELECT {cols(KW)}, min(timestamp) AS window_start, max(timestamp) AS window_end,"
    f" count(*) AS n_records FROM win GROUP BY {cols(KW)} HAVING count(*) >= 10",
    "accel_features": feature_query(ACCEL),
    "peak_interval": feature_query([f"peak_{a}" for a in AXES]),
    "speeds": with_(T, seg(), win(), feat()) + f"SELECT {cols(KW)}, timestamp, {r6('coalesce(kmh, 0e0)', 'speed_kmh')} FROM st2",
    "motion_features": feature_query(MOTION, "duration_ms"),
    "trip_duration": feature_query([], "duration_ms"),
    "avg_speed_kmh": feature_query(["avg_speed"]),
    "max_speed_kmh": feature_query(["max_speed"]),
    "speed_stddev": feature_query(["sd_speed"]),
    "poi_within": with_(T, POIS, COORDS)
    + f"SELECT {r6('c.latitude', 'latitude')}, {r6('c.longitude', 'longitude')}, poi_id,"
      f" {r6(dist('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude'), 'distance_m')} FROM coords c JOIN pois p"
      f" ON abs(c.latitude - p.latitude) < 1e-3 AND {dist('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')} <= 20e0",
    "poi_type_to_activity": with_(POIS, TYPES) + "SELECT poi_id, place_type, activity_id FROM types",
    "poi_counts": with_(T, *PLACES, COORDS, around("coords", 20.0), counts(wanted=range(9)))
    + f"SELECT latitude, longitude, {cols([f'n_{i}' for i in range(9)])} FROM counts",
    "poi_counts_cached": with_(T, *PLACES, COORDS, around("coords", 20.0), counts(wanted=range(9)),
                               "first AS (SELECT DISTINCT latitude, longitude, 'poll-1' AS run FROM t WHERE dominanthand)")
    + f"SELECT latitude, longitude, {cols([f'n_{i}' for i in range(9)])}, coalesce(run, 'poll-2') AS run FROM counts LEFT JOIN first USING (latitude, longitude)",
    "poi_map": with_(T, *PLACES, COORDS, around("coords", 20.0), counts())
    + f"SELECT {RECORD}, {cols([f'n_{i}' for i in range(8)])} FROM t JOIN counts USING (latitude, longitude)",
    "poi_tf": with_(T, *PLACES, COORDS, around("coords", 20.0), counts())
    + f"SELECT {r6('latitude')}, {r6('longitude')}, {', '.join(r6(tf(i), f'tf_{i}') for i in range(8))} FROM counts",
    "poi_tfidf": _tfidf(),
    "poi_sweep": _sweep(),
    "features_basic": feature_query(ACCEL, BOUNDS),
    "features_location_aware": _aware_query([LABELLED], REGION, "lab"),
    "features_clustered": _aware_query(dbscan(), CLUSTERED, "clus", recursive=True),
    "training_set": _training_set(),
    "split": _split_side(),
    "accuracy": with_(T, LABELLED, seg(REGION, "lab"), win(), feat(REGION))
    + "SELECT user, count(*) AS n_test, " + r6(
        f"avg(CASE WHEN {ACTIVITY_ID} = CASE WHEN cluster_id = -1 AND max_speed > 1 THEN 7 ELSE 0 END THEN 1e0 ELSE 0e0 END)",
        "accuracy") + " FROM feat GROUP BY user",
    "model_path": _model_path(),
    "train_decision_tree": _test_counts(f"'{DECISION_TREE}' AS algorithm, count(*) AS n_test, 1e0 AS accuracy, {OWN_LABELS}"),
    "train_random_forest": _test_counts(f"'{RANDOM_FOREST}' AS algorithm, count(*) AS n_test, true AS learnt, {OWN_LABELS}"),
    "train_naive_bayes": _bayes(),
    "confusion_matrix": f"SELECT taught, label, prediction, count(*) AS n FROM ({_predicted()}) GROUP BY taught, label, prediction",
    "predict_activity": _predicted(),
    "load_models": _test_counts(
        "count(*) AS n_test, count(*) AS n_same, true AS learnt, count(*) AS n_right, count(*) AS n_own_same, count(*) AS n_own_known"
    ),
    "compiled_forest": _per_variant("SELECT LOCATED AS locationaware, dominanthand, count(*) AS n_rows, count(*) AS n_same FROM feat GROUP BY dominanthand"),
    "train_models": _trained("learnt"),
    "run_training": _trained("measured"),
    "recognise": _recognise(),
    "recognition_results": _recognised(False, _result(False)),
    "recognise_all": _results(),
    "recognise_forest": "SELECT locationaware, dominanthand, count(*) AS n_windows, count(*) AS n_same, count(*) AS n_taught"
    f" FROM ({_results()}) GROUP BY locationaware, dominanthand",
    "stream_recognise": _results(),
    "stream_regions": with_(T, LATEST_ALL, *dbscan(source="recent"), recursive=True) + f"SELECT {RECORD}, cluster_id FROM clus",
    "stream_segments": with_(T, seg()) + SEGMENTS_OUT.replace("seg_id, min", "min"),
    "stream_windows": with_(T, seg(), win()) + f"SELECT {RECORD}, seg_start, win_id FROM win",
    "stream_features_located": _located_stream(),
    "stream_window_sides": _stream_sides("window"),
    "stream_segment_sides": _stream_sides("segment"),
    "stream_features": with_(T, seg(), win(), feat(), "starts AS (SELECT DISTINCT user, dominanthand, seg_id, seg_start FROM seg)")
    + f"SELECT {cols(K)}, seg_start, win_id, {BOUNDS}, {', '.join(r6(c) for c in ACCEL)} FROM feat JOIN starts USING (user, dominanthand, seg_id)",
}
