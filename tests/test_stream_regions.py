"""Regions kept in state equal those of the batch operator after every micro-batch."""

import random

import pytest
from helpers import TRACE_DDL, by_user, frame, random_streams, times

from strideflow.operators.clustering import st_dbscan
from strideflow.streaming.regions import stream_regions


@pytest.mark.parametrize(("latest", "shuffle_ms", "chunk_ms"), [(60, 0, 60), (1000, 200, 100), (25, 400, 60)])
def test_regions_equal_batch_after_every_micro_batch(spark, tmp_path, latest, shuffle_ms, chunk_ms):
    rng = random.Random(latest)
    data = random_streams(31, users=6, n=90, max_step=9, spread_m=25.0, jump=0.2)
    data.sort(key=lambda r: r["timestamp"] % 1000 + rng.randrange(shuffle_ms + 1))
    path = str(tmp_path / "in")
    times(spark, []).write.parquet(path)
    parts = [data[i:i + 110] for i in range(0, len(data), 110)]
    for k, part in enumerate(parts):
        again = part + parts[k - 1][:5] if k else part  # some records are sent twice
        frame(spark, again).coalesce(1).write.mode("append").parquet(path)
    seen, wrong, checked = [], [], []

    def check(batch, batch_id):
        got = {(r.user, r.timestamp): r.cluster_id for r in batch.collect()}
        if not got:
            return
        seen.extend(parts[len(checked)])
        held = []
        for user, g in by_user(seen).items():
            if user in {u for u, _ in got}:
                held += [{**r, "user": user} for r in g.tail(latest).drop(columns="user").to_dict("records")]
        want = {(r.user, r.timestamp): r.cluster_id for r in st_dbscan(frame(batch.sparkSession, held), 6, 40.0, 30).collect()}
        checked.append(len(set(want.values())))
        if got != want:
            wrong.append(batch_id)

    stream = spark.readStream.schema(TRACE_DDL).option("maxFilesPerTrigger", 1).parquet(path)
    regions = stream_regions(stream, latest, 6, 40.0, 30, chunk_ms)
    query = regions.writeStream.foreachBatch(check).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert not wrong and len(checked) == len(parts) and max(checked) > 1


def test_a_new_record_changes_few_entries(spark, tmp_path):
    path = str(tmp_path / "in")
    times(spark, range(0, 20_000, 10)).coalesce(1).write.parquet(path)
    times(spark, [20_000]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(TRACE_DDL).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream_regions(stream, 5000, 4, 40.0, 30, 100).writeStream.foreachBatch(lambda b, i: b.count()) \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    # one chunk of records, at most three of clusters, the expiry and its timer
    assert written[0] > 300 and written[1] <= 8, written
