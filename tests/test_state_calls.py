"""What the stream operators write to the state store and ask of it, and that distances are measured once."""

import numpy as np
from test_streaming import Feed, drained

from strideflow.operators import density
from strideflow.streaming.regions import Regions
from strideflow.streaming.segments import stream_windows


def test_open_records_are_few_state_entries(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([{"timestamp": t} for t in range(0, 200_000, 100)])
    out, state = drained(stream_windows(feed.stream(), delay="1 hour"), tmp_path)
    # all two thousand are open: two entries of records, the value and the timer, which is kept by time and by key
    assert not out and 0 < max(total for _, _, total in state) <= 6, state


def test_every_pair_is_measured_once(monkeypatch):
    rng, measured = np.random.default_rng(3), []
    ts = np.cumsum(rng.integers(1, 9, 3000))
    real = density.metres
    monkeypatch.setattr(density, "metres", lambda lat, lng, cos_lat, i, j: (measured.append(len(i)), real(lat, lng, cos_lat, i, j))[1])
    chunk = density.Chunk(ts, 47 + rng.normal(size=3000) * 1e-4, np.full(3000, 8.0), 0, int(ts[-1]) + 1, 60)
    chunk.clusters([(6, 40.0, 60)])
    pairs = sum(int(((ts[k:] - ts[:-k]) < 60).sum()) for k in range(1, 60))
    # once, and neighbours in rank once more for their chains
    assert sum(measured) <= pairs + 3000


def test_a_new_stream_is_not_asked_for_in_the_store():
    from helpers import random_streams
    import pandas as pd

    asked = []

    class State(dict):
        def iterator(self):
            asked.append("iterator")
            return iter(self.items())

        def updateValue(self, key, value):
            self[key] = value

        def get(self):
            return dict.get(self, "value")

        def update(self, value):
            self["value"] = value

    class Handle:
        def getMapState(self, *_):
            return State()

        getValueState = getMapState

        def registerTimer(self, _):
            pass

        def deleteTimer(self, _):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    rows = pd.DataFrame(random_streams(5, 1, 200, 9, 20.0)).assign(dominanthand=True)
    regions = Regions(6, 40.0, 30, 1000, 60, 10_000)
    regions.init(Handle())
    first = [len(x) for x in regions.handleInputRows(("u0", True), iter([rows[:150]]), Clock())]
    assert first == [150] and not asked
    assert [len(x) for x in regions.handleInputRows(("u0", True), iter([rows[150:]]), Clock())] == [200] and len(asked) == 2
