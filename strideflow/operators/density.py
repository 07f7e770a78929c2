"""Density clustering of one time chunk of a stream: neighbours, cores and local components, for a grid of parameters.

A chunk comes with the records of twice the longest reach in time on both sides. So the cores among its own records and
those within one reach of it (the *zone*) are known exactly, and so is every link between them. Components are
local to the zone and named by their smallest core time; neighbouring chunks agree on the cores around their border, and
these *claims* say which local components are one.

Pairs within reach are taken in blocks, each of many records at once, and measured once: what is kept of a pair is one bit for
each row of the grid. Work follows the neighbours in time, memory the records and those bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EARTH_DIAMETER_M = 2 * 6371.0 * 1000.0
# Pairs of a block, where one record has not more.
BLOCK_PAIRS = 1 << 18


def metres(lat: np.ndarray, lng: np.ndarray, cos_lat: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    half_lat, half_lng = np.sin((lat[j] - lat[i]) / 2), np.sin((lng[j] - lng[i]) / 2)
    h = half_lat * half_lat + half_lng * half_lng * cos_lat[i] * cos_lat[j]
    return EARTH_DIAMETER_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def pairs_in_reach(ts: np.ndarray, reach_ms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices ``(i, j)`` with ``0 < ts[j] - ts[i] < reach_ms`` of distinct ascending times, in blocks by ``i``."""
    later = np.searchsorted(ts, ts + reach_ms) - np.arange(1, len(ts) + 1)
    total, first = np.concatenate([[0], np.cumsum(later)]), 0
    while first < len(ts):
        last = max(int(np.searchsorted(total, total[first] + BLOCK_PAIRS, "right")) - 1, first + 1)
        if total[last] > total[first]:
            i = np.repeat(np.arange(first, last), later[first:last])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[first:last] - total[first], later[first:last])
        first = last


def _merge(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after linking the pairs; each is named by its smallest index.

    Of every pair the larger name goes under the smaller one, until no pair has two names: each round leaves at most half.
    """
    name = np.arange(len(component))
    while len(a):
        np.minimum.at(name, np.maximum(a, b), np.minimum(a, b))
        while (up := name[name]).tobytes() != name.tobytes():
            name = up
        a, b = name[a], name[b]
        differs = a != b
        a, b = a[differs], b[differs]
    return name[component]


class Chunk:
    """The distinct moments of a chunk with its halo, in ascending time."""

    def __init__(self, ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, start: int, end: int, reach_ms: int):
        self.ts, self.lat, self.lng = ts, np.radians(lat), np.radians(lng)
        self.cos_lat = np.cos(self.lat)
        self.own = (ts >= start) & (ts < end)
        self.zone = (ts >= start - reach_ms) & (ts < end + reach_ms)
        self.shared = self.zone & ((np.abs(ts - start + 0.5) < reach_ms) | (np.abs(ts - end + 0.5) < reach_ms))
        self.reach_ms = reach_ms

    def near(self, i: np.ndarray, j: np.ndarray, grid: list[tuple[int, float, int]]) -> list[np.ndarray]:
        """Which of the pairs are neighbours, for each row of the grid."""
        apart, gap = metres(self.lat, self.lng, self.cos_lat, i, j), self.ts[j] - self.ts[i]
        return [(apart < distance) & (gap < ms) for _, distance, ms in grid]

    def clusters(self, grid: list[tuple[int, float, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each ``(min_points, metres, ms)``: cores, the component of each, and pairs ``(record, component)`` of border records."""
        n, every = len(self.ts), range(len(grid))
        counts = np.zeros((len(grid), n), np.int64)
        bits: list[list[np.ndarray]] = []
        for i, j in pairs_in_reach(self.ts, self.reach_ms):
            near = self.near(i, j, grid)
            bits.append([np.packbits(near[g]) for g in every])
            for g in every:
                counts[g] += np.bincount(i[near[g]], minlength=n) + np.bincount(j[near[g]], minlength=n)
        core = [(counts[g] >= grid[g][0]) & self.zone for g in every]
        component = [np.arange(n) for _ in every]
        border: list[list[np.ndarray]] = [[] for _ in every]
        # A chain of linked neighbours in rank is one run.
        before, after = np.arange(n - 1), np.arange(1, n)
        for g, near in enumerate(self.near(before, after, grid) if any(c.any() for c in core) else ()):
            chained = np.concatenate([[False], near & core[g][:-1] & core[g][1:]])
            component[g] = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
        for second in (False, True):
            # First the links between cores; then, with the components known, what lies beside them.
            for (i, j), block in zip(pairs_in_reach(self.ts, self.reach_ms), bits):
                for g in every:
                    if not core[g].any():
                        continue
                    near = np.unpackbits(block[g], count=len(i)).astype(bool)
                    if second:
                        for a, b in ((i, j), (j, i)):
                            beside = near & core[g][b] & ~core[g][a] & self.own[a]
                            if beside.any():
                                border[g].append(np.column_stack([a[beside], component[g][b[beside]]]))
                        continue
                    linked = near & core[g][i] & core[g][j]
                    a, b = component[g][i[linked]], component[g][j[linked]]
                    if (a != b).any():
                        component[g] = _merge(component[g], a[a != b], b[a != b])
        out = []
        for g in every:
            beside = np.unique(np.concatenate(border[g]), axis=0) if border[g] else np.zeros((0, 2), np.int64)
            out.append((core[g], component[g], beside[:, 0], beside[:, 1]))
        return out


def moments(ts: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records with a fix, one for each time (the smallest position of those that share it)."""
    given = ~(np.isnan(lat) | np.isnan(lng))
    ts, lat, lng = ts[given], lat[given], lng[given]
    order = np.lexsort((lng, lat, ts))
    ts, lat, lng = ts[order], lat[order], lng[order]
    first = np.ones(len(ts), bool)
    first[1:] = ts[1:] != ts[:-1]
    return ts[first], lat[first], lng[first]
