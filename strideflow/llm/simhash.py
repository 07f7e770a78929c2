"""SimHash near-duplicates: fingerprints of word shingles, linked by shard BK-trees within a Hamming radius.

1. Each text gets a 64-bit fingerprint; equal ones become one row, so copies cost one row.
2. Fingerprints are dealt to shards so that any two within the radius meet in one. The 64 bits are cut into blocks;
   two fingerprints that differ in at most ``radius`` bits agree in all blocks but ``radius``, so a table per
   choice of the remaining blocks, sharded by a prefix of their bits, brings them together. Blocks and prefix
   follow the number of fingerprints so that a shard holds about ``SHARD`` of them.
3. Each shard builds a BK-tree (children keyed by their integer distance to the parent) and answers its own
   fingerprints, following only edges within the radius of the distance met. A shard that holds more than ``SHARD``
   rows, because near copies agree in many bits, is cut into sub-shards: each tree is then sent to
   every block of queries, so no task holds more than two sub-shards, however many rows agree.
4. A task returns links that connect what it found, not all pairs. The links go through star rounds to components.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
rows without an id are linked and get the component id of the others, or null if none has an id; repeated rows stay
repeated. A bit that exactly half of the hashes have is not set; all fingerprints at the same distance are linked alike; texts of any
length are hashed whole, in bounded steps. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import filled, steps
from strideflow.operators.components import connected_components
from strideflow.session import stage

BITS = 64
SHARD = 1024
LEAF = 32
SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """Words are split at ASCII white space, A-Z lower-cased; a bit is set if over half the shingle hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(shingle, len(words)) - 1
    cuts = map(slice, starts[:len(words) - span].tolist(), ends[span:].tolist())
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, len(words) - span
    )
    bits = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 100_000):
        part = hashes[a:a + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = 4, column: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long; equal neighbours in a batch are hashed once."""

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = filled(texts)
            out = np.zeros(len(texts), np.uint64)
            for a, b in steps(texts):
                seen: dict[str, int] = {}
                for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    if text not in seen:
                        seen[text] = fingerprint(text, shingle)
                    out[i] = seen[text]
            yield pa.array(out.view(np.int64))

    return docs.withColumn(column, fingerprints("text"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """Nodes with children keyed by their distance to the node; up to ``LEAF`` values at the bottom stay together."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = self._grow(np.arange(len(values)))

    def _grow(self, members: np.ndarray):
        # Iterative, as near copies can make a long chain.
        holder: list = [None]
        todo = [(members, holder, 0)]
        while todo:
            members, parent, at = todo.pop()
            if len(members) <= LEAF:
                parent[at] = (None, members, None)
                continue
            node, rest = members[0], members[1:]
            d = distance(self.values[rest], self.values[node])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            children: list = [None] * (len(cuts) + 1)
            parent[at] = (node, d[np.concatenate(([0], cuts))].astype(np.int64), children)
            for k, part in enumerate(np.split(rest, cuts)):
                todo.append((part, children, k))
        return holder[0]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(query, member)`` within the radius, for many queries at once."""
        found_q: list[np.ndarray] = []
        found_m: list[np.ndarray] = []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (node, edges, children), asked = todo.pop()
            if node is None:
                if len(edges):
                    near = distance(queries[asked][:, None], self.values[edges][None, :]) <= radius
                    q, m = np.nonzero(near)
                    found_q.append(asked[q])
                    found_m.append(edges[m])
                continue
            d = distance(queries[asked], self.values[node]).astype(np.int64)
            hit = asked[d <= radius]
            found_q.append(hit)
            found_m.append(np.full(len(hit), node))
            for edge, child in zip(edges, children):
                follow = asked[np.abs(d - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_m)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is connected with over the pairs ``(a, b)``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def blocking(n: int, radius: int, shard: int = SHARD) -> list[list[tuple[int, int]]]:
    """Per table the ``(shift, bits)`` pieces whose values name a shard; one table without pieces for few rows.

    With ``m`` blocks a table keeps ``m - radius`` of them. More blocks give longer prefixes and more tables,
    so ``m`` is the smallest that can name enough shards.
    """
    want = max(0, math.ceil(math.log2(max(1, n / shard))))
    if want == 0:
        return [[]]
    for m in range(radius + 1, BITS + 1):
        edges = [BITS * i // m for i in range(m + 1)]
        widths = [b - a for a, b in zip(edges, edges[1:])]
        if sum(sorted(widths)[:m - radius]) >= want:
            break
    tables = []
    for kept in combinations(range(m), m - radius):
        left, pieces = want, []
        for i in kept:
            use = min(left, widths[i])
            if use:
                pieces.append((edges[i], use))
            left -= use
        tables.append(pieces)
    return tables


def _links_of_group(radius: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy().view(np.uint64)
        sub, i, j = group["sub"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        members, queries = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
        q, m = BKTree(values[members]).search(values[queries], radius)
        label = least_labels(len(values), queries[q], members[m])
        other = np.flatnonzero(label != np.arange(len(values)))
        a, b = values[other].view(np.int64), values[label[other]].view(np.int64)
        return pd.DataFrame({"hi": np.maximum(a, b), "lo": np.minimum(a, b)})

    return links


def near_links(distinct: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Links ``(hi, lo)`` that connect exactly those fingerprints that chains of pairs within the radius connect."""
    tables = blocking(distinct.count(), radius, shard)
    keys = []
    for t, pieces in enumerate(tables):
        key, left = F.lit(0).cast("long"), 0
        for shift, bits in pieces:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
            key = key.bitwiseOR(F.shiftleft(part, left))
            left += bits
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    large = dealt.groupBy("t", "key").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("subs")).where("subs > 1")
    dealt = dealt.join(large, ["t", "key"], "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    # Sub-shard i is a tree for the queries of each sub-shard j >= i; its rows go to all those pairs.
    other = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    dealt = dealt.select("fp", "t", "key", "sub", other.alias("o")).select(
        "fp", "t", "key", "sub", F.least("sub", "o").alias("i"), F.greatest("sub", "o").alias("j")
    )
    return dealt.groupBy("t", "key", "i", "j").applyInPandas(_links_of_group(radius), "hi long, lo long")


def labelled(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fp``, ``first_id`` (its smallest doc_id) and ``component`` (a fingerprint) for each fingerprint of ``fps`` (doc_id, fp)."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    joined = connected_components(near_links(distinct.select("fp"), radius), [])
    if joined is None:
        return distinct.withColumn("component", F.col("fp"))
    named = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    return named.withColumn("component", F.coalesce("component", "fp"))


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fp`` and ``component_id``, the smallest doc_id among all rows of ``fps`` (doc_id, fp) it is connected with."""
    named = labelled(fps, radius)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per row of ``docs`` (doc_id, text)."""
    fps = stage(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "document-fingerprints")
    return fps.join(components(fps, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    A component stays once, so an id stays once for each component its texts are in. Rows without an id come last and
    are kept where no row of the component has one. Of rows with the same id (or none) the smallest fingerprint stays,
    of those the smallest hash of the text.
    """
    columns = docs.columns
    # Written once, with the fingerprint of each text: hashing all shingles costs far more than reading a table again.
    numbered = with_fingerprint(docs, shingle, "near_fp").withColumn("near_row", F.monotonically_increasing_id())
    marked = stage(numbered, "marked-documents")
    fps = marked.select("doc_id", F.col("near_fp").alias("fp"))
    rank = F.struct(F.col("first_id").isNull(), "first_id", "fp")
    first = labelled(fps, radius).groupBy("component").agg(F.min(rank).alias("least")).select(F.col("least.fp").alias("near_fp"))
    # The row that stays is chosen among narrow rows, and its number, unique once written, picks it from the table.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "near_row")
    best = stage(marked.groupBy("near_fp").agg(F.min_by("near_row", order).alias("near_row"), F.count("*").alias("rows")), "best-rows")
    kept = stage(best.join(first.withColumn("stays", F.lit(True)), "near_fp", "left"), "kept-rows")
    contested = _bits(kept.where("rows > 1 OR stays IS NULL").select("near_fp"))
    # A row whose fingerprint no other row has, and no near one either, stays where it is; only the others move.
    sure = marked.where(~contested(marked["near_fp"])).select(*columns)
    moved = marked.where(contested(marked["near_fp"])).join(kept.where("stays").select("near_row").hint("merge"), "near_row", "left_semi")
    return sure.union(moved.select(*columns))


FILTER_BITS = 1 << 25


def _bits(fps: DataFrame):
    """A test that holds for every fingerprint of ``fps`` and for few others: a Bloom filter of fixed size (4 MB)."""

    def places(fp: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(fp, F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)]

    place = F.explode(F.array(*places(F.col("near_fp")))).alias("place")
    word = F.shiftright("place", 6).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    rows = fps.select(place).groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    sent = fps.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.arrow_udf("boolean")
    def inside(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = np.frombuffer(sent.value, np.uint64)
        for both in batches:
            found = np.ones(len(both[0]), bool)
            for p in both:
                at = p.to_numpy(zero_copy_only=False)
                found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            yield pa.array(found)

    return lambda fp: inside(*places(fp))
