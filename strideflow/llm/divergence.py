"""Source divergence audit: how the word use of each source differs from the other sources of its language.

Terms are runs of characters that are neither ASCII control, blank, digit nor punctuation; only A-Z are lower-cased. Each language
keeps the ``V`` terms that at least ``least_documents`` of its documents hold. Every group (lang, source) and every
language gives each kept term ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))`` with ``N`` the sum of its counts, and
the divergence of two of them at a term is ``f = floor((p - q)**2 / (p + q))``. All arithmetic is exact.

Run-length columns. The sum of ``f`` over all kept terms is asked for every pair of sources, but most terms have the same few
small counts in both, so a column of counts is not walked term by term:

1. The vocabulary of a language is cut into shards by a hash of the term, so that a shard holds about ``SHARD`` counts.
2. A shard reorders its vocabulary so that terms with equal counts stand together: by the counts in the groups with most
   terms, then by a hash of the whole row of counts.
3. Each group's column is run-length encoded; ``p`` is calculated once per run. Counts of zero are runs like any other.
4. For a pair the run boundaries of both columns are intersected, and each piece adds ``f`` times its length.

Shards give one partial sum per pair, which are added up; term scores need one row each and leave a shard as its
highest ten per group. No column, vocabulary or language is ever in one task as a whole.

Defined results: null text, lang and source count as empty strings; a language without kept terms has the value 0 for each pair and
no term rows; a source that is alone in its language has no pair rows; equal values rank by the item's UTF-8 bytes; repeated
rows and rows without an id are documents of their own. A text of any length is read whole, in pieces of bounded size.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideflow.llm.common import release, steps
from strideflow.session import stage

SCALE = 10**9
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
# Counts in a shard: a few tens of megabytes in its task.
SHARD = 100_000
# Groups whose counts order the vocabulary of a shard before the hash does.
ORDERING_GROUPS = 6
# Distinct terms a task holds before it hands its counts on, and bytes of text that are split at a time.
TERMS_HELD, PIECE_BYTES = 300_000, 4_000_000

# Bytes that end a term become blanks, A-Z become a-z; bytes above 0x7F belong to letters and symbols beyond ASCII.
_FOLD = bytes(
    b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number at a time, in order."""
    raw = text.encode().translate(_FOLD)
    start = 0
    while start < len(raw):
        end = start + PIECE_BYTES
        if end < len(raw):
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[start:end].split()
        start = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents), summed within tasks only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    size = len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms,
                         pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                        ["lang", "source", "term", "n", "df"],
                    )
            held.clear()

        for batch in batches:
            texts, langs, sources = (batch.column(c) for c in ("text", "lang", "source"))
            for a, b in steps(texts):
                part = zip(*(c.slice(a, b - a).to_pylist() for c in (texts, langs, sources)))
                for text, lang, source in part:
                    n, df = held.setdefault((lang, source), (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for terms in pieces(text):
                        n.update(terms)
                        seen.update(terms)
                    df.update(seen)
                if sum(len(n) for n, _ in held.values()) > TERMS_HELD:
                    yield from handed_on()
        yield from handed_on()
        release()

    return _named(docs).mapInArrow(count, "lang string, source string, term string, n long, df long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``p`` of each count; exact for counts of any size, calculated once per distinct count."""
    distinct, at = np.unique(counts, return_inverse=True)
    p = [1 + SCALE * (int(c) + 2) // (total + 2 * terms) for c in distinct]
    return np.array(p, np.int64)[at]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))``; both are at most 10**9 + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def vocabulary_order(term: np.ndarray, group: np.ndarray, n: np.ndarray, n_terms: int) -> np.ndarray:
    """The place of each term so that terms with equal counts in the groups are neighbours."""
    entries = np.bincount(group)
    first = np.argsort(-entries, kind="stable")[:ORDERING_GROUPS]
    keys = []
    for g in first:
        column = np.zeros(n_terms, np.int64)
        mine = group == g
        column[term[mine]] = n[mine]
        keys.append(column)
    # a hash of the row of counts: equal rows get equal sums
    mixed = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    profile = np.zeros(n_terms, np.uint64)
    np.add.at(profile, term, mixed * np.uint64(0xA0761D6478BD642F))
    place = np.empty(n_terms, np.int64)
    place[np.lexsort((profile, *reversed(keys)))] = np.arange(n_terms)
    return place


def run_lengths(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of equal values and the value of each."""
    if not len(column):
        return np.zeros(0, np.int64), column
    ends = np.append(np.flatnonzero(np.diff(column)) + 1, len(column))
    return ends, column[ends - 1]


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the divergences of two run-length columns ``(ends, p)`` over the pieces that both boundaries cut."""
    ends = np.union1d(a[0], b[0])
    if not len(ends):
        return 0
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    return int((divergence(p, q) * np.diff(ends, prepend=0)).sum())


def _shard_values(groups: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all pairs and the highest terms of each group in one shard of one language."""
    if groups.empty:
        return pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": []})
    groups = groups.sort_values("source", ignore_index=True)
    sources = groups["source"].tolist()
    totals = [int(n) for n in groups["n_group"]]
    lang, n_kept, n_lang = groups["lang"].iloc[0], int(groups["n_kept"].iloc[0]), int(groups["n_lang"].iloc[0])
    group = pd.Index(sources).get_indexer(cells["source"])
    term, words = pd.factorize(cells["term"])
    n = cells["n"].to_numpy(np.int64)
    rows: list[tuple[str, str, str, int]] = []
    columns = []
    place = vocabulary_order(term, group, n, len(words)) if len(words) else np.zeros(0, np.int64)
    by_group = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by_group], np.arange(len(sources) + 1))
    q_term = shares(cells["n_term"].to_numpy(np.int64), n_lang, n_kept) if len(words) else np.zeros(0, np.int64)
    for g, source in enumerate(sources):
        mine = by_group[cuts[g]:cuts[g + 1]]
        column = np.zeros(len(words), np.int64)
        column[place[term[mine]]] = n[mine]
        ends, counts = run_lengths(column)
        columns.append((ends, shares(counts, totals[g], n_kept) if len(ends) else counts))
        if len(mine):
            p, q = shares(n[mine], totals[g], n_kept), q_term[mine]
            above = np.flatnonzero(p > q)
            value = divergence(p[above], q[above])
            if len(above) > TOP_TERMS:
                near = value >= np.partition(value, -TOP_TERMS)[-TOP_TERMS]
                above, value = above[near], value[near]
            best = sorted(zip((-value).tolist(), words[term[mine[above]]]))[:TOP_TERMS]
            rows += [(source, "term", word, -v) for v, word in best]
    for i, a in enumerate(sources):
        for j in range(i + 1, len(sources)):
            value = pair_value(columns[i], columns[j])
            rows += [(a, "pair", sources[j], value), (sources[j], "pair", a, value)]
    out = pd.DataFrame(rows, columns=["source", "part", "item", "value"])
    out.insert(0, "lang", lang)
    return out


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, shard: int = SHARD) -> DataFrame:
    """``docs`` (lang, source, text) in; lang, source, part, item, value, rank out."""
    counted = count_terms(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counted = stage(counted, "term-counts")
    kept = stage(
        counted.groupBy("lang", "term")
        .agg(F.sum("n").alias("n_term"), F.sum("df").alias("df"), F.count("*").alias("entries"))
        .where(F.col("df") >= least_documents).drop("df"),
        "kept-terms",
    )
    cells = stage(counted.drop("df").join(kept.drop("entries"), ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(
        F.count("*").alias("n_kept"), F.sum("n_term").alias("n_lang"),
        F.ceil(F.sum("entries") / F.lit(shard)).cast("int").alias("shards"),
    )
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = stage(
        _named(docs).select("lang", "source").distinct()
        .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill({"n_group": 0, "n_kept": 0, "n_lang": 0, "shards": 1}),
        "source-groups",
    )
    shards = groups.groupBy("lang").agg(F.max("shards").alias("shards"))
    columns = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    dealt = cells.join(shards, "lang").withColumn(
        "shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    ).drop("shards")
    keys = ["lang", "shard"]
    values = columns.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        _shard_values, "lang string, source string, part string, item string, value long"
    )
    summed = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
