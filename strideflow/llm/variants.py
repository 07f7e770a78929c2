"""Spelling variant grouping: words one edit apart, found through pivotal bigrams, and the frequent form of each.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. An audit rule deletes one code point of an
occurrence if 31 divides a CRC-32 of its document id and run. Kept are words of at least 7 code points that occur at least twice.
Two words are near if one inserted, deleted or replaced code point tells them apart.

Pivotal bigrams (Deng, Li and Feng, "A Pivotal Prefix Based Filtering Algorithm for String Similarity Search", 2014):

1. Bigrams are ordered by the number of words that hold them, rare ones first. There are at most 90 * 90 of them, whatever the
   corpus, so their order is shared with all tasks.
2. The prefix of a word is its first three bigrams in that order, at equal ranks from left to right. Two of them, disjoint and
   rarest together, are chosen by dynamic programming as its pivots.
3. One edit destroys at most one of two disjoint bigrams, so of two near words the one whose prefix ends earlier in the order has
   a pivot that stands in the other word, at a rank within its prefix.
4. Position limits: the edit lies to one side of the surviving pivot, so everything from the start of the word through the
   pivot is the same in both words, or everything from the pivot to the end. Pivots are indexed by a hash of each of these two
   sides and looked up by the same sides of the prefix bigrams of other words. A bigram that stands in a word many times is
   looked up at its first five places: a pivot is one of the first three, and an edit adds at most two before it.
5. A pivot near the start or end of its word leaves a short side that many words share. Words under such a key get longer ones:
   the edit leaves one half of what the key does not hold yet as it is, so each half is added to the key once.
6. Candidates are verified by their edit distance.

The frequent form of a word is its near word of largest ``n``, if that is at least ten times its own; ``n`` grows tenfold along a
chain of forms, so a number of pointer doublings that follows from the largest ``n`` reaches every root.

Defined results: null and empty texts have no words; a missing id counts as an empty one; repeated rows count again; equal ``n`` go
to the smallest word in code-point order. Texts of any length are read whole, in bounded steps. An empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import filled, release, steps
from strideflow.session import stage

LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
# For one edit and bigrams: three bigrams in a prefix, two of them pivots.
GRAM, PREFIX, PLACES = 2, 3, 5
# Longer words are not compared by the built-in edit distance, whose time grows with the square.
LONG_WORD = 1_000
# Keys that would make more pairs are made longer, so many times; each time halves what the key does not hold.
HOT_KEY, SPLITS = 1_000, 6
# Distinct words a task holds before it hands its counts on; words keyed at a time; characters split at a time.
WORDS_HELD, WORDS_KEYED, PIECE = 300_000, 20_000, 4_000_000

# In Latin-1 a byte is a code point: A-Z become a-z, other characters that end a run become blanks.
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text in Latin-1, a bounded number at a time."""
    raw = text.encode("latin-1", "replace").translate(_FOLD)
    start = 0
    while start < len(raw):
        end = start + PIECE
        if end < len(raw):
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[start:end].split()
        start = end


def audited(doc_id: str, run: bytes) -> bytes:
    """The run of one document, without the code point that the rule deletes."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), crc32(f"{doc_id}:".encode()))
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame) -> DataFrame:
    """word and n (occurrences), summed within tasks only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed_on() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            texts, ids = filled(batch.column("text")), filled(batch.column("doc_id"))
            for a, b in steps(texts):
                for text, doc_id in zip(texts.slice(a, b - a).to_pylist(), ids.slice(a, b - a).to_pylist()):
                    start = crc32(f"{doc_id}:".encode())
                    for part in runs(text):
                        for run, n in Counter(r for r in part if len(r) >= LEAST_LENGTH).items():
                            if crc32(run if run.isascii() else run.decode("latin-1").encode(), start) % EVERY == 0:
                                run = audited(doc_id, run)
                            held[run] = held.get(run, 0) + n
                if len(held) > WORDS_HELD:
                    yield handed_on()
                    held.clear()
        yield handed_on()
        held.clear()
        release()

    return docs.select("text", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(count, "word string, n long")


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and number of words of each bigram, rare ones first; at most 8,100 entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                held.update({word[i:i + GRAM] for i in range(len(word) - 1)})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    counts = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {g: (i, n) for i, (n, g) in enumerate(sorted((r.n, r.gram) for r in counts))}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Places of the first ``PREFIX`` bigrams in the order, places to look up, and the rank at which the prefix ends."""
    first = nsmallest(PREFIX, ((order[word[i:i + GRAM]][0], i) for i in range(len(word) - 1)))
    last = first[-1][0]
    grams = {word[i:i + GRAM] for _, i in first}
    places: dict[str, list[int]] = defaultdict(list)
    for i in range(len(word) - 1):
        gram = word[i:i + GRAM]
        if gram in grams and len(places[gram]) < PLACES:
            places[gram].append(i)
    return [i for _, i in first], [i for some in places.values() for i in some], last


def pivots(word: str, places: list[int], order: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """The two disjoint places whose bigrams are held by the fewest words together.

    From left to right, the best single bigram that ends before a place is carried along and joined with the one there.
    """
    ahead: list[tuple[int, int]] = []
    single, best = (math.inf, -1), (math.inf, -1, -1)
    for i in sorted(places):
        while ahead and ahead[0][1] <= i - GRAM:
            single = min(single, ahead.pop(0))
        cost = order[word[i:i + GRAM]][1]
        if single[1] >= 0:
            best = min(best, (single[0] + cost, single[1], i))
        ahead.append((cost, i))
    return best[1], best[2]


def _sides(word: str, i: int) -> tuple[int, int]:
    """Hashes of the word through the bigram at ``i``, and from it to the end; the place is part of both."""
    left, right = word[:i + GRAM], word[i:]
    return xxhash.xxh64_intdigest(f"<{left}"), xxhash.xxh64_intdigest(f">{right}")


# A row is looked up where ``asks``, is found where ``pivot``; ``lo`` and ``hi`` characters at its start and end are part of the key.
KEYED = "word string, n long, last int, pivot boolean, asks boolean, lo int, hi int, key long"


def _keyed_batch(words: pa.Array, n: pa.Array, rows: list[tuple[int, int, bool, bool, int, int, int]]) -> pa.RecordBatch:
    """``rows`` of (place of the word, last, pivot, asks, lo, hi, key)."""
    at, last, pivot, asks, lo, hi, key = zip(*rows) if rows else ((),) * 7
    take = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays(
        [words.take(take), n.take(take), pa.array(last, pa.int32()), pa.array(pivot, pa.bool_()), pa.array(asks, pa.bool_()),
         pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))],
        [c.split()[0] for c in KEYED.split(", ")],
    )


def keyed(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """A row per side of each prefix bigram of ``words`` (word, n), marked if the bigram is a pivot."""
    shared = words.sparkSession.sparkContext.broadcast(order)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_KEYED):
                part, rows = batch.slice(a, WORDS_KEYED), []
                for k, word in enumerate(part.column("word").to_pylist()):
                    first, places, end = prefix(word, known)
                    two = pivots(word, first, known)
                    for i in places:
                        left, right = _sides(word, i)
                        rows.append((k, end, i in two, True, i + GRAM, 0, left))
                        rows.append((k, end, i in two, True, 0, len(word) - i, right))
                yield _keyed_batch(part.column("word"), part.column("n"), rows)

    return words.select("word", "n").mapInArrow(keys, KEYED)


def halved(rows: DataFrame) -> DataFrame:
    """The same rows under longer keys: one edit leaves one half of what the key does not hold yet as it is.

    The row of a pivot gets the key of each half of its rest. A row that asks does not know how long the other word's
    rest is, so it asks for the halves of a rest that is a character shorter, as long, or one longer.
    """

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_KEYED):
                part, rows = batch.slice(a, WORDS_KEYED), []
                columns = (part.column(c).to_pylist() for c in ("word", "last", "pivot", "asks", "lo", "hi", "key"))
                for k, (word, last, pivot, asks, lo, hi, key) in enumerate(zip(*columns)):
                    rest = word[lo:len(word) - hi]
                    own = {(x, y) for x, y in [((len(rest) + 1) // 2, len(rest) // 2)] if pivot}
                    for role, some in (("pivot", own), ("asks", {((m + 1) // 2, m // 2) for m in range(len(rest) - 1, len(rest) + 2) if asks and m >= 0})):
                        for x in {x for x, _ in some if x <= len(rest)}:
                            h = xxhash.xxh64_intdigest(f"{key}<{rest[:x]}")
                            rows.append((k, last, role == "pivot", role == "asks", lo + x, hi, h))
                        for y in {y for _, y in some if y <= len(rest)}:
                            h = xxhash.xxh64_intdigest(f"{key}>{rest[len(rest) - y:]}")
                            rows.append((k, last, role == "pivot", role == "asks", lo, hi + y, h))
                yield _keyed_batch(part.column("word"), part.column("n"), rows)

    return rows.mapInArrow(halves, KEYED)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point tells the words apart; in about linear time."""
    if len(a) > len(b):
        a, b = b, a
    same, end = 0, len(a) + 1
    while end - same > 1:  # the length of what both start with
        middle = (same + end) // 2
        same, end = (middle, end) if a[same:middle] == b[same:middle] else (same, middle)
    if len(a) == len(b):
        return same < len(a) and a[same + 1:] == b[same + 1:]
    return len(b) == len(a) + 1 and a[same:] == b[same + 1:]


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs of words that share a key and may be near; long ones are not compared yet."""
    s, r = rows.where("pivot").alias("s"), rows.where("asks").alias("r")
    # Where both prefixes end at the same bigram each has a pivot in the other; one of them is enough.
    earlier = (F.col("s.last") < F.col("r.last")) | ((F.col("s.last") == F.col("r.last")) & (F.col("s.word") < F.col("r.word")))
    long = F.length("s.word") > LONG_WORD
    close = (
        (F.col("s.key") == F.col("r.key")) & earlier & (F.abs(F.length("s.word") - F.length("r.word")) <= 1)
        & F.when(long, True).otherwise(F.levenshtein(F.col("s.word"), F.col("r.word"), 1) == 1)
    )
    ends = [F.struct(f"{x}.word", f"{x}.n") for x in "sr"]
    return s.join(r, close).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), long.alias("long"))


def near_pairs(words: DataFrame, hot: int = HOT_KEY) -> DataFrame:
    """Each pair of near words once: a, n_a, b, n_b.

    Words under a key that would make more than ``hot`` pairs get longer keys, again and again.
    """
    rows = stage(keyed(words, gram_order(words)), "pivots")
    found = None
    for left in reversed(range(SPLITS + 1)):
        pairs = F.count_if("pivot") * F.count_if("asks")
        large = stage(rows.groupBy("key").agg(pairs.alias("pairs")).where(F.col("pairs") > hot).select("key"), "hot-keys")
        last = left == 0 or large.isEmpty()
        met = _meeting(rows if last else rows.join(large, "key", "left_anti"))
        found = met if found is None else found.union(met)
        if last:
            break
        rows = stage(halved(rows.join(large, "key", "left_semi").select(*rows.columns)), "halves")
    columns = [F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"), "long"]
    pairs = stage(found.distinct().select(*columns), "near-words")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(map(one_edit, batch.column("a").to_pylist(), batch.column("b").to_pylist()), pa.bool_()))

    checked = pairs.where("long").mapInArrow(verified, pairs.schema)
    return pairs.where("NOT long").union(checked).drop("long")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """word and root for each row of ``forms`` (word, form): the last word that its chain of forms reaches."""
    links = max(1, math.floor(math.log(max(largest, 1) / LEAST_COUNT, TIMES)) + 1)
    step = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(links + 1))):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stage(step.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return step


def group_variants(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in; word, form, root, n, n_near, form_n out, a row per word."""
    words = stage(
        count_words(docs).groupBy("word").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)),
        "words",
    )
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_other"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "near")).alias("best")
    )
    ten = -F.col("best.less") >= TIMES * F.col("n")
    formed = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(ten, F.col("best.near")).alias("form"), F.when(ten, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    changed = formed.where("form IS NOT NULL")
    largest = formed.agg(F.max("n")).first()[0] or 0
    return formed.join(roots(changed, largest), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
