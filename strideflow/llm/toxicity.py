"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums over all common subsequences of three symbols, each weighted by ``DECAY`` per
character it spans, so characters may be inserted or left out; it is normalised to 1 for equal strings and sharpened by a
Gaussian. Words are compared by overlapping windows, so stems are found in inflected words. Punctuation inside a word is
a gap, and letters standing alone in a row ("i d i o t") are read as one word. A sentence is described by its
largest kernel with each of a few landmark strings, mapped by the inverse square root of the landmarks' own kernel matrix
(Nyström); a linear machine with hinge loss separates sentences, and a document has the margin of its worst
sentence, turned into a score by a logistic fit on documents that the machine did not see.

Landmarks are word beginnings whose presence speaks for the label, greedily chosen to cover the labelled documents, and a few
ordinary words. Labels are per document, so in a toxic document the sentences with a telling string are the positive
examples; their telling words are also learnt with characters inserted and left out. The negative examples are sentences of
other documents, among them those that the machine takes for the worst.
Everything is fitted on a bounded sample of those labelled documents that are in the table (``SAMPLE_DOCS``); every text is scored whole.

Defined results: null and empty texts have no sentence and get the score of a sentence without words; without both kinds
of label all scores are 0; rows without an id are scored and never learnt from; a document labelled twice is toxic if
one label says so, and of several texts with its id the shortest is learnt; repeated rows and equal texts are scored alike; a text of any
length is one step of its own, scored whole; further columns are ignored by the scores and kept by the filter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import filled, held_out, matching, release, share, shared, steps
from strideflow.session import stage

# The bounded sample: so many documents of each label, by the smallest hash of their id. Texts of at most SAMPLE_CHARS come
# first, then the shortest longer ones, whole, as long as a label's texts have SAMPLE_TEXT characters together (or one text).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TEXT = 2_000, 10_000, 30_000_000
LANDMARKS, ORDINARY, COVER, ALIKE = 40, 8, 3, 0.6
# Subsequences of three symbols within SPAN characters of a window of WINDOW characters.
DECAY, SPAN, WINDOW, GAMMA = 0.8, 6, 8, 4.0
STEMS = (5, 6)
PENALTY, EPOCHS, ROUNDS = 1e-4, 30, 3
THRESHOLD = 0.3
# Windows kept with their similarities between batches: about 20 MB in a task.
KNOWN_WINDOWS = 100_000
# Words compared at a time, and texts scored at a time.
WORDS_AT_ONCE, SCORE_BYTES = 10_000, 1_200_000

MARK, BEGIN, END = "\x01", "^", "$"
ALONE = r"(?:^|\s)\S(?:\x20\S){2,}(?:\s|$)"
ALONE_RUN = re.compile(r"(?:(?<=\s)|^)\S(?:\x20\S){2,}(?=\s|$)")


def symbols(strings: list[str]) -> np.ndarray:
    """Characters as numbers from 1 to 63, padded by 0 to the window: a-z, 0-9, the marks, others hashed."""
    flat = np.frombuffer("".join(s.ljust(WINDOW, "\0") for s in strings).encode("utf-32-le"), np.uint32)
    return np.where(flat < 128, ASCII[np.minimum(flat, 127)], 39 + flat % 25).astype(np.int32).reshape(-1, WINDOW)


def _ascii() -> np.ndarray:
    table = 39 + np.arange(128) % 25
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789" + BEGIN + END, 1):
        table[ord(c)] = i
    table[0] = 0
    return table


ASCII = _ascii()
# All subsequences of three places of a window that span at most SPAN, and their weights.
PLACES = np.array([
    (i, j, k) for i in range(WINDOW) for k in range(i + 2, min(WINDOW, i + SPAN)) for j in range(i + 1, k)
])
EXTRA = (PLACES[:, 2] - PLACES[:, 0] - 2).astype(np.int32)
WEIGHTS = (DECAY ** np.arange(3, SPAN + 1)).astype(np.float32)


def subsequences(x: np.ndarray) -> np.ndarray:
    """Per string and place triple a number made of the three symbols and the span; -1 where the string has ended."""
    i, j, k = (x[:, PLACES[:, c]] for c in range(3))
    return np.where(k > 0, (((i << 6 | j) << 6 | k) << 2) | EXTRA, -1)


def norms(keys: np.ndarray) -> np.ndarray:
    """The kernel of each string with itself: squares of the summed weights of equal subsequences."""
    rows = np.sort(keys, axis=1)
    flat = rows.ravel()
    weight = np.where(flat >= 0, WEIGHTS[flat & 3], 0)
    start = np.ones(rows.shape, bool)
    start[:, 1:] = (rows[:, 1:] >> 2) != (rows[:, :-1] >> 2)
    at = np.flatnonzero(start.ravel())
    sums = np.add.reduceat(weight, at)
    return np.bincount(at // rows.shape[1], weights=sums * sums, minlength=len(rows))


class Landmarks:
    """Landmark strings with a table from subsequence to its weight in each of them."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        keys = subsequences(symbols(strings))
        self.norms = norms(keys)
        found, self.row_of = np.unique(keys[keys >= 0] >> 2), np.zeros(1 << 18, np.int32)
        self.row_of[found] = np.arange(1, len(found) + 1)
        self.weights = np.zeros((len(found) + 1, len(strings)), np.float32)
        for z, row in enumerate(keys):
            row = row[row >= 0]
            np.add.at(self.weights[:, z], self.row_of[row >> 2], WEIGHTS[row & 3])

    def similarity(self, strings: list[str]) -> np.ndarray:
        """The normalised subsequence kernel of each string with each landmark."""
        return self.compare(symbols(strings))

    def compare(self, x: np.ndarray) -> np.ndarray:
        """The same for strings given by their symbols."""
        out = np.zeros((len(x), len(self.strings)), np.float32)
        for a in range(0, len(x), 8192):
            keys = subsequences(x[a:a + 8192])
            own = norms(keys)
            at = np.where(keys >= 0, self.row_of[keys >> 2], 0)
            rows, cols = np.nonzero(at)
            if len(rows):
                terms = WEIGHTS[keys[rows, cols] & 3][:, None] * self.weights[at[rows, cols]]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                out[a + rows[first]] = np.add.reduceat(terms, first, axis=0)
            out[a:a + len(keys)] /= np.sqrt(np.maximum(own[:, None] * self.norms[None], 1e-12))
        return out


def sharpened(similarity: np.ndarray) -> np.ndarray:
    """A Gaussian of the distance in the kernel's feature space: chance likeness of ordinary words fades."""
    return np.exp(-GAMMA * (1 - similarity))


def windows(word: str) -> list[str]:
    """The marked word or its overlapping windows, and its short beginnings, where a stem stands without its endings.

    Characters other than letters and digits are gaps, not symbols.
    """
    marked = BEGIN + "".join(c for c in word if c.isalnum()) + END
    if len(marked) <= WINDOW:
        whole = [marked]
    else:
        last = len(marked) - WINDOW
        whole = [marked[a:a + WINDOW] for a in [*range(0, last, 2), last]]
    return whole + [marked[:n] for n in STEMS if n < len(marked) - 1]


def window_symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all ``windows`` of each word, one after the other, and how many each word has."""
    plain = pc.replace_substring_regex(pa.array(words, pa.string()), r"[^\pL\pN]", "").to_pylist()
    flat = np.frombuffer("".join([f"{BEGIN}{w}{END}" for w in plain] + ["\0" * WINDOW]).encode("utf-32-le"), np.uint32)
    flat = np.where(flat < 128, ASCII[np.minimum(flat, 127)], 39 + flat % 25).astype(np.int32)
    size = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    start = np.cumsum(size) - size
    # the windows at 0, 2, 4 ... and the last one, then the short beginnings
    last = np.maximum(size - WINDOW, 0)
    sliding = (last + 1) // 2 + 1
    stems = [(n < size - 1).astype(np.int64) for n in STEMS]
    count = sliding + sum(stems)
    word = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    stem = place - sliding[word]
    at = np.where(stem < 0, np.minimum(2 * place, last[word]), 0)
    # a word has the second stem only if it has the first
    length = np.where(stem < 0, np.minimum(size[word] - at, WINDOW), np.array(STEMS)[np.maximum(stem, 0)])
    places = np.arange(WINDOW)
    inside = places < length[:, None]
    return np.where(inside, flat[(start[word] + at)[:, None] + places], 0), count


def kernels(words: list[str], landmarks: Landmarks, known: KnownWindows | None = None) -> np.ndarray:
    """The sharpened kernel of each word's best window with each landmark."""
    out = np.zeros((len(words), len(landmarks.strings)), np.float32)
    for a in range(0, len(words), WORDS_AT_ONCE):
        x, count = window_symbols(words[a:a + WORDS_AT_ONCE])
        best = np.maximum.reduceat(window_similarity(x, landmarks, known), np.cumsum(count) - count, axis=0)
        out[a:a + WORDS_AT_ONCE] = sharpened(best)
    return out


@dataclass
class KnownWindows:
    """Similarities of windows met before, by their symbols packed into one number; a bounded number of them."""

    packed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray | None = None


def window_similarity(x: np.ndarray, landmarks: Landmarks, known: KnownWindows | None) -> np.ndarray:
    """The similarity of each window with each landmark; equal windows are compared once."""
    packed = np.zeros(len(x), np.int64)
    for c in range(WINDOW):
        packed = packed << 6 | x[:, c]
    distinct, first, place = np.unique(packed, return_index=True, return_inverse=True)
    if known is None:
        return landmarks.compare(x[first])[place]
    rows = np.empty((len(distinct), len(landmarks.strings)), np.float32)
    at = np.searchsorted(known.packed, distinct)
    met = np.zeros(len(distinct), bool)
    there = np.flatnonzero(at < len(known.packed))
    met[there] = known.packed[at[there]] == distinct[there]
    if met.any():
        rows[met] = known.rows[at[met]]
    if not met.all():
        rows[~met] = landmarks.compare(x[first[~met]])
        if len(known.packed) + int((~met).sum()) <= KNOWN_WINDOWS:
            merged = np.concatenate([known.packed, distinct[~met]])
            order = np.argsort(merged)
            known.rows = np.concatenate([rows[:0] if known.rows is None else known.rows, rows[~met]])[order]
            known.packed = merged[order]
    return rows[place]


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased words of all texts as indices into a list of distinct ones, -1 at sentence ends, and text offsets."""
    texts = pc.utf8_lower(texts)
    if alone := matching(texts, ALONE):
        plain = texts.to_pylist()
        for i in alone:
            plain[i] = ALONE_RUN.sub(lambda m: m[0].replace(" ", ""), plain[i])
        texts = pa.array(plain, pa.string())
    texts = pc.replace_substring_regex(texts, r"[.!?]+(\s|$)|\n", f" {MARK} ")
    lists = pc.split_pattern_regex(texts, r"\s+")
    flat = lists.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False)
    raw = pc.fill_null(flat.dictionary, "")
    words = pc.replace_substring_regex(raw, r"^[^\pL\pN]+|[^\pL\pN]+$", "").to_pylist()
    mark = pc.index(raw, MARK).as_py()
    index = np.where(index == mark, -1, index) if mark >= 0 else index
    return index, words, np.asarray(lists.offsets)


def pooled(index: np.ndarray, kernel: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The largest kernel with each landmark in ``index[a:b]`` of consecutive bounds; zero where there is no word."""
    out = np.zeros((len(bounds) - 1, kernel.shape[1]), np.float32)
    zero = np.vstack([kernel, np.zeros((1, kernel.shape[1]), np.float32)])  # row -1
    filled_rows = np.flatnonzero(np.diff(bounds) > 0)
    for a in range(0, len(filled_rows), 4096):
        rows = filled_rows[a:a + 4096]
        start, stop = bounds[rows[0]], bounds[rows[-1] + 1]
        out[rows] = np.maximum.reduceat(zero[index[start:stop]], bounds[rows] - start, axis=0)
    return out


def sentence_bounds(index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts after each sentence end and at each text; and the number of the first sentence of each text."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(index == -1) + 1]))
    return cuts, np.searchsorted(cuts, offsets)


@dataclass
class Model:
    landmarks: Landmarks
    mapping: np.ndarray  # from pooled kernels to Nyström features, then to a margin
    bias: float
    slope: float
    offset: float
    known: KnownWindows = field(default_factory=KnownWindows)

    def margins(self, texts: pa.Array) -> np.ndarray:
        index, words, offsets = tokens(texts)
        bounds, first = sentence_bounds(index, offsets)
        values = pooled(index, kernels(words, self.landmarks, self.known), bounds) @ self.mapping + self.bias
        out = np.full(len(texts), self.bias, np.float64)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            out[some] = np.maximum.reduceat(values, first[some])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def beginnings(word: str) -> set[str]:
    """The word's first window cut after four or more letters, or the whole of a shorter word."""
    first = windows(word)[0]
    return {first, *(first[:b] for b in range(min(STEMS), len(first)))} if len(first) > 4 else set()


def choose_landmarks(texts: pa.Array, labels: np.ndarray) -> tuple[list[str], list[float]]:
    """Word beginnings that together cover the labelled documents, then ordinary words.

    Greedy: the next one is that which speaks most for the label in documents not covered ``COVER`` times yet. Returned
    with the lower end of its log odds, so that rare strings do not count as certain.
    """
    index, words, offsets = tokens(texts)
    parts = [beginnings(w) for w in words]
    holders: dict[str, list[int]] = {}
    without, usual = Counter(), Counter()
    for i, label in enumerate(labels):
        seen: set[str] = set()
        for k in np.unique(index[offsets[i]:offsets[i + 1]]):
            if k >= 0:
                seen |= parts[k]
                usual[words[k]] += 1
        if label:
            for s in seen:
                holders.setdefault(s, []).append(i)
        else:
            without.update(seen)
    n, m = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def telling(s: str) -> float:
        a, b = len(holders.get(s, ())), without[s]
        odds = np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (m + 1))
        return float(odds - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))

    value = {s: telling(s) for s, h in holders.items() if len(h) >= 3}
    best = sorted((s for s in value if value[s] > 1), key=lambda s: (-value[s] * len(holders[s]), -len(s), s))[:4000]
    held = {s: np.array(holders[s]) for s in best}
    need = np.full(len(labels), COVER)
    chosen: list[str] = []
    while held and len(chosen) < LANDMARKS - ORDINARY:
        open_docs = {s: int((need[h] > 0).sum()) for s, h in held.items()}
        s = max(held, key=lambda s: (value[s] * open_docs[s], len(s), s))
        if open_docs[s] < 3:
            break
        need[held[s]] -= 1
        chosen.append(s)
        names = list(held)
        alike = Landmarks([s]).similarity(names)[:, 0]
        held = {t: held[t] for t, k in zip(names, alike) if k <= ALIKE and s not in t and t not in s}
    weights = [value[s] for s in chosen]
    for w, _ in usual.most_common(400):
        if len(w) >= 5 and len(chosen) - len(weights) < ORDINARY and telling(w) <= 0:
            chosen.append((BEGIN + w + END)[:WINDOW])
    return chosen, weights


def disguises(word: str, random: np.random.Generator) -> list[str]:
    """The word with characters inserted everywhere, with one inserted, and with one left out."""
    filler = "*-._x1"
    c = filler[random.integers(len(filler))]
    at = int(random.integers(1, max(2, len(word))))
    out = [c.join(word), word[:at] + c + word[at:]]
    return out + ([word[:at] + word[at + 1:]] if len(word) > 5 else [])


def train_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss and balanced classes, by averaged stochastic subgradients."""
    random = np.random.default_rng(0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, b, mean_w, mean_b, step, kept = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0, 0
    for epoch in range(EPOCHS):
        for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            rate = 1 / (PENALTY * step + 1)
            bad = part[y[part] * (x[part] @ w + b) < 1]
            g = weight[bad] * y[bad]
            w = (1 - rate * PENALTY) * w + rate * (g @ x[bad]) / len(part)
            b += rate * g.sum() / len(part)
            if epoch >= EPOCHS // 2:
                kept += 1
                mean_w += w
                mean_b += b
    return mean_w / kept, mean_b / kept


def logistic_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of ``P(label | margin)`` by damped Newton steps, with Platt's softened targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model | None:
    """Fit on a bounded list of documents; ``share`` is the share of toxic documents among all labelled ones."""
    if not labels.any() or labels.all():
        return None
    docs = pa.array(texts, pa.string())
    held = np.arange(len(texts)) % 4 == 3
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    learn = np.flatnonzero(~held)
    part, y = docs.take(pa.array(learn)), labels[learn]
    strings, weights = choose_landmarks(part, y)
    if not weights:
        return None
    landmarks = Landmarks(strings)
    index, words, offsets = tokens(part)
    kernel = kernels(words, landmarks)
    worth = (kernel[:, :len(weights)] * np.array(weights, np.float32)).max(axis=1)
    bounds, first = sentence_bounds(index, offsets)
    x = pooled(index, kernel, bounds)
    value = pooled(index, worth[:, None], bounds)[:, 0]
    root = np.linalg.eigh(sharpened(landmarks.similarity(strings)).astype(np.float64) + 1e-3 * np.eye(len(strings)))
    nystrom = root[1] @ np.diag(1 / np.sqrt(np.maximum(root[0], 1e-3))) @ root[1].T
    # Positive examples: in toxic documents the sentences with a telling string, or else the most telling one.
    telling = worth > 0.6 * np.median(weights)
    random = np.random.default_rng(0)
    rows, made, clean = [], [], set()
    for i, label in enumerate(y):
        own = np.arange(first[i], first[i + 1])
        if not len(own):
            continue
        if not label:
            clean |= {int(own[np.argmax(value[own])]), int(own[random.integers(len(own))])}
            continue
        picked = own[value[own] > 0.6 * np.median(weights)]
        rows += picked.tolist() or [int(own[np.argmax(value[own])])]
        for r in picked:
            inside = index[bounds[r]:bounds[r + 1]]
            for k in {int(k) for k in inside if k >= 0 and telling[k]}:
                made += disguises(words[k], random)
    if not rows or not clean:
        return None
    made = [made[i] for i in random.permutation(len(made))[:2 * len(rows)]]
    # Negative examples: a random sentence of each other document, and, round by round, the one that is worst so far.
    for _ in range(ROUNDS):
        others = sorted(clean)
        seen = [x[rows], x[others]]
        if made:
            # A disguised word stands in a sentence of other words.
            seen.append(np.maximum(kernels(made, landmarks), x[random.choice(others, len(made))]))
        signs = np.repeat([1, -1, 1], [len(rows), len(others), len(made)])
        w, b = train_machine(np.vstack(seen) @ nystrom, signs)
        margins = x @ (nystrom @ w) + b
        for i in np.flatnonzero((y == 0) & (np.diff(first) > 0)):
            clean.add(int(first[i] + np.argmax(margins[first[i]:first[i + 1]])))
    model = Model(landmarks, nystrom @ w, float(b), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else learn
    target = labels[check]
    rate = target.mean()
    weight = np.where(target > 0, share / rate, (1 - share) / (1 - rate))
    model.slope, model.offset = logistic_fit(model.margins(docs.take(pa.array(check))), target, weight)
    model.known = KnownWindows()
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Only the bounded sample comes to the driver."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels of documents that are there, each with the length of its text; texts are not moved for it.
    lengths = docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.length("text")).alias("length"))
    usable = stage(marked.join(lengths, "doc_id"), "labelled")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return None
    # Of each label by hash; where too few texts are short, the shortest of the long ones fill up.
    order = [F.greatest(F.col("length"), F.lit(SAMPLE_CHARS)), F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.where("toxic = 1").orderBy(*order).limit(SAMPLE_DOCS).union(
        usable.where("toxic = 0").orderBy(*order).limit(SAMPLE_DOCS)
    ).collect()  # at most 2 x SAMPLE_DOCS ids
    wanted, held = [], {0: 0, 1: 0}
    for row in sorted(picked, key=lambda r: r["length"]):
        if held[row["toxic"]] == 0 or held[row["toxic"]] + row["length"] <= SAMPLE_TEXT:
            held[row["toxic"]] += row["length"]
            wanted.append((row["doc_id"], row["toxic"]))
    kinds = ", ".join(f"{c} {usable.schema[c].dataType.simpleString()}" for c in ("doc_id", "toxic"))
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(wanted, kinds)), "doc_id")
        .groupBy("doc_id").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_DOCS).toPandas()
    )
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64), counts[1] / (counts[0] + counts[1]))


def score_column(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """The score of each text of ``docs``, from 0 to 1."""
    sent = share(docs.sparkSession, model)  # two dozen strings and numbers

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared(sent)
        for texts in batches:
            texts = filled(texts)
            out = np.zeros(len(texts))
            if model is not None:
                for a, b in steps(texts, SCORE_BYTES):
                    out[a:b] = model.scores(texts.slice(a, b - a))
                release()
            yield pa.array(out)
        model = None
        release()

    return scored(text)


def score(docs: DataFrame, labels: DataFrame, folds: int = 4) -> DataFrame:
    """Learn from labelled rows that are not held out, score all: doc_id, held_out, score, predicted."""
    model = train(docs.where(~held_out(folds)), labels.where(~held_out(folds)))
    scored = docs.select("doc_id", held_out(folds).alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4) -> DataFrame:
    """``docs`` without the documents that the score rejects; all columns stay."""
    model = train(docs.where(~held_out(folds)), labels.where(~held_out(folds)))
    return docs.where(score_column(docs, model) < THRESHOLD)
