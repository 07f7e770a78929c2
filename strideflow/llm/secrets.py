"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by likelihood.

Three patterns give the base spans. Every other identifier-like token, of any length and any characters, is scored
with two first-order Markov models over its characters, one of random strings and one of ordinary words and
identifiers; the log-likelihood ratio alone decides, in all and a character. The labelled samples come from the corpus
itself: what the base patterns match are random strings; ordinary is everything else but long tokens with a digit or a
capital, which would vouch for themselves. Both models are counted over all texts; that of random strings is mixed half
and half with a uniform one, as the samples may all be of one kind.

Defined results: a null text counts as empty; an empty text has no spans and the digest of the empty
string; repeated rows and rows with a null id are scanned like any other; of spans that start together the kind listed first comes first;
texts of any length are scanned whole in about linear time; digits are scored like letters, so a long number can be a span. Further columns are ignored.
An empty table gives an empty result (the random model is then uniform).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import Covered, filled, matching, steps

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

# Tokens that are no samples of ordinary text: long ones with a digit or a capital. They are scored like all others.
DOUBTFUL = re.compile(r"(?=[a-z+/_=-]*[A-Z0-9])[A-Za-z0-9+/_=-]{16,}")

ANY_ASSIGN = r"(?i:passw|secret|token|api_?key)"
ANY_BASE = rf"{ANY_ASSIGN}|AKIA|[0-9a-f]{{32}}"
ANY_DOUBTFUL = "|".join(rf"[A-Za-z0-9+/_=-]{{{k}}}[A-Z0-9][A-Za-z0-9+/_=-]{{{15 - k}}}" for k in range(16))

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET)
# All characters but the full stop make tokens.
IN_TOKEN = SIZE - 1
CODE = np.full(256, SIZE, np.uint8)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE)
PAIRS = SIZE * SIZE


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three patterns, each leftmost and non-overlapping; failing matches are dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def samples(text: str) -> list[str]:
    """The random strings of the base spans: the assigned value, or the whole match."""
    out = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [m[0] for m in HEX.finditer(text)]


def transitions(data: bytes) -> np.ndarray:
    """How often each character of the alphabet follows each, over tokens of the alphabet."""
    code = CODE[np.frombuffer(data, np.uint8)].astype(np.int32)
    first, second = code[:-1], code[1:]
    inside = (first < SIZE) & (second < SIZE)
    return np.bincount(first[inside] * SIZE + second[inside], minlength=PAIRS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random, other, whole = np.zeros((3, PAIRS), np.int64)
    for batch in batches:
        texts = filled(batch.column(0))
        for a, b in steps(texts):
            part = texts.slice(a, b - a)
            for i in matching(part, ANY_BASE):
                random += transitions("\n".join(samples(part[i].as_py())).encode())
            for i in matching(part, ANY_DOUBTFUL):
                other += transitions("\n".join(DOUBTFUL.findall(part[i].as_py())).encode())
            whole += transitions("\n".join(part.to_pylist()).encode())
    used = np.flatnonzero(whole + random)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(random[used]), pa.array(np.maximum(whole - np.maximum(random, other), 0)[used])],
        ["pair", "random", "ordinary"],
    )


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition. Counts of all texts, summed by Spark; at most 68 x 68 rows come back."""
    counts = docs.select("text").mapInArrow(_count_batches, "pair int, random long, ordinary long")
    rows = counts.groupBy("pair").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).collect()
    tables = np.zeros((2, PAIRS))
    for row in rows:
        tables[:, row["pair"]] = row["random"], row["ordinary"]
    tables = tables.reshape(2, SIZE, SIZE)
    # Smoothed by as many characters as there are, dealt as they occur: a digit is rare after an unseen one too.
    usual = tables.sum(axis=1, keepdims=True) + 1
    tables += SIZE * usual / usual.sum(axis=2, keepdims=True)
    shares = tables / tables.sum(axis=2, keepdims=True)
    # Samples of one kind (all hexadecimal, say) must not rule out other random strings.
    shares[0] = (shares[0] + 1 / SIZE) / 2
    return (np.log(shares[0]) - np.log(shares[1])).reshape(-1)


def method_spans(text: str, ratio: np.ndarray, least: float, least_mean: float) -> list[tuple[int, int, int]]:
    """Tokens that the random model explains better, by ``least`` in all and ``least_mean`` a character."""
    data = text.encode()
    code = CODE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(code < IN_TOKEN, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    # A token of one character has no transition.
    longer = ends - starts > 1
    starts, ends = starts[longer], ends[longer]
    if not len(starts):
        return []
    scores = np.zeros(len(code))
    pairs = code[:-1].astype(np.int32) * SIZE + code[1:]
    # Transitions are summed from the first character of a token up to its last; what lies between tokens is left out.
    pairs[pairs >= PAIRS] = 0
    np.take(ratio, pairs, out=scores[:-1])
    sums = np.add.reduceat(scores, np.column_stack((starts, ends - 1)).reshape(-1))[::2]
    hits = np.flatnonzero((sums >= least) & (sums >= least_mean * (ends - starts - 1)))
    found, at, chars = [], 0, 0
    for a, b in zip(starts[hits].tolist(), ends[hits].tolist()):
        chars += len(data[at:a].decode())
        found.append((chars, 3, chars + b - a))
        chars, at = chars + b - a, b
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str, ratio: np.ndarray, least: float, least_mean: float, may_base: bool = True) -> tuple[list, list]:
    """Base spans, and all spans; a token that overlaps a base span adds nothing."""
    base = base_spans(text) if may_base else []
    more = method_spans(text, ratio, least, least_mean)
    if base and more:
        covered = Covered((s, e) for s, _, e in base)
        more = [x for x in more if not covered.overlaps(x[0], x[2])]
    return base, sorted(base + more)


def scan_secrets(docs: DataFrame, least: float = 12.0, least_mean: float = 0.6) -> DataFrame:
    """``docs`` (doc_id, text) in; doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans out, one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # 68 x 68 numbers, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = filled(batch.column("text"))
            n = len(texts)
            counts = np.zeros((4, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for a, b in steps(texts):
                part = texts.slice(a, b - a)
                may_base = set(matching(part, ANY_BASE))
                for i, text in enumerate(part.to_pylist()):
                    base, every = scan_text(text, ratio, least, least_mean, i in may_base)
                    if not every:
                        continue
                    for _, k, _ in every:
                        counts[k, a + i] += 1
                    digests[a + i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[a + i] = joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    )
