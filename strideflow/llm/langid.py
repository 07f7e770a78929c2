"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything that is not a letter becomes one blank, and n-grams of one to three characters are
hashed to ``DIMENSIONS`` features with sublinear term frequency. Document frequencies are counted over all learnable
documents. The weights are fitted on a bounded sample by FTRL-proximal with elastic-net penalties (the L1 part leaves
most weights at zero), and a temperature fitted on a held-back part of that sample calibrates the scores.

Defined results: a null text and a text without a letter get ``und`` and score 0; so does every text if nothing can be
learnt (no document with a language). Rows without an id are learnt from and predicted. Ties between
languages go to the first in alphabetical order. Repeated rows are predicted alike, and learnt from as often as they occur; texts of
any length are counted and predicted whole; further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideflow.llm.common import filled, held_out, release, share, shared, steps

UNKNOWN = "und"
DIMENSIONS = 1 << 14
ORDERS = 3
# The bounded sample: about so many documents of all languages, and about LANGUAGE_DOCS of each language at least (or all it has), by a
# hash of id and text. Of languages beyond MOST_LANGUAGES the most frequent are learnt. Texts of at most SAMPLE_CHARS
# characters come first; of a language that has too few of them the shortest longer ones are learnt too.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_DOCS, MOST_LANGUAGES = 6_000, 8_000, 100, 300
# Longer texts that fill up: so many of a language, and so many characters of all together.
LONG_DOCS, LONG_TEXT = 16, 20_000_000
CALIBRATION = 5  # every fifth document of the sample
ROWS = 64
# Per-coordinate step, and the elastic net.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 4
MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def normal(texts: pa.Array) -> pa.Array:
    """Lower-cased letters with single blanks between and around words."""
    return pc.utf8_lower(pc.replace_substring_regex(pc.binary_join_element_wise(" ", texts, " ", ""), r"\PL+", " "))


def features(text: str) -> np.ndarray:
    """The hashed feature of each n-gram of a normalised text, repeats included."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = []
    for n in range(1, ORDERS + 1):
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ code[k:len(code) - n + 1 + k]) * MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(DIMENSIONS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def count_rows(texts: list[str]) -> np.ndarray:
    """Counts of each feature in each text, dense, a few rows at a time."""
    parts = [features(t).astype(np.int64) + i * DIMENSIONS for i, t in enumerate(texts)]
    return np.bincount(np.concatenate(parts), minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of ``(1 + ln tf) * idf`` with length one."""
    x = np.zeros(counts.shape, np.float32)
    used = counts > 0
    x[used] = 1 + np.log(counts[used])
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Few normalised texts at a time, so that the dense counts stay small."""
    for a, b in steps(texts):
        plain = normal(texts.slice(a, b - a)).to_pylist()
        for k in range(0, len(plain), ROWS):
            yield a + k, plain[k:k + ROWS]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, texts in blocks(batch.column(0)):
            df += (count_rows(texts) > 0).sum(axis=0)
            n += len(texts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(DIMENSIONS + 1), pa.int32()), pa.array(np.append(df, n))], ["feature", "n"]
    )


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages, mostly zero
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax((weighted(count_rows(texts), self.idf) @ self.weights + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """FTRL-proximal: weights are the closed-form minimum of the summed gradients and an elastic net."""

    def __init__(self, shape: tuple[int, int]):
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self) -> np.ndarray:
        slack = np.abs(self.z) - L1
        return np.where(slack > 0, -np.sign(self.z) * slack / ((BETA + np.sqrt(self.n)) / ALPHA + L2), 0.0)

    def update(self, gradient: np.ndarray, weights: np.ndarray) -> None:
        squared = gradient * gradient
        sigma = (np.sqrt(self.n + squared) - np.sqrt(self.n)) / ALPHA
        self.z += gradient - sigma * weights
        self.n += squared


def fit(texts: list[str], labels: list[str], idf: np.ndarray) -> Model:
    """Weights and temperature from a bounded list of normalised texts."""
    languages = sorted(set(labels))
    k, y = len(languages), np.array([languages.index(x) for x in labels])
    rows = np.arange(len(texts))
    held = rows % CALIBRATION == CALIBRATION - 1
    train = rows[~held] if held.any() else rows
    # A row of ones at the end is the bias.
    ftrl = Ftrl((DIMENSIONS + 1, k))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(train), max(1, len(train) // ROWS)):
            x = np.hstack([weighted(count_rows([texts[i] for i in part]), idf), np.ones((len(part), 1), np.float32)])
            w = ftrl.weights()
            error = softmax(x @ w)
            error[np.arange(len(part)), y[part]] -= 1
            ftrl.update(x.T @ error, w)
    w = ftrl.weights()
    model = Model(languages, idf, w[:-1].astype(np.float32), w[-1], 1.0)
    check = rows[held]
    if len(check):
        margins = np.vstack([
            weighted(count_rows([texts[i] for i in check[a:a + ROWS]]), idf) @ model.weights + model.bias
            for a in range(0, len(check), ROWS)
        ])
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        losses = [-np.log(softmax(margins / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def train(docs: DataFrame) -> Model | None:
    """Learn from (text, lang) rows; None without any. Reads all rows for document frequencies."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.select("text").mapInArrow(_document_frequencies, "feature int, n long")
    df = np.zeros(DIMENSIONS + 1)
    for row in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # one row per feature
        df[row["feature"]] = row["n"]
    if not df[-1]:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    sample = _sample(rows, df[-1])
    return fit(normal(pa.array([t for t, _ in sample], pa.string())).to_pylist(), [x for _, x in sample], idf)


def _sample(rows: DataFrame, n: float) -> list[tuple[str, str]]:
    """Texts and languages of the bounded sample, in an order that depends on the rows alone."""
    short = F.length("text") <= SAMPLE_CHARS
    by_language = (
        rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short"))
        .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    )
    # Of each language a share of its rows by their hash; no task hands over more than its part.
    h = F.xxhash64("doc_id", "text")
    parts, long = [], []
    for r in by_language:
        want = max(SAMPLE_DOCS * r["n"] / n, min(LANGUAGE_DOCS, r["n"]))
        share_ = min(1.0, want / max(1, r["short"]))
        if share_ == 1 and r["n"] > r["short"] and r["short"] < LANGUAGE_DOCS:
            long.append((r["lang"], min(LONG_DOCS, LANGUAGE_DOCS - r["short"])))
        parts.append((r["lang"], int(share_ * (1 << 30))))
    spark = rows.sparkSession
    limits = F.broadcast(spark.createDataFrame(parts, "lang string, below long"))  # at most MOST_LANGUAGES rows
    chosen = rows.where(short).join(limits, "lang").where(F.pmod(h, F.lit(1 << 30)) < F.col("below"))
    most = 2 * SAMPLE_DOCS + 2 * LANGUAGE_DOCS * len(parts)  # far beyond what the shares give
    sample = chosen.select(h.alias("h"), "text", "lang").limit(most).collect()
    if long:
        few = F.broadcast(spark.createDataFrame(long, "lang string, wanted int"))  # at most MOST_LANGUAGES rows
        sizes = rows.where(~short).join(few, "lang").select("lang", "wanted", F.length("text").alias("size"), h.alias("h"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h"))
        nearest = sizes.withColumn("rank", rank).where((F.col("rank") <= LONG_DOCS) & (F.col("rank") <= F.col("wanted")))
        held, wanted = 0, []
        for r in sorted(nearest.collect(), key=lambda r: (r["rank"], r["size"], r["lang"])):  # the shortest of each language first
            if held == 0 or held + r["size"] <= LONG_TEXT:
                held += r["size"]
                wanted.append((r["lang"], r["h"]))
        picked = F.broadcast(spark.createDataFrame(wanted, "lang string, h long"))  # at most LONG_DOCS per language
        sample += rows.where(~short).withColumn("h", h).join(picked, ["lang", "h"]).select("h", "text", "lang").limit(len(wanted)).collect()
    return [(r["text"], r["lang"]) for r in sorted(sample, key=lambda r: (r["h"], r["lang"], r["text"]))]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    sent = share(docs.sparkSession, model)  # DIMENSIONS x languages

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared(sent)
        for texts in batches:
            texts = filled(texts)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None:
                for start, block in blocks(texts):
                    p = model.probabilities(block)
                    best = p.argmax(axis=1)
                    for i, text in enumerate(block):
                        if text.strip():
                            names[start + i], scores[start + i] = model.languages[best[i]], p[i, best[i]]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])
        release()

    return docs.select("doc_id", predicted("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def identify(docs: DataFrame, folds: int = 4) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(folds)).select("doc_id", "text", "lang"))
    kind = docs.schema["doc_id"].dataType
    return predict(docs, model).select(
        F.col("doc_id").cast(kind).alias("doc_id"), held_out(folds).alias("held_out"), "lang_pred", "score"
    )
