"""Language-model scores from a bigram model in Elias-Fano tries.

Tokens are lower-cased words and one end per text. A block of documents is reduced to its distinct words and, per token, an
index into them, so what moves through Spark is one row per block and shard, not one per token, and a frequent word
is one entry of a block however often it occurs there.

1. Blocks are written. Their distinct words go to unigram shards (a range of the word's 64-bit hash), which add up the
   counts of the learnable documents over all blocks and answer each block with the counts of its words.
2. With the counts a block knows its base scores, and sends its distinct bigrams to bigram shards (a hash of the
   context). The followers of a very frequent context are dealt over as many shards as its count asks for.
3. A bigram shard adds up the counts, builds its trie of quantised smoothed probabilities and answers every bigram of
   every block; each block's answer is a sum per document with a bigram there, and the sums of all shards are added.

``p(w | v) = (c(v, w) + STRENGTH * p(w)) / (c(v) + STRENGTH)`` with ``p(w) = (c(w) + 1) / (N + V + 1)``, a proper
distribution over the known words and one unknown word; the context of the first token is a begin sign. Seen bigrams are read
from the trie (one of 256 values per shard), unseen ones follow from the counts of their words.
Within a context words are told apart by 32 bits of their hash.

Defined results: null and empty texts have one token, the end; rows without an id are learnt from; repeated rows are learnt
from as often as they occur; equal texts have equal scores; a text of any length is whole in a block, of its own if it is long. If nothing can be learnt, N is 0 and every token is unknown. An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import filled, held_out, release, steps
from strideflow.llm.trie import NgramTrie
from strideflow.session import stage

SEED = 42
BLOCK_BYTES = 12_000_000
SHARD_BYTES = 10_000_000  # text per shard: several shards to a task, so that tasks are alike
LEAST_SHARD_BITS = 5
STRENGTH = 4.0
# A context seen more often has its followers dealt over several shards.
HOT_CONTEXT = 1_000_000
# No word holds a blank, so these hashes are theirs alone.
END = xxhash.xxh64_intdigest(b" end", SEED)
BEGIN = xxhash.xxh64_intdigest(b" begin", SEED)
MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps([a if a.dtype.itemsize == 1 else _planes(a) for a in arrays], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _planes(a: np.ndarray) -> tuple[str, np.ndarray]:
    """The bytes of all numbers by place, which compress better than number by number."""
    return a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unpack(data: bytes) -> list[np.ndarray]:
    parts = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    return [
        np.ascontiguousarray(p[1].T).view(p[0]).ravel() if isinstance(p, tuple) else p for p in parts
    ]


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token an index into the distinct words, the hashes of those, and the number of tokens of each text.

    The last of the distinct words is the end.
    """
    lists = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(texts), r"[\t-\r]", " "), " ")
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    index = flat.indices.to_numpy(zero_copy_only=False)
    blank = words.index(b"") if b"" in words else -1
    keep = index != blank
    held = np.concatenate(([0], np.cumsum(keep)))
    sizes = np.diff(held[np.asarray(lists.offsets)])
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(texts) + int(sizes.sum()), len(words), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = index[keep]
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words] + [END], np.uint64)
    used, out = np.unique(out, return_inverse=True)
    return out, hashes[used], sizes + 1


def _blocks(kind: pa.DataType):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in steps(texts, BLOCK_BYTES):
                tokens, hashes, sizes = tokenize(texts.slice(a, b - a))
                held = batch.column("held_out").slice(a, b - a)
                small = np.uint16 if len(hashes) <= 1 << 16 else np.uint32
                # frequent words get small indices
                order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                data = pack(rank[tokens].astype(small), hashes[order], sizes.astype(np.int32),
                            held.to_numpy(zero_copy_only=False).astype(np.uint8))
                ids = batch.column("doc_id").slice(a, b - a)
                offsets = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(offsets, ids.cast(kind)), pa.array([data], pa.binary())],
                    ["block", "doc_ids", "data"],
                )
                number += 1

    return blocks


def _training(tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.repeat(held == 0, sizes)


def _by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted 64-bit keys with the same leading bits."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    for a, b in zip(first, [*first[1:], len(shard)]):
        yield int(shard[a]), slice(int(a), int(b))


def _word_messages(bits: int):
    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                tokens, hashes, sizes, held = unpack(data)
                counts = np.bincount(tokens[_training(tokens, sizes, held)], minlength=len(hashes))
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order].astype(np.uint32)
                rows = [(s, block, pack(hashes[part], counts[part])) for s, part in _by_shard(hashes, bits)]
                shards, blocks, payloads = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())],
                    ["shard", "block", "data"],
                )

    return messages


def _word_counts(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks, returned to each block in the order it asked; the totals ride on the first row."""
    parts = [unpack(d) for d in group["data"]]
    hashes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    distinct, place = np.unique(hashes, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])
    answers = [pack(a) for a in np.split(total[place], ends[:-1])]
    n, v = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    n[0], v[0] = total.sum(), (total > 0).sum()
    return pd.DataFrame({"block": group["block"], "shard": group["shard"], "data": answers, "n": n, "v": v})


def _bigram_messages(bits: int, n: int, v: int):
    """Base scores of a block (shard -1 and below) and its distinct bigrams by shard."""

    def messages(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = int(blocks["block"].iloc[0])
        tokens, hashes, sizes, held = unpack(blocks["data"].iloc[0])
        tokens = tokens.astype(np.int64)
        c = np.empty(len(hashes), np.int64)
        ordered = [unpack(d)[0] for _, d in sorted(zip(answers["shard"], answers["data"]), key=lambda x: x[0])]
        c[np.argsort(hashes)] = np.concatenate(ordered)
        ends = np.cumsum(sizes.astype(np.int64))
        starts = ends - sizes
        base = np.add.reduceat(np.log10((c[tokens] + 1) / (n + v + 1)), starts)
        known = np.add.reduceat((c[tokens] > 0).astype(np.int64), starts)
        rows = [(-1 - block, block, pack(base, known, sizes, held))]

        end = int(np.flatnonzero(hashes == np.uint64(END))[0])
        context = np.concatenate(([0], tokens[:-1]))
        context[starts] = len(hashes)  # begin: seen once per learnable document, as is the end
        names = np.append(hashes, np.uint64(BEGIN))
        seen = np.append(c, c[end])
        key = context * len(hashes) + tokens
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(first, len(key)))
        trained = np.add.reduceat(_training(tokens, sizes, held)[order].astype(np.int64), first)
        docs = np.repeat(np.arange(len(sizes)), sizes)[order]
        v1, w = key[first] // len(hashes), key[first] % len(hashes)
        word = hashes[w] & np.uint64(0xFFFFFFFF)
        split = (seen[v1] // HOT_CONTEXT + 1).astype(np.uint64)
        mixed = (names[v1] + (word % split)) * MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX
        # sorted by context and word, each bigram with its occurrences
        by = np.lexsort((word, mixed))
        occurrence = np.repeat(np.cumsum(times)[by] - np.cumsum(times[by]), times[by]) + np.arange(len(key))
        docs, mixed, word, times, trained = docs[occurrence], mixed[by], word[by].astype(np.uint32), times[by], trained[by]
        c1, c2 = seen[v1][by], c[w][by]
        until = np.concatenate(([0], np.cumsum(times)))
        small = np.uint16 if len(sizes) <= 1 << 16 else np.uint32
        for shard, part in _by_shard(mixed, bits):
            m = mixed[part]
            head = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            rows.append((shard, block, pack(
                m[head], np.diff(np.append(head, len(m))).astype(np.uint32), c1[part][head].astype(np.uint32),
                word[part], c2[part].astype(np.uint32), trained[part].astype(np.uint32), times[part].astype(np.uint32),
                docs[until[part.start]:until[part.stop]].astype(small), np.array([len(sizes)]),
            )))
        release()
        return pd.DataFrame(rows, columns=["shard", "block", "data"])

    return messages


def probability(pair: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: int, v: int) -> np.ndarray:
    return (pair + STRENGTH * (c2 + 1) / (n + v + 1)) / (c1 + STRENGTH)


def build(parts: list[list[np.ndarray]], n: int, v: int, folder: str) -> NgramTrie:
    """The trie of all bigrams with a learnable occurrence in the messages of one shard."""
    contexts = np.concatenate([np.repeat(p[0], p[1])[p[5] > 0] for p in parts])
    c1 = np.concatenate([np.repeat(p[2], p[1])[p[5] > 0] for p in parts])
    words, c2, pair = (np.concatenate([p[k][p[5] > 0] for p in parts]) for k in (3, 4, 5))
    order = np.lexsort((words, contexts))
    contexts, words = contexts[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])
    first = np.flatnonzero(new)
    pair = np.add.reduceat(pair[order].astype(np.int64), first) if len(first) else pair
    values = np.log10(probability(pair, c1[order][first], c2[order][first], n, v))
    return NgramTrie(contexts[first], words[first].astype(np.uint64), values, folder)


def _answers(n: int, v: int):
    def answers(group: pd.DataFrame) -> pd.DataFrame:
        if group["shard"].iloc[0] < 0:
            return group[["shard", "block", "data"]]
        out = []
        parts = [unpack(d) for d in group["data"]]
        with tempfile.TemporaryDirectory() as folder:
            trie = build(parts, n, v, folder)
            for contexts, counts, c1, words, c2, _, times, docs, n_docs in parts:
                value = trie.find(contexts, counts.astype(np.int64), words.astype(np.uint64))
                unseen = np.log10(probability(np.zeros(len(words)), np.repeat(c1, counts), c2.astype(np.int64), n, v))
                value = np.where(np.isnan(value), unseen, value)
                out.append(_sums(np.bincount(docs, weights=np.repeat(value, times), minlength=int(n_docs[0]))))
        answered = pd.DataFrame({"shard": group["shard"], "block": group["block"], "data": out})
        del parts, trie, value, unseen
        release()
        return answered

    return answers


def _sums(values: np.ndarray) -> bytes:
    """Sums of the documents of a block; only those that are not zero if they are few, so that answers follow the bigrams."""
    some = np.flatnonzero(values)
    if 2 * len(some) < len(values):
        return pack(values[some].astype(np.float32), some.astype(np.uint32))
    return pack(values.astype(np.float32))


def _documents(n: int):
    def documents(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        score = np.zeros(len(blocks["doc_ids"].iloc[0]))
        for shard, data in sorted(zip(answers["shard"], answers["data"]), key=lambda x: x[0]):
            if shard < 0:
                base, known, sizes, held = unpack(data)
            else:
                sums, *at = unpack(data)
                score[at[0] if at else slice(None)] += sums
        return pd.DataFrame({
            "doc_id": pd.Series(list(blocks["doc_ids"].iloc[0]), dtype=object), "held_out": held > 0,
            "n_tokens": sizes.astype(np.int64), "n_known": known, "train_tokens": n, "base_score": base, "score": score,
        })

    return documents


def score(docs: DataFrame, folds: int = 7) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) that are not held out, score all rows.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", held_out(folds).alias("held_out"))
    # The number of shards follows the text: one number for the driver.
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_SHARD_BITS, (int(held) // SHARD_BYTES).bit_length())
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.string()
    listed = "bigint" if kind.simpleString() == "bigint" else "string"
    blocks = stage(rows.mapInArrow(_blocks(arrow), f"block long, doc_ids array<{listed}>, data binary"), "blocks")
    asked = blocks.select("block", "data").mapInArrow(_word_messages(bits), "shard int, block long, data binary")
    counts = stage(
        asked.groupBy("shard").applyInPandas(_word_counts, "block long, shard int, data binary, n long, v long"),
        "word-counts",
    )
    n, v = (int(x or 0) for x in counts.agg(F.sum("n"), F.sum("v")).first())
    sent = blocks.select("block", "data").groupBy("block").cogroup(counts.select("block", "shard", "data").groupBy("block"))
    bigrams = sent.applyInPandas(_bigram_messages(bits, n, v), "shard long, block long, data binary")
    answered = bigrams.groupBy("shard").applyInPandas(_answers(n, v), "shard long, block long, data binary")
    result = blocks.select("block", "doc_ids").groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        _documents(n),
        f"doc_id {listed}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return result.withColumn("doc_id", F.col("doc_id").cast(kind))
