"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks whose borders depend on nothing but the characters around
them, so a passage that documents share falls into the same chunks wherever it stands. A distinct chunk is encoded once
per task; its encoding keeps the words at both ends apart, because a cut may run through a word. Joins are repaired:
the pieces of a word on both sides of a cut, over as many chunks as it takes, are joined and encoded anew, so
that what stands between two white spaces is always encoded whole. The tokenizer never looks across white
space (its pre-tokenizer drops it, and no normalisation composes across it), so this agrees exactly
with encoding the whole text. Inside a chunk, distinct words are encoded once too.

A tokenizer that does look across white space (one that keeps blanks in its tokens, say) is found out by a few probes and
applied to whole texts, without chunks; one that keeps cases gets its words as they are.

Chunks are shared within a task, not across tasks: one table of distinct chunks for all would move every text through a
shuffle and its ids back, about three times the input. Memory in a task is bounded: both stores start anew when full.

Defined results: a null text counts as empty; an empty text has no ids, and the digests are those of nothing; equal texts have equal
digests; a text of any length is encoded whole, in steps of its own; repeated rows
and rows without an id are encoded like any other; further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strideflow.llm.common import filled, release, steps

# Rolling hash: a cut after a character where the hash of the last WINDOW characters ends in CUT_BITS zeros.
WINDOW, CUT_BITS = 16, 9
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Entries kept between batches in one task: about 15 and 30 MB.
CHUNKS_KEPT, WORDS_KEPT = 10_000, 150_000
# Texts encoded together.
BLOCK_BYTES = 2_500_000
GAPS = re.compile(r"[ \t\r\n]")
# Characters below U+0300 never compose with each other.
# Words, letter cases, marks and white spaces that a tokenizer is tried with.
PROBES = ("alpha Beta gamma", "one  two\tthree\nfour", "Hello, World. It's 12,5 % (x-y) Żółć ÉTÉ", " lead and trail ", "a.b c,d ... e")
NOT_PLAIN = r"[^\x00-\x{2ff}]|<\|"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cuts(text: str) -> list[int]:
    """End positions of the chunks of a text, in ascending order, the last one its length."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    # hash of [i - WINDOW, i) as the sum of code * BASE**(distance to the end), by differences of one running sum
    running = np.concatenate(([np.uint64(0)], np.cumsum(code * _powers(n, INVERSE), dtype=np.uint64)))
    rolled = (running[WINDOW:] - running[:-WINDOW]) * _powers(n + 1, BASE)[WINDOW:]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    found = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    out = found.tolist()
    if not out or out[-1] != n:
        out.append(n)
    return out


def plain(inner: pa.Array) -> pa.Array:
    """Text between white spaces with fewer distinct words and the same encoding.

    Where no character can compose with another and no special token can arise, ASCII letters are lower-cased, as the
    tokenizer does, and a full stop or comma after a letter at the end of a word, a token of its own, becomes a word.
    """
    inner = pc.replace_substring_regex(inner, r"[\t\r\n]", " ")
    lower = pc.replace_substring_regex(pc.ascii_lower(inner), r"([a-z])([.,]) ", r"\1 \2 ")
    return pc.if_else(pc.match_substring_regex(inner, NOT_PLAIN), inner, lower)


class Encoder:
    """Encodes texts word by word and chunk by chunk with one tokenizer; knows the text of each token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # What the chunks and ``plain`` take for granted is asked of the tokenizer itself.
        self.by_words = all(self._ids(t) == [i for w in t.split() for i in self._ids(w)] for t in PROBES)
        self.plain = all(self._ids(t) == self._ids(t.lower()) for t in PROBES) and all(
            self._ids(w + end) == [*self._ids(w), *self._ids(end)] for w in PROBES[0].split() for end in ".,"
        )
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, tuple] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_words(self, words: list[str]) -> None:
        """Encode the words that are not known yet; ids are kept as little-endian bytes."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words, new = {}, words
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(4 * len(x) for x in ids))
        self.words.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def learn_chunks(self, chunks: list[str]) -> None:
        """Store for each new chunk ``(first word, ids between, last word)``; no white space: ``(chunk, None, "")``."""
        if len(self.chunks) + len(chunks) > CHUNKS_KEPT:
            self.chunks = {}
        heads, inners, tails = [], [], []
        for chunk in dict.fromkeys(chunks):
            if chunk in self.chunks:
                continue
            gaps = GAPS.split(chunk, 1)
            if len(gaps) == 1:
                self.chunks[chunk] = (chunk, None, "")
                continue
            last = max(chunk.rfind(" "), chunk.rfind("\n"), chunk.rfind("\t"), chunk.rfind("\r"))
            heads.append((chunk, gaps[0]))
            inners.append(chunk[len(gaps[0]):last + 1])
            tails.append(chunk[last + 1:])
        if not heads:
            return
        between = pa.array(inners, pa.string())
        lists = pc.split_pattern(plain(between) if self.plain else pc.replace_substring_regex(between, r"[\t\r\n]", " "), " ")
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        distinct = words.dictionary.to_pylist()
        self.learn_words(distinct)
        each = list(map(self.words.__getitem__, distinct))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        # positions of the ids of all words, one after the other
        sizes = size[index]
        before = np.cumsum(sizes) - sizes
        at = np.repeat((np.cumsum(size) - size)[index] - before, sizes) + np.arange(sizes.sum())
        raw = flat[at].tobytes()
        ends = 4 * np.append(before, len(at))[np.asarray(lists.offsets)]
        for (chunk, head), tail, a, b in zip(heads, tails, ends.tolist(), ends[1:].tolist()):
            self.chunks[chunk] = (head, raw[a:b], tail)

    def joints(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word that touches a cut or an end of the text, whole, and the ids that follow it."""
        pending = ""
        for chunk in chunks:
            head, inner, tail = self.chunks[chunk]
            pending += head
            if inner is not None:
                yield pending, inner
                pending = tail
        yield pending, b""

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        chunked = []
        for text in texts:
            ends = cuts(text)
            chunked.append([text[a:b] for a, b in zip([0, *ends], ends)])
        self.learn_chunks(list(chain.from_iterable(chunked)))
        joined = [list(self.joints(chunks)) for chunks in chunked]
        self.learn_words(list({w for pairs in joined for w, _ in pairs}))
        for pairs in joined:
            yield b"".join(x for w, inner in pairs for x in (self.words[w], inner))

    def decode(self, ids: bytes) -> str:
        """As the tokenizer's own ``decode`` with special tokens: without a decoder it puts blanks between tokens."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is None:
            return " ".join(map(self.pieces.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False)


OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row per row of ``docs`` (doc_id, text).

    ``path`` names the tokenizer file on every machine; by default each task asks for the public one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or tokenizer_path())
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in steps(texts, BLOCK_BYTES):
                counts, ids_digests, text_digests = [], [], []
                for ids in encoder.encode(texts.slice(a, b - a).to_pylist()):
                    counts.append(len(ids) // 4)
                    ids_digests.append(hashlib.sha256(ids).hexdigest())
                    text_digests.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()),
                     pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        del encoder
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, {OUT}")
