import math
import zlib
from collections import Counter

import numpy as np

from strideflow.llm import lm
from strideflow.llm.trie import EliasFano, NgramTrie


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 100), (1000, 10**15), (3000, 2**63)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(values, str(tmp_path), f"x{n}-{top}")
        if n:
            assert (e.get(np.arange(n)) == values).all()
        ask = rng.integers(0, top + 5, 2000, dtype=np.uint64)
        at, equal = e.successor(ask)
        assert (at == np.searchsorted(values, ask)).all() and (equal == np.isin(ask, values)).all()


def test_trie_finds_exactly_what_it_holds(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(np.stack([rng.integers(0, 300, 3000), rng.integers(0, 90, 3000)], 1).astype(np.uint64), axis=0)
    values = rng.normal(size=len(pairs))
    trie = NgramTrie(pairs[:, 0], pairs[:, 1], values, str(tmp_path))
    known = {tuple(map(int, p)): v for p, v in zip(pairs, values)}
    contexts = np.arange(0, 320, dtype=np.uint64)
    words = np.tile(np.arange(95, dtype=np.uint64), len(contexts))
    found = trie.find(contexts, np.full(len(contexts), 95), words)
    width = (values.max() - values.min()) / 256
    for c, w, v in zip(np.repeat(contexts, 95), words, found):
        want = known.get((int(c), int(w)))
        assert np.isnan(v) if want is None else abs(v - want) <= width


def brute(rows):
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    learn = [t for t, h in zip(tokens, held) if not h]
    c, pairs = Counter(w for t in learn for w in t), Counter(p for t in learn for p in zip(["<b>", *t], t))
    n, v = sum(c.values()), len(c)
    for (d, _), t, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = sum(
            math.log10((pairs[a, w] + lm.STRENGTH * (c[w] + 1) / (n + v + 1)) / ((c[a] if a != "<b>" else len(learn)) + lm.STRENGTH))
            for a, w in zip(["<b>", *t], t))
        yield (str(d), h, len(t), sum(c[w] > 0 for w in t), n), base, score


def check(table, rows):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in lm.score(table).collect())
    want = sorted(brute(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert abs(g[1] - w[1]) < 1e-6 * max(1, abs(w[1]))
        assert abs(g[2] - w[2]) < 0.02 * max(1, abs(w[2])), (g, w)


def test_scores_equal_brute_force(docs_of, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "The", "of", "river", "stone", "Ünd", " x", "end", "begin"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60))) + "\n") for i in range(120)]
    check(docs_of(rows), rows)


def test_hot_contexts_are_split(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "HOT_CONTEXT", 10)
    rows = [(i, " ".join(f"the w{(i * k) % 17}" for k in range(30))) for i in range(40)]
    check(docs_of(rows), rows)


def test_odd_rows(odd, nothing):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.score(nothing).count() == 0
