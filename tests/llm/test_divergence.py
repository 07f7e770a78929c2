import random
import re

import numpy as np
import pytest

from strideflow.llm import divergence as D
from strideflow.llm.queries import ORACLE

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least):
    """Every formula term by term in plain Python; rows are (text, lang, source)."""
    docs = [(TERM.findall((t or "").translate(UPPER)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        terms = {t for d in mine for t in d[0]}
        kept = sorted(t for t in terms if sum(t in d[0] for d in mine) >= least)
        sources = sorted({d[2] for d in mine})

        def p(members):
            counts = [sum(d[0].count(t) for d in members) for t in kept]
            total = sum(counts) + 2 * len(kept)
            return counts, [1 + 10**9 * (c + 2) // total for c in counts]

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        by = {s: p([d for d in mine if d[2] == s]) for s in sources}
        whole = p(mine)[1]
        for s in sources:
            pairs = [(sum(map(f, by[s][1], by[o][1])), o) for o in sources if o != s]
            top = [(f(a, q), t) for t, c, a, q in zip(kept, *by[s], whole) if c and a > q]
            key = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=key))]
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(sorted(top, key=key)[:10])]
    return sorted(out)


def table(spark, rows):
    full = [(i if i % 7 else None, t, lang, s, 3, "w") for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, term string")


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    words = ["Ab", "AB", "ab", "é", "É", "日本", "x1y", "o'neil", "z\x7fz", "Äb", "the"] + [f"w{c}{d}" for c in "abcdefgh" for d in "klmn"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(12)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "", None, "é"])))
    return rows + [("only here", "xx", "s1"), ("and there", "xx", "s2"), (None, "yy", "s1")]


@pytest.mark.parametrize(("least", "shard"), [(10, 100_000), (3, 7)])
def test_equals_brute_force(spark, least, shard):
    rows = corpus()
    out = D.audit(table(spark, rows), least, shard)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(rows, least)
    assert {r[2] for r in got if r[0] == "xx"} == {"pair"}


def test_equals_sql(spark):
    import duckdb

    rows = corpus(1)
    documents = table(spark, rows).toPandas()  # noqa: F841, read by name
    columns = "lang, source, part, item, value, rank"
    want = duckdb.sql(f"SELECT {columns} FROM ({ORACLE['op11_source_divergence']})").fetchall()
    assert sorted(want) == brute(rows, 10)


def test_run_lengths_and_pieces():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 3, (2, rng.integers(1, 40)))
        p, q = D.shares(a, int(a.sum()), len(a)), D.shares(b, int(b.sum()), len(b))
        runs = [(e, D.shares(v, int(c.sum()), len(c))) for c in (a, b) for e, v in [D.run_lengths(c)]]
        assert D.pair_value(*runs) == sum((x - y) ** 2 // (x + y) for x, y in zip(p.tolist(), q.tolist()))
    big = D.shares(np.array([10**15]), 10**15, 1)
    assert big.tolist() == [1 + 10**9 * (10**15 + 2) // (10**15 + 2)]


def test_the_order_of_the_vocabulary_shortens_the_runs():
    rng = np.random.default_rng(4)
    counts = rng.choice(5, (3, 2000), p=[0.6, 0.2, 0.1, 0.05, 0.05])
    group, term = np.nonzero(counts)
    place = D.vocabulary_order(term, group, counts[group, term], 2000)
    assert sorted(place) == list(range(2000))
    before = sum(len(D.run_lengths(c)[0]) for c in counts)
    after = 0
    for c in counts:
        moved = np.empty(2000, np.int64)
        moved[place] = c
        after += len(D.run_lengths(moved)[0])
    assert after < before / 10


def test_long_texts_are_read_whole(spark, monkeypatch):
    text = "Wort ünd " * 700_000
    assert sum(t.count(b"wort") for t in D.pieces(text)) == 700_000
    assert len(list(D.pieces(text))) > 1 and sum(map(len, D.pieces("x" * 9_000_000))) == 1
    rows = [(text, "de", "a")] + [("wort", "de", "b")] * 9
    got = {(r.source, r.part, r.item): r.value for r in D.audit(table(spark, rows)).collect()}
    assert got["a", "pair", "b"] == got["b", "pair", "a"] == 0 and len(got) == 2


def test_empty_table(spark, nothing):
    assert D.audit(nothing).count() == 0
