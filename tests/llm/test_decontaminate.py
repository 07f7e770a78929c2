import random

from strideflow.llm import decontaminate as D

rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(n))) for i, n in enumerate((30, 45, 20, 60, 7, 3))]


def prose(n):
    return " ".join(rng.choice(["the", "of", "and", *VOCABULARY]) for _ in range(n))


def shingles(words):
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def best(text, item, items):
    """Largest weighted similarity of any window of the item's size, by trying all."""
    import math
    import re
    from collections import Counter

    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    a, b = shingles(cut(text)), shingles(cut(item))
    df = Counter(s for _, t in items for s in set(shingles(cut(t))))
    own, top = Counter(b), 0.0
    for start in range(-len(b) + 1, len(a)):
        window = Counter(a[max(0, start):max(0, start + len(b))])
        w = lambda s: math.log(1 + len(items) / (df[s] if s in own else 1))
        keys = set(window) | set(own)
        if window and b:
            top = max(top, sum(w(s) * min(window[s], own[s]) for s in keys) / sum(w(s) * max(window[s], own[s]) for s in keys))
    return top


def test_found_pairs_equal_brute_force(spark, docs_of):
    rows = [(i, prose(80)) for i in range(20)]
    for k, (i, t) in enumerate(ITEMS):
        words = t.split()
        rows.append((100 + k, f"{prose(40)} {t.upper()}. {prose(30)}"))
        rows.append((200 + k, t))
        changed = words[:len(words) // 2] + ["zzz"] + words[len(words) // 2:]
        rows.append((300 + k, f"{prose(10)} {' '.join(changed)} {prose(10)}"))
        rows.append((400 + k, f"{prose(10)} {' '.join(words[:-2])}"))
    benchmark = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, length int")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(docs_of(rows), benchmark).collect()}
    want = {(d, i): s for d, text in rows for i, t in ITEMS if (s := best(text, t, ITEMS)) >= 0.8}
    assert {(100 + k, k) for k in range(5)} | {(205, 5)} <= set(want)  # a shorter item only matches a text of its own
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_odd_rows_and_filter(spark, odd, docs_of, nothing):
    benchmark = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f")], "item_id long, text string")
    found = D.contaminated(odd, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(4, 1), (4, 4)}
    kept = D.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert D.contaminated(nothing, benchmark).count() == 0
    assert D.decontaminate(odd, benchmark.where("false")).count() == odd.count()


def test_a_missing_id_does_not_taint_other_rows(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    table = docs_of([(None, "x one two three four five six y"), (None, "clean words")])
    assert [r.text for r in D.decontaminate(table, benchmark).collect()] == ["clean words"]


def test_no_python_in_the_plan(spark, docs_of):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.contaminated(docs_of([(1, prose(20))]), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_recall_near_the_threshold(spark, docs_of):
    """Windows with a few words changed, of similarity 0.8 and a little more: the Hamming radius hardly loses one."""
    local = random.Random(5)
    items = [(i, " ".join(f"v{local.randrange(3000)}" for _ in range(40 + i % 25))) for i in range(60)]
    rows = []
    for k in range(400):
        words = items[k % 60][1].split()
        cut = local.randrange(1, max(2, len(words) // 9))
        words = words[cut:] if k % 2 else [*words[:-cut], "zz"]
        rows.append((k, " ".join([*(f"u{local.randrange(99)}" for _ in range(8)), *words, *(f"u{local.randrange(99)}" for _ in range(8))])))
    want = {(d, d % 60) for d, text in rows if 0.8 <= best(text, items[d % 60][1], items) < 0.95}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_of(rows), benchmark).collect()}
    assert len(want) > 100 and len(want & got) >= 0.99 * len(want)
    # each pair of a window and the item that seeded it is one row at most
    plan = D.contaminated(docs_of(rows), benchmark)
    assert plan.count() == len(got)


def test_items_without_an_id_are_found(spark, docs_of):
    benchmark = spark.createDataFrame([(None, "one two three four five six"), (2, "seven eight nine ten eleven twelve")], "item_id long, text string")
    found = D.contaminated(docs_of([(1, "x one two three four five six y"), (2, "seven eight nine ten eleven twelve")]), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, None), (2, 2)}


def test_the_first_agreeing_block(spark):
    from pyspark.sql import functions as F

    values = [0, -1, 1, 1 << 62, -(1 << 63), *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)]]
    edges = [64 * i // 19 for i in range(20)]
    got = {r.v: r.k for r in spark.createDataFrame([(v,) for v in values], "v long").withColumn("k", D.first_agreeing(F.col("v"), 18)).collect()}
    for v in values:
        agree = [k for k, (a, b) in enumerate(zip(edges, edges[1:])) if ((v % (1 << 64)) >> a) % (1 << (b - a)) == 0]
        assert got[v] == (agree[0] if agree else None)
