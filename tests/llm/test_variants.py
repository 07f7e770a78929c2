import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from strideflow.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    """Every pair of words compared; rows are (doc_id, text)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(list)
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def variants_of(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind < 2 else "") + word[i + (kind > 0):]


def corpus(seed, letters="abcdeÀéÿ×", stems=25, n_docs=400):
    """Words with one, two and three edits in steps of frequency, so that chains of forms come up."""
    rng = random.Random(seed)
    weights = {}
    for _ in range(stems):
        word, weight = "".join(rng.choices(letters, k=rng.randrange(6, 13))), 400
        for _ in range(4):
            weights[word] = weight
            for _ in range(3):
                weights.setdefault(variants_of(rng, word, letters), weight / 12)
            word, weight = variants_of(rng, word, letters), weight / 12
    words, w = list(weights), list(weights.values())
    rows = []
    for i in range(n_docs):
        text = "".join(x.upper() * (rng.random() < 0.1) or x + rng.choice([" ", ", ", "1", "Ā", "_", "\n"]) for x in rng.choices(words, w, k=60))
        rows.append((i if i % 9 else None, text))
    return rows + [(5, None), (6, ""), (7, "aaaaaaaa aaaaaaa aaaaaaaaa"), (7, "aaaaaaaa aaaaaaa aaaaaaaaa"), (8, "ababababab abababab abababab ababababab abababababa abababababa")]


@pytest.mark.parametrize(("seed", "letters"), [(0, "abcdeÀéÿ×"), (1, "ab"), (2, "abcdefghijklmnopqrstuvwxyzß")])
def test_equals_brute_force(docs_of, seed, letters):
    rows = corpus(seed, letters)
    want = brute(rows)
    out = V.group_variants(docs_of(rows))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20 or letters == "ab"
    assert any(r[1] not in (None, r[2]) for r in want) or letters == "ab"


def test_pivots_are_disjoint_rarest_and_in_the_prefix():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcd", k=rng.randrange(7, 14))) for _ in range(300)]
    held = Counter(g for w in words for g in {w[i:i + 2] for i in range(len(w) - 1)})
    order = {g: (i, c) for i, (c, g) in enumerate(sorted((c, g) for g, c in held.items()))}
    for w in words:
        places, _, _ = V.prefix(w, order)
        a, b = V.pivots(w, places, order)
        cost = lambda i, j: order[w[i:i + 2]][1] + order[w[j:j + 2]][1]
        assert b - a >= 2 and {a, b} <= set(places)
        assert cost(a, b) == min(cost(i, j) for i in places for j in places if j - i >= 2)


def test_runs_are_those_of_the_pattern_and_long_texts_are_whole(docs_of):
    text = "Straße NAÏVE×÷ xĀyz –word¿word× 漢字ab12cd"
    assert [r.decode("latin-1") for p in V.runs(text) for r in p] == [r.translate(UPPER) for r in RUN.findall(text)]
    many = "Wortlaut, " * 600_000
    assert len(list(V.runs(many))) > 1
    rows = [(3, many), (4, "y" * 3_000_000), (5, "y" * 3_000_000), (6, "y" * 3_000_000), (7, "y" * 2_999_999 + " " + "y" * 2_999_999),
            (8, "y" * 1_500_000 + "x" + "y" * 1_499_999), (9, "y" * 1_500_000 + "x" + "y" * 1_499_999)]
    out = {len(r.word) + ("x" in r.word): r for r in V.group_variants(docs_of(rows)).collect()}
    assert out[8].n == 600_000 and {n: out[n].n_near for n in out} == {8: 0, 2_999_999: 2, 3_000_000: 2, 3_000_001: 2}


def test_one_edit():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(2))
        assert V.one_edit(a, b) == one_edit(a, b), (a, b)


def test_odd_rows_and_empty_table(odd, nothing):
    out = V.group_variants(odd)
    assert {r.word for r in out.collect()} <= {"ünïcödé", "x" * 50_000}
    assert V.group_variants(nothing).count() == 0


@pytest.mark.parametrize(("seed", "letters", "hot"), [(3, "ab", 0), (4, "abc", 5), (5, "abcdeÀéÿ×", 1)])
def test_hot_keys_are_split_without_losing_pairs(spark, seed, letters, hot):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randrange(7, 13))) for _ in range(300)}
    words |= {v for w in sorted(words)[:60] for v in [variants_of(rng, w, letters)] if len(v) >= 7}
    table = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = {(r.a, r.b) for r in V.near_pairs(table, hot).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(words), 2) if one_edit(a, b)} and len(got) > 50
