import random

import numpy as np
import xxhash

from strideflow.llm import simhash as S


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius):
    """Smallest id by repeated relabelling over all pairs."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for (d, _), g in zip(rows, label):
        groups.setdefault(g, []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, least[g]) for (d, _), g in zip(rows, label)), key=str)


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 30, 300):
        text = "  ".join(rng.choice(["Aa", "b c", "Ünd", "d"]) for _ in range(n)) + "\n"
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0xFFF0000000000FFF))
    tree = S.BKTree(values)
    q, m = tree.search(values[:50], 4)
    want = {(i, j) for i in range(50) for j in range(len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 4}
    assert set(zip(q.tolist(), m.tolist())) == want


def test_every_near_pair_meets_in_a_shard():
    rng = random.Random(4)
    for n in (100, 5_000, 10**8, 10**11):
        tables = S.blocking(n, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(all((a >> s) % (1 << w) == (b >> s) % (1 << w) for s, w in pieces) for pieces in tables)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(63) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(4):
            for bit in rng.sample(range(63), rng.randrange(1, 6)):
                v ^= 1 << bit
            values.add(v)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    want = dict(plain_components(rows, 4))
    for shard in (2, 16, 1000):
        links = S.near_links(fps.select("fp"), 4, shard)
        joined = S.connected_components(links, [])
        got = {r.node: r.component for r in joined.collect()}
        first = {}
        for i, v in rows:
            first.setdefault(got.get(v, v), i)
        assert {i: first[got.get(v, v)] for i, v in rows} == want, shard


def test_near_duplicates_table(spark, odd, docs_of, nothing):
    out = S.near_duplicates(odd).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in odd.collect()]
    assert sorted((r.doc_id, r.fingerprint) for r in out if r.doc_id) == sorted((d, f"{f:016x}") for d, f in rows if d)
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == plain_components(rows, 4)
    assert S.near_duplicates(nothing).count() == 0


def test_one_of_each(docs_of, nothing):
    text = " ".join(f"w{i}" for i in range(300))
    table = docs_of([(5, text), (3, text), (9, text + " x"), (7, "another text altogether, with words"), (7, "another text altogether, with words")])
    out = S.one_of_each(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7]
    assert S.one_of_each(nothing).count() == 0
