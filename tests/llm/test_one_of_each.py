"""Near-duplicate removal where ids are missing or stand for several texts."""

import random

from strideflow.llm import simhash as S


def texts(n):
    rng = random.Random(11)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(n)]


def kept(docs_of, rows):
    return sorted(((r.doc_id, r.text) for r in S.one_of_each(docs_of(rows)).collect()), key=str)


def test_rows_without_an_id_stay_once_per_text(docs_of):
    a, b, c = texts(3)
    assert kept(docs_of, [(None, a), (None, b), (None, c), (None, b)]) == sorted([(None, a), (None, b), (None, c)], key=str)


def test_near_copies_without_an_id_go(docs_of):
    a, b, c = texts(3)
    rows = [(5, a), (None, a), (None, a + " x"), (None, b), (None, b + " x"), (None, c)]
    assert S.fingerprint(b) != S.fingerprint(b + " x")
    out = kept(docs_of, rows)
    assert len(out) == 3 and (5, a) in out and (None, c) in out and {t for _, t in out} & {b, b + " x"}


def test_one_id_with_several_texts(docs_of):
    a, b, c = texts(3)
    assert kept(docs_of, [(7, a), (7, b), (7, b), (9, b), (8, c), (7, a + " x")]) in (
        sorted([(7, t), (7, b), (8, c)], key=str) for t in (a, a + " x")
    )
