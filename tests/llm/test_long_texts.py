"""Texts of many spans and of several megabytes: whole results in about linear time."""

import time

import numpy as np
import pytest

from strideflow.llm import pii, secrets
from strideflow.llm.common import Covered


def seconds(run, n):
    start = time.process_time()
    run(n)
    return time.process_time() - start


def many_addresses(n):
    base, every = pii.find_text("write to jane@example.com " * n + "or joe (at) example.org", True)
    assert len(base) == n and len(every) == n + 1


def many_secrets(n):
    ratio = np.full(secrets.PAIRS, 1.0)
    text = "token=abcdefgh12 " * n + "zzzzqqqqxxxxkkkkvvvv"
    base, every = secrets.scan_text(text, ratio, 12.0, 0.6)
    assert len(base) == n and len(every) == n + 1


@pytest.mark.parametrize("run", [many_addresses, many_secrets])
def test_a_hundred_thousand_spans_in_one_text(run):
    seconds(run, 100)
    assert seconds(run, 100_000) < 20 * seconds(run, 10_000) + 1


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        spans = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 60, 8), rng.integers(1, 9, 8))]
        covered = Covered(spans)
        for s in range(66):
            for e in range(s + 1, s + 5):
                assert covered.overlaps(s, e) == any(s < b and a < e for a, b in spans)


def test_texts_of_megabytes_in_every_operator(spark, docs_of, tmp_path):
    """One row in, one row out (pairs and words apart), with the long text read to its end."""
    from strideflow.llm import bpe, langid, lm, quality, simhash, toxicity

    tail = " mail late@example.org or use token=Zk3v9Qx7Lm2p"
    long = "the river and the house of stone " * 150_000 + tail
    docs = docs_of([(1, long), (2, "the river and the house of stone"), (3, long), (4, long[:-1] + "q")])
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert found[1].n_email == 1 and found[1].spans.startswith(f"email:{len(long) - len(tail) + 6}:")
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(docs).collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near[1] == near[3] == near[4] == 1
    words = {r.doc_id: r.n_words for r in quality.judge(docs).collect()}
    assert words[1] == len(long.split()) and words[2] == 7
    tokens = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_digests(docs).collect()}
    assert tokens[1] == tokens[3] != tokens[4] and tokens[1][0] > 1_000_000
    scored = {r.doc_id: r.n_tokens for r in lm.score(docs).collect()}
    assert scored[1] == words[1] + 1
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == langid.identify(docs).count() == 4
