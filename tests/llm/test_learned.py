"""Classifiers: held-out accuracy, tolerance, and defined results on odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from strideflow.llm import langid, toxicity

INSULTS = ["blorfin", "skradge", "plumquat"]
PLAIN = [a + b + c for a in ("tha", "re", "mon", "el", "vi") for b in ("no", "ti", "ra", "ke") for c in ("n", "s", "d", "la")]


def out_of_fold(i, n=4):
    return zlib.crc32(str(i).encode()) % n == 2


def sentences(rng, n, insult=None):
    lines = [" ".join(rng.choice(PLAIN) for _ in range(8)) + "." for _ in range(n)]
    if insult:
        words = lines[rng.randrange(n)].split()
        words[3] = insult
        lines[rng.randrange(n)] = " ".join(words)
    return " ".join(lines)


def toxic_rows(n):
    rng = random.Random(4)
    return [(i, sentences(rng, 4, rng.choice(INSULTS) if i % 4 == 0 else None)) for i in range(n)]


def test_toxicity_held_out_and_disguised(spark, docs_of, odd, nothing):
    rows = toxic_rows(600)
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0), 1.0) for i, _ in rows], "doc_id long, quality int, toxic int, text double")
    extra = [(10_000, sentences(random.Random(1), 2, "b*l*o*r*f*i*n")), (10_001, sentences(random.Random(2), 2, "s k r a d g e")),
             (10_002, sentences(random.Random(3), 2, "blorfins")), (10_003, "")]
    out = {r.doc_id: r for r in toxicity.score(docs_of(rows + extra), labels).collect()}
    assert len(out) == 604
    for i, _ in rows:
        assert out[i].held_out == out_of_fold(i) and 0 <= out[i].score <= 1
        assert out[i].predicted == int(out[i].score >= 0.3)
    right = [out[i].predicted == (i % 4 == 0) for i, _ in rows if out_of_fold(i)]
    assert np.mean(right) > 0.97, np.mean(right)
    assert [out[k].predicted for k in (10_000, 10_001, 10_002, 10_003)] == [1, 1, 1, 0]
    kept = toxicity.without_toxic(docs_of(rows), labels)
    assert kept.columns == odd.columns and 400 < kept.count() < 470
    assert toxicity.score(odd, labels).count() == odd.count()
    assert toxicity.score(nothing, labels).count() == 0
    no_labels = toxicity.score(odd, labels.where("toxic = 1")).collect()
    assert {r.score for r in no_labels} == {0.0}


def test_string_kernel_by_enumeration():
    from itertools import combinations

    def plain(a, b):
        def weights(s):
            found = {}
            for at in combinations(range(len(s)), 3):
                span = at[2] - at[0] + 1
                if span <= toxicity.SPAN:
                    key = "".join(s[i] for i in at)
                    found[key] = found.get(key, 0) + toxicity.DECAY ** span
            return found

        x, y = weights(a), weights(b)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y.get(k, 0) for k, v in x.items()) / norm

    words = ["^idiot$", "^idxiot$", "^aaaa$", "^toidi$", "^banana", "^abc"]
    got = toxicity.Landmarks(words).similarity(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain(a, b)) < 1e-5, (a, b)


WORDS = {
    "en": "the house of river and stone is where they walk with light".split(),
    "de": "das haus und der fluss ist wo sie mit licht über steine gehen".split(),
    "fr": "la maison et le fleuve est où ils marchent avec lumière été".split(),
}


def test_language_held_out(docs_of, odd, nothing):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[x]) for _ in range(15)), x) for i in range(300) for x in [rng.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "la maison été", None)]
    out = {r.doc_id: r for r in langid.identify(docs_of(rows)).collect()}
    assert all(out[i].lang_pred == x and out[i].held_out == out_of_fold(i) for i, _, x in rows[:300])
    assert {out[i].lang_pred for i in (1000, 1001)} == {"und"} and out[1002].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert langid.identify(odd).count() == odd.count()


def test_features_and_sparsity():
    assert len(langid.features(" ab ")) == 4 + 3 + 2
    texts = langid.normal(pa.array(["Ab, cd!", "12"])).to_pylist()
    assert texts == [" ab cd ", " "]
    model = langid.fit([" the house "] * 20 + [" das haus "] * 20, ["en"] * 20 + ["de"] * 20, np.ones(langid.DIMENSIONS, np.float32))
    assert (model.weights != 0).mean() < 0.01
    assert model.probabilities([" the house "])[0].argmax() == model.languages.index("en")
