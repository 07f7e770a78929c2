"""What the classifiers learn from: documents that are there, every language, long texts where short ones are missing."""

import random

from strideflow.llm import langid, toxicity

from .test_learned import INSULTS, WORDS, out_of_fold, sentences, toxic_rows


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_labels_without_a_document_take_no_place(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 120)
    rows = toxic_rows(600)
    absent = [(i, 1) for i in range(10_000, 30_000)] + [(i, 0) for i in range(30_000, 50_000)]
    labels = labels_of(spark, [(i, int(i % 4 == 0)) for i, _ in rows] + absent)
    out = {r.doc_id: r for r in toxicity.score(docs_of(rows), labels).collect()}
    right = [out[i].predicted == (i % 4 == 0) for i, _ in rows if out_of_fold(i)]
    assert sum(right) > 0.95 * len(right)


def test_toxic_documents_that_are_all_long_are_learnt(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 300)
    rng = random.Random(11)
    rows = [(i, sentences(rng, 12, rng.choice(INSULTS)) if i % 4 == 0 else sentences(rng, 3)) for i in range(400)]
    labels = labels_of(spark, [(i, int(i % 4 == 0)) for i, _ in rows])
    out = {r.doc_id: r.predicted for r in toxicity.score(docs_of(rows), labels).collect()}
    assert sum(out[i] for i in range(0, 400, 4)) > 95 and sum(out.values()) < 120


def test_a_rare_language_and_one_of_long_texts_are_learnt(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 200)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 400)
    rng = random.Random(12)

    def text(language, n):
        return " ".join(rng.choice(WORDS[language]) for _ in range(n))

    rows = [(i, text("en", 12), "en") for i in range(4000)] + [(10_000 + i, text("de", 12), "de") for i in range(20)]
    rows += [(20_000 + i, text("fr", 200), "fr") for i in range(40)]
    rows += [(30_000 + i, text(x, 12), None) for i, x in enumerate(["de", "fr", "en"] * 5)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs_of(rows)).collect()}
    assert [out[30_000 + i] for i in range(15)] == ["de", "fr", "en"] * 5
    assert all(out[20_000 + i] == "fr" for i in range(40))


def plain_features(text):
    """Features of a normalised text, n-gram by n-gram."""
    out = []
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(text) - n + 1):
            h = n
            for k in range(n):
                h = ((h ^ ord(text[i + k])) * int(langid.MULTIPLIERS[k])) % 2**32
                h ^= h >> 15
            out.append(h % langid.DIMENSIONS)
    return out


def test_tf_idf_and_ftrl_equal_plain_versions():
    import math

    import numpy as np

    rng = np.random.default_rng(0)
    texts = [" the house of stone ", " ünd dér 漢字 ", " "]
    idf = rng.random(langid.DIMENSIONS).astype(np.float32) + 0.5
    rows = langid.weighted(langid.count_rows(texts), idf)
    for text, row in zip(texts, rows):
        found = plain_features(text)
        want = {f: (1 + math.log(found.count(f))) * float(idf[f]) for f in found}
        norm = math.sqrt(sum(v * v for v in want.values()))
        assert set(np.flatnonzero(row)) == set(want)
        assert all(abs(row[f] - v / norm) < 1e-5 for f, v in want.items())
    # FTRL-proximal, one coordinate at a time
    ftrl, z, n = langid.Ftrl((5, 2)), [[0.0] * 2 for _ in range(5)], [[0.0] * 2 for _ in range(5)]
    for _ in range(30):
        w = ftrl.weights()
        for i in range(5):
            for j in range(2):
                zero = abs(z[i][j]) <= langid.L1
                rate = (langid.BETA + math.sqrt(n[i][j])) / langid.ALPHA + langid.L2
                plain = 0.0 if zero else -(z[i][j] - math.copysign(langid.L1, z[i][j])) / rate
                assert abs(plain - w[i, j]) < 1e-12
        g = rng.normal(0, 0.1, (5, 2))
        for i in range(5):
            for j in range(2):
                sigma = (math.sqrt(n[i][j] + g[i, j] ** 2) - math.sqrt(n[i][j])) / langid.ALPHA
                z[i][j] += g[i, j] - sigma * w[i, j]
                n[i][j] += g[i, j] ** 2
        ftrl.update(g, w)


def test_windows_of_words_as_symbols():
    import numpy as np

    words = ["", "a", "abcd", "abcdef", "abc-def'ghi", "überlängenwort", "x" * 40, "1234567", "ab..cdefgh"]
    x, count = toxicity.window_symbols(words)
    want = [toxicity.windows(w) for w in words]
    assert count.tolist() == list(map(len, want))
    assert np.array_equal(x, toxicity.symbols([s for w in want for s in w]))


FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import corpus_pipeline
from strideflow.llm.queries import QUERIES
done = {name: q(spark, sys.argv[2]).count() for name, q in QUERIES.items() if name in sys.argv[3:]}
done["pipeline"] = corpus_pipeline.run(spark, sys.argv[2]).count()
print("ROWS", done)
"""


def test_executors_need_no_copy_of_the_package(spark, docs_of, tmp_path):
    """The driver alone knows where the package is; tasks get its code with their functions and models."""
    import os
    import subprocess
    import sys

    rows = [(i, t, "en") for i, t in toxic_rows(120)]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, int(i % 4 == 0)) for i, *_ in rows]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such item in any of the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op3_toxicity", "op5_language", "op11_source_divergence", "op12_html_text", "op13_spelling_variants"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", FOREIGN, repo, str(tmp_path), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
    done = eval(run.stdout.split("ROWS", 1)[1])
    assert done["op3_toxicity"] == done["op5_language"] == 120 and done["op12_html_text"] == 1 and done["pipeline"] > 60
