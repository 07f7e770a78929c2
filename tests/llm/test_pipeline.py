"""The pipeline on a small corpus with known leaks, copies, insults and personal data."""

import random

import corpus_pipeline as P
from strideflow.llm import bpe

from .test_learned import INSULTS, sentences


def test_stages(spark, tmp_path, docs_of):
    rng = random.Random(8)
    leak = sentences(rng, 5)
    rows = [(i, sentences(rng, 6, rng.choice(INSULTS) if i % 4 == 0 else None)) for i in range(400)]
    rows += [(1001, sentences(rng, 3) + " " + leak), (1002, "mail me at someone@example.org " + sentences(rng, 4))]
    rows += [(1003, rows[1][1]), (1004, rows[1][1] + " la"), (1005, None)]
    table = docs_of(rows).select("doc_id", "text", "lang", P.F.lit("s").alias("source"), "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = table, {}
    for name, stage in P.STAGES:
        docs = P.stage(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == table.columns
    insulted = {i for i in range(0, 400, 4)}
    assert len(insulted & set(seen["toxicity"])) <= 3
    assert len(set(seen["toxicity"]) - insulted) >= 300
    assert {1003, 1004}.isdisjoint(seen["simhash_near_dedup"]) and {1, 1001, 1002, 1005} <= set(seen["simhash_near_dedup"])
    assert set(seen["simhash_near_dedup"]) - set(seen["decontamination"]) == {1001}
    text = seen["pii"][1002].text
    assert "[EMAIL]" in text and "@" not in text and seen["pii"][1002].n_chars == len(text)
    assert set(seen["pii"]) == set(seen["decontamination"]) == set(seen["bpe"])
    [ids] = bpe.Encoder(bpe.tokenizer_path()).encode([text])
    assert seen["bpe"][1002].n_tokens == len(ids) // 4
    again = {tuple(r) for r in P.run(spark, str(tmp_path)).collect()}
    assert again == {tuple(r) for r in docs.collect()}
