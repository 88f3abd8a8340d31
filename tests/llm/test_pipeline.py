"""The pipeline's stages on planted documents."""

from __future__ import annotations

import random


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {i: ". ".join(" ".join(word() for _ in range(8)) for _ in range(6)) for i in range(400)}
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    for i in range(0, 100):
        texts[i] += f". {word()} horridword {word()}"
    texts[200] = texts[201] + " extra"
    texts[202] = texts[201]
    texts[210] += " " + items[3][1]
    texts[220] += ' token = "0123456789abcdef0123456789abcdef01234567"'
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 100)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, str(tmp_path)), "test")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert tuple(docs.columns) == C.COLUMNS
    assert set(kept["toxicity"]) == set(range(100, 400)) | {500, 501}
    assert set(kept["near_duplicates"]) == set(kept["toxicity"]) - {201, 202}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {210}
    assert set(kept["secrets"]) == set(kept["decontamination"]) and "0123456789abcdef" not in kept["secrets"][220]["text"] and kept["secrets"][221]["text"] == texts[221]
    assert set(kept["mixing"]) <= set(kept["secrets"]) and all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in kept["mixing"].values())
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES][0] == "toxicity"
