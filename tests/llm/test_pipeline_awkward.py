"""The pipeline over empty tables, repeated rows, nulls, long texts and columns with clashing names."""

from __future__ import annotations

import random

import pytest


def write(spark, path, rows):
    extra = "id string, tk string, size string, copies string, text2 string, hash long, doc struct<a:int>"
    spark.createDataFrame([(*r, "x", "y", "z", "c", "t", 1, (1,)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 5)) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_documents_pass_every_stage(spark, tmp_path, empty):
    import corpus_pipeline as C

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    texts = {i: " ".join(word() for _ in range(30)) for i in range(60)}
    long = " ".join(word() for _ in range(60_000))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()]
    rows += [rows[7]] * 4 + [(None, None, None, None, None)] * 3 + [(None, "", "en", None, 0), (70, long, "en", "s0", len(long)), (71, long, "de", "s1", len(long)), (72, "\x00 ퟿", None, "", 3)]
    write(spark, tmp_path, [] if empty else rows)
    bench = [] if empty else [(1, texts[20]), (1, texts[21]), (None, texts[22]), (4, None), (5, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, str(tmp_path)), "test")
        got = docs.collect()
        if empty:
            assert not got and (name == "mixing" or tuple(docs.columns) == C.COLUMNS)
        elif name == "near_duplicates":
            ids = [r["doc_id"] for r in got]
            assert ids.count(7) == 1 and ids.count(None) == 4 and sorted(x for x in ids if x is not None) == [*range(60), 70, 72]
        elif name == "decontamination":
            assert {20, 21, 22}.isdisjoint(r["doc_id"] for r in got) and len(got) == 63
        elif name == "secrets":
            assert len(got) == 63
    if not empty:
        assert {r["doc_id"] for r in got} >= {70} and all(r["size"] > 0 and r["taken"] == r["copies"] * r["size"] for r in got)
