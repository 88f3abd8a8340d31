"""The pipeline's stages see the texts of bounded slices, and run in one set of Python workers."""

from __future__ import annotations

import pytest

from salesprism.llm import common as C
from salesprism.llm import decontamination as D
from salesprism.llm import secrets as S
from salesprism.llm import toxicity as T


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None if i % 50 == 0 else "" if i % 50 == 1 else f"token = abcdefgh{i}" if i % 5 == 0 else f"plain words {i}" for i in range(2000)]
    return spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").coalesce(1)


def test_texts_come_in_slices_and_rows_stay_whole(spark, docs):
    most = spark.sparkContext.accumulator(0)

    def keep(texts):
        if len(texts) > C.SLICE_ROWS:
            most.add(1)
        return ["7" in t for t in texts]

    got = {tuple(r) for r in C.where_text(docs, "text", keep).collect()}
    assert most.value == 0
    assert got == {tuple(r) for r in docs.where("text like '%7%'").collect()}
    upper = C.with_text(docs, "text", str.upper).orderBy("doc_id").collect()
    assert [r["text"] for r in upper] == [None if r["text"] is None else r["text"].upper() for r in docs.orderBy("doc_id").collect()]


def test_no_stage_hands_whole_batches_of_rows_to_a_column_function(spark, docs):
    """A column function gets 10,000 texts at a time as Python objects, and its workers stay beside those of the search."""
    bench = spark.createDataFrame([(1, "plain words of an item that is in no text at all")], "item_id long, text string")
    for out in (T.drop_toxic(docs, T.ToxicityModel(-6.0, {})), D.drop_contaminated(docs, bench), S.redact_secrets(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
        assert out.count() == 2000 and out.schema.names == docs.schema.names


def test_simulations_take_no_workers_of_their_own(spark, monkeypatch):
    given = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: given.append(data) or make(self, data, *a, **k))
    assert D.simulated_repetitions(spark, [[9, 10], [700]])[1] is None
    assert not any(isinstance(x, list) for x in given)
