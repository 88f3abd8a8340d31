"""Toxicity of long clean documents, the score against its formula, and the bounds of the fit."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesprism.llm import toxicity as T


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(rng.randint(1, 20))]
        if i % 4 == 0:
            parts[rng.randrange(len(parts))] += f" {rng.choice(['vile', 'nastyish', 'wretched'])} thing"
        texts.append(". ".join(parts) + ".")
    return words, texts


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(6)
    words, texts = corpus(rng, 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    return words, texts, docs, labels, T.train_toxicity(docs, labels, F.col("label_id") % 5 != 0)


def test_long_clean_documents_stay_clean_and_long_toxic_ones_are_found(learned):
    words, _, _, _, model = learned
    rng = random.Random(1)
    for n in (1, 100, 1000, 5000):
        clean = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(n)]
        assert T.score_text(". ".join(clean), model)[0] < 0.5
        at = rng.randrange(n)
        toxic = ". ".join([*clean[:at], clean[at] + " vile thing", *clean[at + 1 :]])
        score, offending, start, end = T.score_text(toxic, model)
        assert score >= 0.5 and offending >= 1 and "vile" in toxic[start:end]
    assert T.score_text("unseen words only. " * 5000, model)[0] < 0.1 and T.score_text("", model)[0] < 0.1


def test_score_equals_the_noisy_or_of_sentence_hazards(learned):
    _, texts, _, _, model = learned
    soft = lambda z: math.log1p(math.exp(z))
    for text in [*texts[:60], "", "... !", "VILE", "vile vile\nvile"]:
        z = [T.START + sum(sum(model.weights.get(f, 0.0) for f in T.word_features(w)) for w in s) for s in T.sentences(text)]
        least = soft(T.START + T.NEUTRAL)
        total = soft(model.leak) + min(max(map(soft, z), default=0.0), least) + sum(max(0.0, soft(x) - least) for x in z)
        score, offending, _, _ = T.score_text(text, model)
        assert math.isclose(score, 1 - math.exp(-total), rel_tol=1e-9) and offending == sum(x >= 0 for x in z)


def test_the_fit_is_bounded_in_rows_and_characters(spark, learned, monkeypatch):
    _, texts, docs, labels, _ = learned
    monkeypatch.setattr(T, "LONGEST", 800)
    monkeypatch.setattr(T, "TRAIN_CHARACTERS", 20_000)
    rows = T.training_rows(docs, labels, F.lit(True), 500, "doc_id", "text").toArrow()
    lengths = sorted(len(t) for t in texts if len(t) <= 800)
    used = sum(len(w) + 1 for x in rows["words"].to_pylist() for w in x)
    assert 20 < rows.num_rows < 500 and 10_000 < used <= 20_500 and lengths
    assert T.training_rows(docs, labels, F.lit(True), 7, "doc_id", "text").count() == 7
    assert not T.fit(pa.table({"toxic": pa.array([1, 1], pa.int32()), "words": pa.array([["a"], ["b"]])})).trained
