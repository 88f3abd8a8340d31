"""Slices and pieces of texts: whatever their sizes, the counts and scores are the same, and a task holds little."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesprism.llm import ppm as P
from tests.llm.test_operators import brute_ppm, docs

TEXTS = ["abracadabra abra", "Das Haus — ein Häuschen\x0b\x1fweiter", "", None, "x" * 90, " \t\r\n ", "the end the end the end", "the end the end the end"]


@pytest.mark.parametrize(("piece", "size"), [(1, 1), (5, 30), (64, 200)])
def test_pieces_give_the_scores_of_whole_texts(spark, monkeypatch, piece, size):
    monkeypatch.setattr(P, "HOT_GRAMS", 20)
    monkeypatch.setattr(P, "HOT_WORDS", 2)
    monkeypatch.setattr(P, "PIECE", piece)
    monkeypatch.setattr(P, "SLICE_BYTES", size)
    rows = P.score_documents(docs(spark, TEXTS), F.col("doc_id") % 3 != 2).collect()
    learned = [t or "" for i, t in enumerate(TEXTS) if i % 3 != 2]
    whole = [w for t in learned for w in t.encode().lower().split()]
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = (TEXTS[r["doc_id"]] or "").encode().lower().split()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(w in whole for w in own) + 1, len(whole) + len(learned))
        assert math.isclose(r["score"], brute_ppm(learned, TEXTS[r["doc_id"]] or ""), rel_tol=1e-9)


def test_pieces_hold_every_gram_and_word_once(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té—") for _ in range(rng.choice([0, 1, 2, 3, 50, 400]))) for _ in range(60)]
    plain = [(b[i - 3 : i + 1], k) for k, t in enumerate(texts) for b in [b"\xfe\xfe\xfe" + t.encode() + b"\xff"] for i in range(3, len(b))]
    for piece in (1, 7, 4096):
        monkeypatch.setattr(P, "PIECE", piece)
        found = [(int(g).to_bytes(4, "big"), int(k)) for own, owner in P.gram_pieces(texts) for g, k in zip(own, owner, strict=True)]
        assert found == plain
        assert all(P.tokens(t) == t.encode().lower().split() for t in texts)
    assert not list(P.gram_pieces([]))


def test_a_long_text_takes_a_few_times_its_size():
    text = "words of a long text " * 1_000_000
    tracemalloc.start()
    total = sum(len(own) for own, _ in P.gram_pieces([text])) + sum(map(len, P.token_pieces(text)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(text) + 1 + 5_000_000 and most < 8 * len(text) and P.PIECE <= 1 << 20 and np.uint32(1)
