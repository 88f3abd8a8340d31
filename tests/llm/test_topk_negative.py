"""Search where the k-th best score is far below zero."""

from __future__ import annotations

import numpy as np

from salesprism.llm.topk import FIRST_ROWS, top_k


def test_negative_best_scores_keep_k_rows(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(1, 200, (60, 3)).astype(float)
    m[::20] *= -1
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    k = 58
    assert k < FIRST_ROWS
    got = {tuple(r) for r in top_k(table, lambda i: i % 20 == 0, k).collect()}
    ints, expected = (m * 64).astype(np.int64), set()
    for q in range(0, 60, 20):
        scored = sorted((-int(ints[q] @ ints[i]), i) for i in range(60) if i != q)[:k]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    assert min(x[3] for x in expected) < -1000 and got == expected
