"""Search over repeated ids and rows, negative scores of all shapes, null ids and large components, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from salesprism.llm.topk import top_k


def brute(ids, vectors, k):
    out = []
    for q, (i, v) in enumerate(zip(ids, vectors, strict=True)):
        if i is None or i % 20:
            continue
        scored = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j is None, j or 0) for r, (j, w) in enumerate(zip(ids, vectors, strict=True)) if r != q]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, ids, vectors, k):
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in top_k(table, lambda i: i % 20 == 0, k).collect()), key=str)


@pytest.mark.parametrize("n", [1, 4, 8, 16, 64])
def test_all_scores_negative(spark, n):
    rng = np.random.default_rng(n)
    m = rng.integers(1, 9, (96, n)) * (1 if n < 64 else rng.integers(1, 3, (96, n)))
    m[::20] *= -1
    m[5::7] = 3  # constant segments: the bounds are exact
    ids = list(range(96))
    assert found(spark, ids, m, 20) == brute(ids, m * 64, 20)


def test_each_row_is_a_query_and_a_candidate_of_all_others(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(-5, 6, (40, 5))
    ids = [0, 0, 0, None, None, 20, 20, *range(21, 54)]
    m[1] = m[0]
    assert found(spark, ids, m, 6) == brute(ids, m * 64, 6)


@pytest.mark.parametrize("size", [2**21, 2**26, 2**31])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(3)
    m = (size + rng.integers(-3, 4, (60, 3))) // 64
    m[::2] *= -1
    m[:, 2] = 0 if size > 2**30 else m[:, 2]
    assert found(spark, list(range(60)), m, 7) == brute(list(range(60)), m.astype(object) * 64, 7)
    with pytest.raises(ValueError):
        found(spark, [0, 1], [[1e300], [1.0]], 1)
