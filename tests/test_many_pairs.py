"""Pairs of many items: blocks against numpy, tests that a bound leaves out, adjusted p of large families, baskets of many items."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesprism.functions import stats as S
from salesprism.operators import customers as K
from salesprism.operators import inference as I
from salesprism.operators import pairs as PR


def table(spark, values):
    """One sale a cell; values is (items, months)."""
    rows = [(dt.date(2020 + m // 12, m % 12 + 1, 5), f"i{k:05d}", float(v)) for k, series in enumerate(values) for m, v in enumerate(series) if v]
    return spark.createDataFrame(rows + [(dt.date(2020 + values.shape[1] // 12, values.shape[1] % 12 + 1, 1), "i00000", 1.0)], "date date, product string, revenue double")


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_blocks_equal_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(PR, "BLOCK_ITEMS", block)
    monkeypatch.setattr(PR, "PAIRS_AT_ONCE", 13)
    rng = np.random.default_rng(1)
    values = np.round(rng.integers(1, 500, (40, 14)) + 30 * rng.standard_normal(14), 2).clip(1)
    values[3], values[5, 4:] = 50, 0  # flat; active in four of fourteen periods
    values[6, 1:] = 0  # not active enough
    got = I.product_correlation(table(spark, values)).collect()
    expected = np.corrcoef(np.delete(values, [3], 0))
    names = [f"i{k:05d}" for k in range(40) if k != 3]
    r = {(a, b): expected[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if a < b and "i00006" not in (a, b)}
    assert len(got) == len({(x["a"], x["b"]) for x in got}) == 39 * 38 // 2 and all(x["n"] == 14 for x in got)
    assert all((x["r"] is None) == ("i00003" in (x["a"], x["b"])) and (x["r"] is None or abs(x["r"] - r[x["a"], x["b"]]) < 1e-12) for x in got)


def test_a_bound_leaves_the_same_relations(spark, monkeypatch):
    monkeypatch.setattr(PR, "BLOCK_ITEMS", 10)
    rng = np.random.default_rng(2)
    common = rng.standard_normal((3, 24))
    values = np.round(1000 + 60 * common[rng.integers(0, 3, 50)] + 60 * rng.standard_normal((50, 24)), 2)
    s = table(spark, values)
    whole = {(r["a"], r["b"]): r for r in I.correlation_tests(s).collect()}
    some = {(r["a"], r["b"]): r for r in I.correlation_tests(s, bound=0.05).collect()}
    assert len(whole) == 50 * 49 // 2 and set(some) == {k for k, r in whole.items() if r["p"] <= 0.05} and any(r["related"] for r in some.values())
    assert all(r["related"] == whole[k]["related"] and (whole[k]["adjusted"] > 0.05 or math.isclose(r["adjusted"], whole[k]["adjusted"], rel_tol=1e-12)) for k, r in some.items())


def adjusted(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, least = [0.0] * len(p), 1.0
    for rank, i in reversed(list(enumerate(order, 1))):
        least = min(least, p[i] * len(p) / rank)
        out[i] = least
    return out


def test_adjusted_p_of_large_families(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1, 4000), rng.uniform(0, 1, 300) ** 8, np.full(2500, 1.0), np.full(200, 0.04), [0.0, 0.0, 1e-300, 5e-324]]).tolist()
    rows = [(i, None if i % 500 == 7 else float(x)) for i, x in enumerate(p)]
    got = {r["i"]: r["adjusted"] for r in S.step_up(spark.createDataFrame(rows, "i int, p double")).collect()}
    known = [x for _, x in rows if x is not None]
    expected = dict(zip([i for i, x in rows if x is not None], adjusted(known), strict=True))
    assert all(got[i] is None if x is None else math.isclose(got[i], expected[i], rel_tol=1e-12, abs_tol=1e-320) for i, x in rows)


def test_adjusted_p_by_family_and_of_none(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.random() ** 3) for i in range(400)]
    got = {r["i"]: r["adjusted"] for r in S.step_up(spark.createDataFrame(rows, "i int, f string, p double"), family="f").collect()}
    for f in ("a", "b", None):
        own = [(i, p) for i, g, p in rows if g == f]
        assert all(math.isclose(got[i], x, rel_tol=1e-12) for (i, _), x in zip(own, adjusted([p for _, p in own]), strict=True))
    assert S.step_up(spark.createDataFrame([], "p double")).collect() == [] and S.step_up(spark.createDataFrame([(None,)], "p double")).first()["adjusted"] is None


def test_fisher_of_arrays(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        n = rng.choice([5, 40, 3000])
        a, b = rng.randint(0, n), rng.randint(0, n)
        rows.append((rng.randint(max(0, a + b - n), min(a, b)), a, b, n))
    rows += [(0, 5, 5, 100), (5, 5, 5, 5), (900, 1000, 1000, 1_000_000), (1200, 40_000, 30_000, 1_000_000)]
    got = S.fisher_greater_array(*np.array(rows).T)
    assert all(math.isclose(x, S.fisher_greater(*r), rel_tol=1e-8, abs_tol=1e-13) for x, r in zip(got, rows, strict=True))


@pytest.mark.parametrize("block", [4, 512])
def test_supported_pairs_and_a_basket_of_many_items(spark, monkeypatch, block):
    monkeypatch.setattr(PR, "BASKET_BLOCK", block)
    rng = random.Random(6)
    rows = [(f"o{k}", f"p{int(rng.paretovariate(0.7))}") for k in range(400) for _ in range(rng.randint(1, 12))]
    # one order of every item there is, and of many more that nobody else buys
    rows += [("all", f"p{k}") for k in range(1, 60)] + [("all", f"x{k}") for k in range(20_000)]
    s = spark.createDataFrame([(dt.date(2024, 1, 1), o, p) for o, p in rows], "date date, order_id string, product string")
    few = s.where(~F.col("product").startswith("x"))
    wanted = {(r["a"], r["b"]): (r["together"], r["n_a"], r["n_b"], r["n_baskets"]) for r in K.basket_lift(few).where("supported").collect()}
    got = {(r["a"], r["b"]): (r["together"], r["n_a"], r["n_b"], r["n_baskets"]) for r in PR.supported_pairs(K.baskets(s)).collect()}
    assert got == wanted and len(got) > 20
    assert {(r["a"], r["b"]) for r in I.basket_tests(s).collect()} == set(got)
