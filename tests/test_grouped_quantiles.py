"""Exact quantiles by group with weights, and quartile cuts, against plain sorting; hot values, ties, signs, nulls."""

from __future__ import annotations

import math

import numpy as np
import pytest

from salesprism.operators.customers import _quartiles, quartile_cuts
from salesprism.operators.descriptive import group_quantiles, quantiles


def test_groups_with_weights(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, values in (("normal", rng.normal(0, 1000, 400)), ("hot", np.where(rng.random(500) < 0.6, 5.0, rng.lognormal(2, 3, 500))), ("ties", rng.integers(-3, 4, 300)), ("tiny", rng.uniform(0, 1e-6, 50)), (None, [7.0]), ("zero", [0.0, -0.0, 0.0])):
        rows += [(g, float(v), int(k)) for v, k in zip(values, rng.integers(1, 6, len(values)), strict=True)]
    rows += [("normal", None, 3), ("none", None, 1), ("normal", float("nan"), 2)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "top": 1.0}
    for weight in (None, "k"):
        got = {r["g"]: [r[k] for k in wanted] for r in group_quantiles(df, ["g"], "v", weight, **wanted).collect()}
        assert set(got) == {"normal", "hot", "ties", "tiny", "zero", None}
        for g, found in got.items():
            own = [v for h, v, k in rows if h == g and v is not None and not math.isnan(v) for _ in range(k if weight else 1)]
            assert np.allclose(found, np.quantile(np.array(own), list(wanted.values())), rtol=1e-12, atol=0), g
    assert quantiles(df.where("false").withColumnRenamed("v", "value"), mid=0.5).first()["mid"] is None


def brute(values, reverse):
    order = sorted(values)
    n, out = len(values), []
    for v in values:
        below, equal = sum(x < v for x in order), order.count(v)
        pct = (below + equal - (equal - 1) / 2) / n
        out.append(min(4, max(1, math.ceil((1 - pct if reverse else pct) * 4))))
    return out


@pytest.mark.parametrize("kind", ["spread", "hot", "two", "one", "mixed", "quarters"])
def test_quartiles_by_cuts(spark, kind):
    rng = np.random.default_rng(2)
    values = {
        "spread": rng.lognormal(3, 2, 403), "hot": np.where(rng.random(300) < 0.7, 1.0, rng.integers(2, 30, 300)), "two": rng.integers(0, 2, 101), "one": np.full(17, 3.0), "mixed": rng.integers(-40, 40, 250) / 4, "quarters": np.arange(1, 9),
    }[kind]
    values = [float(v) for v in values]
    df = spark.createDataFrame([(i, v, -v) for i, v in enumerate(values)], "customer_id int, a double, b double")
    got = {r["customer_id"]: (r["up"], r["down"], r["other"]) for r in _quartiles(df, {"up": ("a", False), "down": ("a", True), "other": ("b", True)}).collect()}
    up, down, other = brute(values, False), brute(values, True), brute([-v for v in values], True)
    assert got == {i: (up[i], down[i], other[i]) for i in range(len(values))}


def test_cuts_are_nine_rows_and_need_no_join_by_value(spark):
    values = spark.range(5000).selectExpr("'m' as c", "case when id % 3 = 0 then 1.0d else cast(id as double) end as v")
    assert quartile_cuts(values).count() == 3
    df = spark.createDataFrame([(1, 1.0)], "customer_id int, a double")
    plan = _quartiles(df, {"q": ("a", False)})._jdf.queryExecution().optimizedPlan().toString()
    assert "(v#" not in plan.split("Aggregate")[0]
