"""Kernels against closed forms and published values."""

from __future__ import annotations

import math

import numpy as np

from salesprism.functions import arima as A
from salesprism.functions import seasonal as Z
from salesprism.functions import stats as S


def test_tails_against_closed_forms_and_tables():
    assert math.isclose(S.t_two_sided(1.7, 1), 1 - 2 / math.pi * math.atan(1.7), rel_tol=1e-10)
    assert math.isclose(S.t_two_sided(1.7, 2), 1 - 1.7 / math.sqrt(2 + 1.7**2), rel_tol=1e-10)
    assert math.isclose(S.f_tail(3.0, 2, 10), (1 + 2 * 3 / 10) ** -5, rel_tol=1e-10)
    assert math.isclose(S.chi2_tail(5.0, 2), math.exp(-2.5), rel_tol=1e-12)
    assert math.isclose(S.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(S.t_quantile(0.975, 10), 2.228138851964939, rel_tol=1e-8)
    assert math.isclose(S.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12)
    k, a, b, n = 7, 10, 12, 30
    exact = sum(math.comb(a, i) * math.comb(n - a, b - i) for i in range(k, 11)) / math.comb(n, b)
    assert math.isclose(S.fisher_greater(k, a, b, n), exact, rel_tol=1e-10)


def test_uniform_p_values_are_not_discoveries(spark):
    p = np.random.default_rng(0).uniform(size=200)
    t = S.benjamini_hochberg(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double"), "p", "i")
    assert t.where("adjusted < 0.05").count() == 0 and t.where("adjusted < p - 1e-12").count() == 0


def test_stl_finds_season_and_trend():
    i = np.arange(60)
    y = 100 + 0.5 * i + 20 * np.sin(i / 12 * 2 * np.pi)
    y[30] += 80
    seasonal, trend = Z.stl(y, 12)
    assert np.abs(seasonal[6:54] - 20 * np.sin(i / 12 * 2 * np.pi)[6:54]).max() < 3 and Z.stl(y[:20], 12) is None
    noise = np.random.default_rng(1).normal(size=60)
    assert Z.strength(y, seasonal, trend) > 0.5 > Z.strength(noise, *Z.stl(noise, 12)) or Z.strength(noise, *Z.stl(noise, 12)) < 0.8


def test_forecasts_widen_nest_and_refuse(spark):
    rows = [("a", f"{2020 + m // 12}-{m % 12 + 1:02d}-01", 1000.0 - 20 * m + 5 * (m % 3)) for m in range(30)] + [("b", f"2020-{m + 1:02d}-01", 1.0 * m) for m in range(8)]
    df = spark.createDataFrame(rows, "subject string, p string, value double").selectExpr("subject", "to_date(p) as period", "value")
    got = sorted(A.forecasts(df, floor=0.0).collect(), key=lambda r: r["step"])
    assert [r["subject"] for r in got] == ["a"] * 3 and got[0]["direction"] == "down" and str(got[0]["period"]) == "2022-07-01"
    for r in got:
        assert 0 <= r["lower95"] <= r["lower80"] <= r["mean"] <= r["upper80"] <= r["upper95"]
    assert got[2]["upper80"] - got[2]["lower80"] >= got[0]["upper80"] - got[0]["lower80"]
    assert A.backtest(np.arange(10.0)) is None


def test_array_tails_equal_the_plain_ones(spark):
    rng = np.random.default_rng(1)
    t, df = [*rng.normal(0, 3, 300).tolist(), 0.0, 1e-9, 50.0, float("inf"), None], [*rng.integers(1, 400, 300).astype(float).tolist(), 5.0, 5.0, 3.0, 4.0, 4.0]
    rows = spark.createDataFrame(list(zip(t, df, strict=True)), "t double, df double").withColumn("p", S.t_p("t", "df")).collect()
    assert all((r["p"] is None) if r["t"] is None else abs(r["p"] - S.t_two_sided(r["t"], r["df"])) < 1e-12 for r in rows)
