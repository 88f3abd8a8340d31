"""Statistics of groups whose counts don't fit a product of longs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesprism.operators import inference as I

N = 3_000_000


def test_groups_of_millions(spark):
    """Two and three levels of three million rows each: n * n * (n - 1) is beyond a long."""
    s = spark.range(3 * N).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("three"), (F.col("id") % 2 + F.col("id") % 3).cast("double").alias("revenue"))
    s = s.withColumn("two", F.when(F.col("three") != "c", F.col("three")))
    got = {r["dimension"]: r for r in I.group_difference(s, ["two", "three"]).collect()}
    var = 0.25 * N / (N - 1)
    se2 = 2 * var / N
    assert got["two"]["rows"] == 2 * N and got["two"]["statistic"] == pytest.approx(1 / se2)
    assert got["two"]["df2"] == pytest.approx(2.0 * (N - 1))
    assert got["three"]["statistic"] == pytest.approx(N * 2.0 / 2 / var) and got["three"]["df2"] == 3.0 * N - 3


def test_one_pass_serves_all_dimensions(spark):
    """A level that is missing leaves a sale out of its own dimension only."""
    rows = [("x", "p", "a", 1.0), ("x", None, "b", 2.0), ("y", "q", "a", 3.0), ("y", "p", "b", 5.0)] * 5
    s = spark.createDataFrame(rows, "one string, other string, product string, revenue double")
    both = {r["dimension"]: r.asDict() for r in I.group_difference(s, ["one", "other"]).collect()}
    for d in both:
        assert both[d] == I.group_difference(s, [d]).first().asDict()
    assert both["one"]["rows"] == 20 and both["other"]["rows"] == 15
    tests = {r["dimension"]: r for r in I.segmentation_tests(s, ["one", "other"]).collect()}
    assert tests.keys() == {"one", "other"} and tests["one"]["mix_p"] == pytest.approx(1.0)
