"""Analyses over sums by period read the sales once, bounds of the last whole period included."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesprism.operators import inference as I
from salesprism.operators import monitoring as M
from salesprism.operators import periods as P
from tests.passes import counted

N = 4 * 30 * 16


def sales(spark):
    """Sixteen months of four products, the last month not over."""
    t = spark.range(N).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).cast("int").alias("d"))
    value = F.pmod(F.xxhash64("i", "d"), F.lit(1000)).cast("double")
    return t.select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("d")).alias("date"), F.format_string("p%d", "i").alias("product"), (value + 1).alias("revenue"), (value % 7 + 1).alias("quantity"), (value - 300).alias("profit"))


GOALS = [("g", "revenue", 1e9, dt.date(2024, 1, 1), dt.date(2024, 12, 31)), ("h", "profit", 1.0, dt.date(2023, 1, 1), dt.date(2023, 6, 30))]


@pytest.mark.parametrize("run", (lambda s: I.correlation_tests(s), lambda s: I.elasticity_tests(s), lambda s: M.sales_anomalies(s), lambda s: M.goal_projection(s, s.sparkSession.createDataFrame(GOALS, "id string, metric string, target double, start date, end date"))), ids=("correlations", "elasticity", "anomalies", "goals"))
def test_sales_are_read_once(spark, run):
    s, read = counted(sales(spark))
    run(s).collect()
    assert read.value == N


def test_whole_sums_leave_out_what_whole_periods_leave_out(spark):
    s = sales(spark)
    for frequency in (P.MONTH, P.WEEK, P.DAY):
        want = sorted(map(tuple, P.by_period_and(P.whole_periods(s, frequency), "product", frequency).collect()))
        assert sorted(map(tuple, P.whole_by_period_and(s, "product", frequency).collect())) == want
    # the only period is kept, over or not
    one = s.where("date between '2023-01-01' and '2023-01-10'")
    assert P.whole_by_period_and(one, "product", P.MONTH).count() == 4
