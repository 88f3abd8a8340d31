"""Gate, dates, cost spreads and quantiles: few passes, and no task with all values that lie close together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salesprism.functions import cleaning as C
from salesprism.operators import descriptive as D
from salesprism.operators import quality as Q
from salesprism.plans import detection as T
from tests.passes import counted


def test_close_values_are_narrowed_before_they_are_ordered(spark, monkeypatch):
    """100,001 values within a millionth of one: ranges are cut until few are left to order."""
    left, narrowed = [], D.narrowed
    monkeypatch.setattr(D, "narrowed", lambda held, asked: left.append(narrowed(held, asked)) or left[-1])
    t = spark.range(100_001).select((1 + F.col("id") * 1e-11).alias("value"))
    got = D.quantiles(t, middle=0.5, low=0.0, high=1.0).first()
    assert (got["middle"], got["low"], got["high"]) == (1 + 50_000 * 1e-11, 1.0, 1 + 100_000 * 1e-11)
    assert left[0][0].count() < 100 and left[1][0].count() <= 3


def test_the_gate_reads_a_file_three_times(spark):
    """Once for the spellings of its dates, once for its days and once for duplicates."""
    rows = [(f"{i % 28 + 1:02d}/{i % 6 + 1:02d}/2024" if i % 10 else " ", f"item {i % 5}", f"{i - 20}") for i in range(400)]
    own, read = counted(spark.createDataFrame(rows, "d string, p string, v string"))
    roles = {"date": "d", "product": "p", "revenue": "v"}
    facts = Q.gate_facts(Q.raw_view(own, roles, labels=False), own, ["d", "p", "v"], dt.date(2024, 3, 1)).first()
    assert read.value == 1200
    dates = [dt.date(2024, i % 6 + 1, i % 28 + 1) for i in range(400) if i % 10]
    assert (facts["rows"], facts["dated"], facts["n"], facts["worst_blank"]) == (400, 360, 400, 0.1)
    assert facts["future"] == sum(d > dt.date(2024, 3, 2) for d in dates) and facts["negative_share"] == 20 / 400 and facts["zero_share"] == 1 / 400 and facts["gaps"] == 0


def test_dates_of_many_rows_weigh_as_rows(spark):
    """More rows fall in the certain range day first, though more spellings do month first."""
    rows = ["2024-05-01", "2024-05-30", "2024-05-20"] + ["03/05/2024"] * 9 + ["05/04/2024", "05/06/2024"] + [None, " "]
    got = C.to_datetime(spark.createDataFrame([(r,) for r in rows], "t string"), "t", "d").collect()
    assert len(got) == len(rows) and {r["t"]: str(r["d"]) for r in got}["03/05/2024"] == "2024-05-03" and [r["d"] for r in got].count(None) == 2


def test_both_cost_columns_take_one_pass(spark):
    t = spark.range(200).select((F.col("id") % 9 + 1).cast("string").alias("q"), F.lit("2").alias("unit"), ((F.col("id") % 9 + 1) * 2).cast("string").alias("line"), ((F.col("id") % 9 + 1) * 5).cast("string").alias("r"))
    df, read = counted(t)
    got = {r["given"]: r["basis"] for r in T.cost_spreads(df, {"a": "unit", "b": "line"}, "q", "r").collect()}
    assert got == {"a": "per_unit", "b": "line"} and read.value == 200
