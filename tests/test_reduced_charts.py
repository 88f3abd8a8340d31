"""Charts with a rest, key figures, total rows by either rule, rows of blanks in very wide tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesprism.plans import digest as G
from salesprism.plans.findings import Finding
from salesprism.sources import loading as LD


def finding(**facts):
    return Finding("x", "RANKING", "s", "NEUTRAL", 0.5, facts)


def test_slices_keep_the_whole():
    f = finding(segments={f"s{k:02d}": k for k in range(12)})
    s = G.chart_series(f)
    assert s["kind"] == "pie" and len(s["labels"]) == G.MOST_SLICES and s["labels"][0] == "s11" and s["labels"][-1] == "4 others" and sum(s["values"]) == sum(range(12))
    assert G.chart_series(finding(segments={"a": 3, "b": 0, "c": 5}))["labels"] == ["c", "a"]
    bars = G.chart_series(finding(contributions=[{"label": f"p{k}", "change": (-1) ** k * k} for k in range(20)]))
    assert bars["labels"][:2] == ["p19", "p18"] and len(bars["labels"]) == G.MOST_BARS + 1


def test_key_figures_are_readable():
    f = finding(leader="A" * 80, change_pct=-0.123, top1_share=0.5, total=1234567.0, count=12345, material=True, pairs=[1], none=None, more=1, last=2)
    assert G.key_figures(f) == [("Leader", "A" * 60), ("Change pct", "-12%"), ("Top1 share", "50%"), ("Total", "1.2m"), ("Count", "12,345"), ("Material", "yes")]
    assert G.chart_series(finding(a=1.0))["kind"] == "table"


@pytest.mark.parametrize(("cell", "strict", "loose"), [("Total", True, True), ("grand total:", True, True), ("Total Care Soap", False, True), ("Total for March 2024", True, False), ("Subtotal north", False, True), ("Total Care Soap, a large bar", False, False), ("Overall", True, True), ("Totally new", False, True), (None, False, False)])
def test_total_rows_by_either_rule(spark, cell, strict, loose):
    r = spark.createDataFrame([(cell,)], "c string").select(LD.is_total(F.col("c")).alias("s"), LD.is_total(F.col("c"), 12).alias("l")).first()
    assert (r["s"], r["l"]) == (strict, loose)


def test_rows_of_blanks_in_wide_tables(spark):
    width = 1100
    rows = [(0, [f"name {k}" for k in range(width)]), (1, [str(k) for k in range(width)]), (2, ["x"] + ["n/a"] * (width - 1)), (3, ["x", "y"] + [None] * (width - 2))]
    table, report = LD.tidy(spark.createDataFrame(rows, "row_id long, cells array<string>"))
    assert report.rows_out == 2 and table.count() == 2
