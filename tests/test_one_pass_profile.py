"""Profiles read a table once, whatever they measure of it; numbers are read as before."""

from __future__ import annotations

from salesprism.functions import cleaning as C
from salesprism.plans import detection as T
from tests.passes import counted


def test_profiles_read_their_table_once(spark):
    rows = [(f"2024-0{i % 9 + 1}-05", f"item {i % 7}", f"{i * 1.5:.2f}") for i in range(300)]
    df, read = counted(spark.createDataFrame(rows, "day string, item string, amount string"))
    got = T.profile(df)
    assert read.value == 300 and got["amount"]["median"] == 224.25 and got["day"]["dates"] == 300 and got["item"]["distinct"] == 7
    df, read = counted(spark.createDataFrame(rows, "day string, item string, amount string"))
    # one pass for the spellings, one for the number of rows
    table = {r["column"]: r for r in T.profile_table(df).collect()}
    assert read.value <= 600 and table["amount"]["n_unique"] == 300 and table["day"]["date_span_days"] == 244


def test_numbers_are_read_in_any_form(spark):
    cells = {"12": 12.0, " 12.50 ": 12.5, "-3": -3.0, "+4.": 4.0, ".5": 0.5, "1e3": 1000.0, "1,200": 1200.0, "(7.5)": -7.5, "8-": -8.0, "₦ 9": 9.0, "USD 1 000": 1000.0, "N5": 5.0, "15%": 15.0, "\t6": 6.0, ".": None, "-": None, "n/a": None, "": None, "abc": None, "1x": None, "2024-01-02": None, "--5": None, None: None}
    t = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["v"] for r in t.select("c", C.parsed_number(C.named("c")).alias("v")).collect()} == cells
