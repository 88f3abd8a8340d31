"""Guards of answers over tables: leaves of nested facts, numbers, names by words, signs, doubt, absence, and many answers at once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from salesprism.plans import guards as G

FACTS = {
    "revenue_trend": ("TREND", "Revenue fell 44% over 24 months.", {"change_pct": -0.44, "periods": 24, "direction": "down", "material": True, "none": None}, "strong"),
    "revenue_decomposition": ("DECOMPOSITION", "Linen Candle moved most.", {"total_change": -5321.5, "contributions": [{"label": "Linen Candle", "change": -2022.17}, {"label": "Soap", "change": -1.0}], "deep": {"a": [[1005, {"b": "Senator Set"}]]}}, "clear"),
    "segmentation_channel": ("SEGMENTATION", "Channels differ by 4%.", {"gap_pct": 0.04}, "worth a look"),
    "new_line": ("TREND", "Tea grew.", {"change_pct": 0.2, "sum": 12_345_678.0}, "strong"),
}


def findings(spark):
    return spark.createDataFrame([(k, kind, summary, json.dumps(facts), strength) for k, (kind, summary, facts, strength) in FACTS.items()], G.FINDINGS)


CASES = [
    ("Revenue fell 44%.", ["revenue_trend"], [], ""), ("Revenue fell 45%.", ["revenue_trend"], [], "number:45"), ("It moved 1,005 and 2,022.2.", ["revenue_decomposition"], [], ""), ("It moved 1005.", ["revenue_trend"], [], "number:1005"),
    ("About 12.3 million, 12345.7 thousand, or 12,345,678.", ["new_line"], [], ""), ("Linen Candle accounts for it.", ["revenue_decomposition"], [], ""), ("The Linen Candle and Senator Set fell.", ["revenue_decomposition"], [], ""),
    ("Bamboo Diffuser accounts for it.", ["revenue_decomposition"], [], "name:Bamboo Diffuser"), ("Linen Diffuser fell.", ["revenue_decomposition"], [], "name:Linen Diffuser"), ("It rose.", ["revenue_trend"], [], "direction:up"), ("It rose here and fell there.", ["revenue_trend", "new_line"], [], ""),
    ("It is upbeat.", ["revenue_trend"], [], ""), ("It fell because demand did.", ["revenue_trend"], [], "cause"), ("It fell because Soap did.", ["revenue_decomposition"], [], ""), ("Channels differ by 4%.", ["segmentation_channel"], [], "certainty"),
    ("Channels appear to differ by 4%.", ["segmentation_channel"], [], ""), ("Revenue fell 44%, channels differ by 4%.", ["revenue_trend", "segmentation_channel"], [], ""), ("You should drop it.", ["revenue_trend"], [], "advice"),
    ("word " * 161, ["revenue_trend"], [], "length"), ("word " * 160, ["revenue_trend"], [], ""), ("  ", ["revenue_trend"], [], "empty"), (None, None, None, "empty"), ("Revenue fell.", ["nobody"], [], "uncited"), ("Revenue fell.", None, None, "uncited"),
    ("Candles sell. Tea isn't there.", ["revenue_trend"], ["candles", "tea"], "absent:candles"), ("It fell 45% because You Should Magic things.", ["revenue_trend"], [], "cause, name:You Should Magic, number:45, advice"),
]


def test_every_kind_of_problem_in_one_table(spark):
    rows = [(f"{k:03d}", *c[:3]) for k, c in enumerate(CASES)]
    got = {r["answer_id"]: (r["shown"], r["problems"]) for r in G.verdicts(spark.createDataFrame(rows, G.ANSWERS), findings(spark)).collect()}
    assert len(got) == len(CASES)
    for k, (text, _, _, expected) in enumerate(CASES):
        wanted = ", ".join(sorted(expected.split(", "))) if expected else ""
        assert got[f"{k:03d}"] == (not wanted, wanted), (text, got[f"{k:03d}"])


def test_leaves_of_any_nesting(spark):
    leaves = {(r["id"], r["key"], r["text"], r["number"]) for r in G.fact_leaves(findings(spark)).collect()}
    assert {("revenue_decomposition", "a", None, 1005.0), ("revenue_decomposition", "b", "Senator Set", None), ("revenue_decomposition", "change", None, -2022.17), ("revenue_trend", "direction", "down", None)} <= leaves
    assert not any(r[1] in ("material", "none") for r in leaves)  # neither texts nor numbers
    assert G.signs(G.fact_leaves(findings(spark))).where("id = 'new_line'").collect()[0]["sign"] == 1


def test_names_meet_by_their_rarest_word(spark):
    """Labels that share a word with all others join by the other one."""
    n = 3000
    facts = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("TREND").alias("type"), F.lit("").alias("summary"), F.to_json(F.struct(F.concat(F.lit("House Q"), "id").alias("name"))).alias("facts"), F.lit("clear").alias("strength"))
    answers = spark.range(n).select(F.col("id").cast("string").alias("answer_id"), F.concat(F.lit("the House Q"), F.col("id") + n // 2, F.lit(" leads")).alias("text"))
    unknown = G.unknown_names(answers, G.fact_leaves(facts))
    assert unknown.count() == n // 2 and unknown.where(f"cast(answer_id as int) < {n // 2}").isEmpty()


def test_no_answers_and_no_findings(spark):
    none, empty = spark.createDataFrame([], G.ANSWERS), spark.createDataFrame([], G.FINDINGS)
    assert G.verdicts(none, findings(spark)).collect() == []
    assert [tuple(r) for r in G.verdicts(spark.createDataFrame([("a", "x", ["y"], [])], G.ANSWERS), empty).collect()] == [("a", False, "uncited")]
    broken = spark.createDataFrame([("f", "TREND", None, None, "clear")], G.FINDINGS)
    assert G.verdicts(spark.createDataFrame([("a", "fine", ["f"], None)], G.ANSWERS), broken).first()["shown"]


@pytest.mark.parametrize(("number", "forms"), [(0.125, {"0.13", "0.1", "0", "12.5", "13"}), (-1234.5, {"1234.5", "1235", "1.2", "1.23", "1"}), (7, {"7", "700", "0.01"})])
def test_forms_of_numbers(spark, number, forms):
    leaves = spark.createDataFrame([("f", "x", None, float(number))], "id string, key string, text string, number double")
    got = {r["number"] for r in G.allowed_numbers(spark.createDataFrame([], G.FINDINGS), leaves).collect()}
    assert forms <= got and len(got) <= 12
