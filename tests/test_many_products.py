"""Findings over more products than fit any list."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesprism.operators import periods as P
from salesprism.plans import findings as FN

N = 2600


@pytest.fixture(scope="module")
def many(spark):
    """Eight months of N products; the last one leads, the one before it loses money and the third from the end moves most."""
    t = spark.range(N * 8).select((F.col("id") % N).alias("i"), F.floor(F.col("id") / N).cast("int").alias("m"))
    name = F.format_string("p%05d", "i")
    first = F.when(F.col("i") == N - 1, 5000.0).when(F.col("i") == N - 3, F.when(F.col("m") < 4, 1000.0).otherwise(4000.0)).otherwise(10.0)
    t = t.select("i", "m", name.alias("product"), F.add_months(F.lit("2024-01-31").cast("date"), F.col("m")).alias("date"), first.alias("revenue"))
    profit = F.when(F.col("i") == N - 2, -5.0).otherwise(F.col("revenue") / 2)
    return t.select("product", "date", "revenue", profit.alias("profit")).repartition(4, "product").persist()


def test_nothing_is_cut_before_it_is_ranked(many):
    total = 8 * (5000.0 + 2500.0 + 10.0 * (N - 2))
    ranking = FN.ranking_finding(many, P.MONTH)[0].facts
    assert ranking["item_count"] == N and ranking["leader"] == f"p{N - 1:05d}" and [r[0] for r in ranking["ranking"][:2]] == [f"p{N - 1:05d}", f"p{N - 3:05d}"] and len(ranking["ranking"]) == 20
    assert ranking["ranking"][0][2] == pytest.approx(8 * 5000.0 / total)
    margin = {f.id: f.facts for f in FN.margin_findings(many, P.MONTH)}["loss_making_product"]
    assert margin["product"] == f"p{N - 2:05d}" and margin["item_count"] == N and margin["revenue_share"] == pytest.approx(80.0 / total)
    moved = FN.decomposition_finding(many, P.MONTH)[0].facts
    assert moved["total_change"] == pytest.approx(3000.0) and moved["largest_mover"] == f"p{N - 3:05d}" and moved["item_count"] == N
    # the items that moved most by name, all others as one, adding up exactly
    named = moved["contributions"]
    assert len(named) == FN.NAMED_CONTRIBUTIONS + 1 and named[-1]["label"] == f"{N - FN.NAMED_CONTRIBUTIONS} others" and sum(c["change"] for c in named) == pytest.approx(3000.0)
    classes = FN.classes_finding(many, P.MONTH)[0].facts
    assert classes["products"] == N and classes["tail_count"] == N - 2 and classes["tail_share"] == pytest.approx(80.0 * (N - 2) / total)
    assert classes["vital_share"] == pytest.approx(0.8, abs=1e-3)


def test_all_pairs_are_tested(spark):
    """70 products have 2,415 pairs; the last two move together exactly."""
    t = spark.range(70 * 8).select((F.col("id") % 70).alias("i"), F.floor(F.col("id") / 70).cast("int").alias("m"))
    noise = F.pmod(F.xxhash64("i", "m"), F.lit(1000)).cast("double")
    same = F.pmod(F.xxhash64(F.lit(1), "m"), F.lit(1000)).cast("double")
    s = t.select(F.format_string("p%02d", "i").alias("product"), F.add_months(F.lit("2024-01-31").cast("date"), F.col("m")).alias("date"), (F.when(F.col("i") >= 68, same).otherwise(noise) + 1).alias("revenue"))
    f = FN.relationship_finding(s, P.MONTH)[0].facts
    assert f["pairs_tested"] == 70 * 69 // 2 and f["pairs"][0][:2] == ["p68", "p69"]


def test_stopped_products_are_counted_before_the_list_is_cut(many):
    gone = many.where(~((F.substring("product", 2, 5).cast("int") < 300) & (F.col("date") > "2024-06-30")))
    f = FN.lifecycle_findings(gone, P.MONTH)[0]
    assert f.id == "products_stopped" and f.facts["count"] == 300 and f.summary.startswith("300 products") and len(f.facts["stopped"]) == 10


def test_a_story_fails_with_its_analyses(many, monkeypatch):
    def broken(s, frequency):
        raise RuntimeError("the job died")

    monkeypatch.setattr(FN, "ANALYSES", (FN.ranking_finding, broken))
    with pytest.raises(RuntimeError, match="died"):
        FN.story(many)
    assert list(FN.collect_findings(many)[1]) == ["broken"]
