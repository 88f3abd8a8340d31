"""The gate on whole files, runs of the engine against the catalogue, goals with bands, break-even, answers and names."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesprism.operators import descriptive as D
from salesprism.operators import inference as I
from salesprism.operators import monitoring as M
from salesprism.operators import periods as P
from salesprism.operators import quality as Q
from salesprism.plans import answers as A
from salesprism.plans import detection as DT
from salesprism.plans import engine as E
from salesprism.plans import findings as FN
from salesprism.plans import guards as G
from salesprism.sources.catalog import Catalog
from tests.generators import business

ROLES = {"date": "Order. Date", "product": "Item", "revenue": "Amount"}


@pytest.fixture(scope="module")
def shop(spark):
    return business(spark, False, seed=3, days=300).persist()


def as_file(s):
    return s.select(F.col("date").cast("string").alias("Order. Date"), F.col("product").alias("Item"), F.col("revenue").cast("string").alias("Amount"), F.col("order_id").alias("Order No"), F.col("channel").alias("Channel"))


def codes(raw, **kw):
    return dict(Q.issues(raw, dt.date(2025, 12, 31), roles=ROLES, **kw))


def test_the_gate_sees_rows_that_the_sales_table_drops(shop, spark):
    raw = as_file(shop)
    assert codes(raw) == {}
    third = F.hash("Order No") % 3 == 0
    assert codes(raw.withColumn("Order. Date", F.when(~third, F.col("`Order. Date`"))))["null_spike"] == Q.BLOCK
    assert codes(raw.withColumn("Order. Date", F.lit("n/a")))["no_dates"] == Q.BLOCK and codes(raw.withColumn("Amount", F.lit("?")))["no_values"] == Q.BLOCK
    assert codes(raw.union(raw))["duplicate_rows"] == Q.BLOCK
    # lines that are equal in what the engine keeps, but not in the file
    same = raw.withColumn("Amount", F.lit("5")).withColumn("Item", F.lit("a")).withColumn("Order. Date", F.lit("2024-03-01"))
    assert "duplicate_rows" not in codes(same)
    held = E.analyse(raw.withColumn("Order. Date", F.when(~third, F.col("`Order. Date`"))), as_of=dt.date(2025, 1, 1))
    assert held.held and not held.findings and [a["kind"] for a in held.alerts] == ["QUALITY"] and held.alerts[0]["subject"] == "null_spike"
    assert "held" in E.report(held)


def test_runs_are_kept_and_alerts_go_out_once(shop, spark, tmp_path):
    file = f"{tmp_path}/shop"
    broken = as_file(shop).withColumn("Item", F.when(F.hash("Order No") % 2 == 0, F.col("Item")))
    broken.coalesce(1).write.csv(file, header=True)
    path = next(str(p) for p in (tmp_path / "shop").glob("*.csv"))
    c = Catalog(spark, f"{tmp_path}/catalog")
    c.put("datasets", spark.createDataFrame([("d", "shop", path, None), ("e", "none", f"{tmp_path}/missing.csv", None)], "dataset_id string, name string, path string, recipient string"))
    done = E.tick(spark, c, as_of=dt.date(2025, 1, 1))
    assert done["d"] == "held" and done["e"] not in ("held", "done")
    assert c.read("alerts").count() == 1 and c.get("stories", "d") is None
    assert E.refresh(spark, c, "d", path, dt.date(2025, 1, 1)).alerts == []
    assert E.add_goal(spark, c, "g", "d", "margin", -1, dt.date(2025, 1, 2), dt.date(2025, 1, 1)) and not E.add_goal(spark, c, "g", "d", "revenue", 5, dt.date(2025, 1, 1), dt.date(2025, 2, 1))
    assert E.health(spark, c)["datasets"] == 2


def monthly(spark, values, product="a", cost=None, year=2022):
    rows = [(dt.date(year + i // 12, i % 12 + 1, 15), product, float(v), None if cost is None else float(v - cost[i]), f"o{i}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, product string, revenue double, profit double, order_id string").withColumn("quantity", F.lit(1.0))


def test_goals_have_bands_and_states(spark):
    rng = np.random.default_rng(1)
    s = monthly(spark, [100 + 3 * rng.standard_normal() for _ in range(30)] + [100.0])
    goals = spark.createDataFrame([("near", "revenue", 600.0, dt.date(2024, 2, 1), dt.date(2024, 8, 31)), ("far", "revenue", 3000.0, dt.date(2024, 2, 1), dt.date(2024, 12, 31)), ("later", "revenue", 10.0, dt.date(2025, 1, 1), dt.date(2025, 2, 1)), ("early", "revenue", 10.0, dt.date(2024, 7, 14), dt.date(2024, 12, 31)), ("profit", "profit", 10.0, dt.date(2024, 2, 1), dt.date(2024, 8, 31)), ("over", "revenue", 150.0, dt.date(2024, 1, 1), dt.date(2024, 2, 28))], "id string, metric string, target double, start date, end date")
    got = {r["id"]: r for r in M.goal_projection(s, goals).collect()}
    assert "profit" not in got  # nothing has a cost
    near, far = got["near"], got["far"]
    assert near["method"].startswith("ARIMA") and near["on_track"] and near["projected_low"] <= near["projected"] <= near["projected_high"] and abs(near["projected"] - 755) < 40
    assert far["needs_alert"] and not far["could_still_hit"] and got["later"]["state"] == "not_started" and got["early"]["projected"] is None
    assert got["over"]["method"] == "actual" and got["over"]["on_track"] and not got["over"]["needs_alert"]
    found = {f.id: f for f in FN.goal_findings(s, goals)}
    assert found["goal_far"].severity == "URGENT" and found["goal_near"].severity == "GOOD" and found["goal_later"].importance == 0.2
    assert [r["subject"] for r in M.goal_alerts(M.goal_projection(s, goals)).collect()] == ["far"]
    short = monthly(spark, [100.0, 80.0, 120.0, 100.0])
    r = M.goal_projection(short, spark.createDataFrame([("g", "revenue", 1000.0, dt.date(2022, 1, 1), dt.date(2022, 8, 31))], goals.schema)).first()
    assert r["method"] == "run rate" and r["projected_low"] < r["projected"] < r["projected_high"]


def test_profit_on_its_way_below_zero_is_urgent(spark):
    rng = np.random.default_rng(2)
    falling = [1000.0] * 24
    cost = [600 + 17.2 * i + 2 * rng.standard_normal() for i in range(24)]
    s = monthly(spark, falling, "lamp", cost).unionByName(monthly(spark, [900.0] * 24, "vase", [500 + 2 * rng.standard_normal() for _ in range(24)]))
    found = {f.id: f for f in FN.forecast_findings(s, P.MONTH)}
    lamp = found["forecast_lamp"]
    assert lamp.severity == "URGENT" and lamp.facts["crosses_break_even"] and 1 <= lamp.facts["crosses_in_periods"] <= 3 and lamp.facts["metric"] == "profit"
    assert found.get("forecast_vase") is None or not found["forecast_vase"].facts["crosses_break_even"]


def test_quantiles_shifts_and_gaps(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 1000, 501), rng.lognormal(3, 2, 200), [4.0], [1.0, 1.0, 1.0, 9.0], [-3.0, 0.0, 0.0, 8.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double")
        r = D.quantiles(df, low=0.1, mid=0.5, high=0.9, top=1.0).first()
        assert np.allclose([r["low"], r["mid"], r["high"], r["top"]], np.quantile(np.array(values, float), [0.1, 0.5, 0.9, 1.0]))
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 9, 11, 10, 12])], "period int, value double")
    r = I.level_shift_test(s, F.col("period") >= 3).first()
    assert r["t"] > 5 and r["p"] < 0.01 and (r["n_before"], r["n_after"]) == (3, 4)
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 5, 9)], "period date")
    assert tuple(P.median_gap(days).first()) == (3.0, 3)


def finding(i, kind, summary, **facts):
    return FN.Finding(i, kind, summary, "WATCH", 0.5, facts)


def test_answers_are_held_to_the_facts(spark):
    found = [finding("seasonality", "SEASONALITY", "December runs above.", peak_month=12), finding("revenue_trend", "TREND", "Revenue fell 12%.", change_pct=-0.12), finding("product_ranking", "RANKING", "Gift Box leads.", ranking=[["Gift Box (large)", 5.0, 0.4], ["Soap", 2.0, 0.2]])]
    cases = [
        ("Revenue fell 12%, and Gift Box leads.", [], []), ("Magic Lantern leads.", [], ["name:Magic Lantern"]), ("It rose.", [], ["direction:up"]), (" ", [], ["empty"]),
        ("Candles may be steady.", ["candles"], ["absent:candles"]), ("There is nothing about candles.", ["candles"], []),
    ]
    assert G.check_answers(spark, [(text, ["revenue_trend", "product_ranking"], absent) for text, absent, _ in cases], found) == [problems for _, _, problems in cases]
    assert A.unknown_subjects("How are candles doing in December?", found) == ["candles"]
    # the story's order decides between the findings of a route, stand-ins come after
    assert A.answer("Compare to last year", found)[1] == "seasonality" and A.answer("Compare to last year", found[1:])[1] == "revenue_trend"
    assert A.answer("Was it always like this, the trend?", found[:1])[1] == "seasonality"
    assert A.route_of("break down by region", ("channel",)) != "break_down_by_region" and A.open_routes(found, ())[:1]
    assert A.trimmed({"a": [1] * 5, "b": {"x": 1}, "c": 2}) == {"a": "<5 items>", "b": {"x": 1}, "c": 2}
    assert len(A.cache_key(found[0])) == 20 and A.cache_key(found[0]) != A.cache_key(found[1]) and A.explain(found[1]) and set(FN.CHARTS) <= set(A.EXPLANATIONS)
    assert not any(FN.advice_in(t) for t in (*A.EXPLANATIONS.values(), *A.GLOSSARY.values()))


@pytest.mark.parametrize(("names", "role"), [
    ("orderDate ORDERDATE Date_of_Order Trans._Date Sold_On Paid_at Week_Ending Posting_Date sale_dt Month", "date"), ("Item_Name ITEM_DESCRIPTION Stock_Code Part_No Variant_Title Lineitem_name Prod", "product"),
    ("Total_Revenue Net_Sales salesamount Line_Total Amount_(NGN) Grand_Total Extended_Price Takings value_sold Sales_Value", "revenue"), ("QTY_SOLD Units No._of_Items Pieces Nos Qnty", "quantity"),
    ("Price Price_Each Selling_Price Price_per_Unit MRP Rate", "unit_price"), ("COGS Cost_of_Goods_Sold Unit_Cost Buying_Price Landed_Cost Unit_Cost_Price", "cost"), ("CustomerID Cust_ID Buyer Billing_Name Member_No Email", "customer_id"),
    ("Order_No Invoice_Number Transaction_ID Docket_No Ref", "order_id"), ("Sales_Channel Order_Source Platform", "channel"), ("Shipping_City State LGA Territory", "region"), ("Discount_% Disc Promo Markdown", "discount"),
    ("Product_Type Department Sub_Category Brand", "category"), ("Paid_By Pay_Mode Payment_Type Tender", "payment_method"),
])
def test_names_lead_to_their_role(names, role):
    for name in names.split():
        scores = DT.name_scores(name.replace("_", " "))
        assert max(scores, key=scores.get) == role, (name, scores)
    assert not set(DT.name_scores("Sales Tax Amount")) & set(DT.MONEY)
