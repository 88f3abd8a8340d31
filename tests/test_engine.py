"""Planted businesses, the gate, messy files, roles, text guards and stores."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesprism.functions import cleaning as C
from salesprism.functions import text as X
from salesprism.operators import descriptive as D
from salesprism.operators import monitoring as M
from salesprism.operators import periods as P
from salesprism.operators import quality as Q
from salesprism.plans import answers as A
from salesprism.plans import detection as DT
from salesprism.plans import digest as G
from salesprism.plans import findings as FN
from salesprism.plans import guards as GD
from salesprism.plans.engine import analyse_file
from salesprism.sources import loading as LD
from salesprism.sources.catalog import Catalog
from salesprism.streaming import monitor
from tests.generators import business, workbook


@pytest.fixture(scope="module")
def falling(spark):
    return business(spark, True).persist()


@pytest.fixture(scope="module")
def flat(spark):
    return business(spark, False, seed=2).persist()


def test_planted_decline_is_found(falling):
    found = {f.id: f for f in FN.trend_finding(falling, P.MONTH) + FN.margin_findings(falling, P.MONTH) + FN.dimension_findings(falling, P.MONTH) + FN.price_volume_finding(falling, P.MONTH)}
    assert found["revenue_trend"].severity == "URGENT" and found["loss_making_product"].facts["product"] == "Gift Box"
    assert found["decomposition_channel"].facts["driver"] == "online" and found["price_volume_split"].facts["dominant"] == "volume"


def test_flat_business_has_no_significant_finding(flat):
    found = FN.trend_finding(flat, P.MONTH) + FN.dimension_findings(flat, P.MONTH) + FN.relationship_finding(flat, P.MONTH)
    assert all(f.type == "NOISE" for f in found)
    assert M.anomalies(P.by_period(P.whole_periods(flat, P.MONTH), P.MONTH).withColumn("subject", F.lit("all"))).count() == 0


def test_contributions_add_up(falling):
    rows = D.decomposition(falling).collect()
    series = P.half_means(P.by_period(P.whole_periods(falling, P.MONTH), P.MONTH)).first()
    assert abs(sum(r["change"] for r in rows) - (series["after"] - series["before"])) < 1e-6
    r = D.price_volume_split(falling).first()
    assert abs(r["volume_effect"] + r["price_effect"] - r["total_change"]) < 1e-6


def test_periods(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 31), 1.0), (dt.date(2024, 4, 2), 2.0)], "date date, revenue double")
    assert [(str(r[0]), r[1]) for r in P.by_period(s, P.MONTH).orderBy("period").collect()] == [("2024-01-01", 1.0), ("2024-02-01", 0.0), ("2024-03-01", 0.0), ("2024-04-01", 2.0)]
    assert P.whole_periods(s, P.MONTH).count() == 1 and str(s.select(P.period_of(P.WEEK)).first()[0]) == "2024-02-04"
    assert P.natural_frequency(dt.date(2024, 1, 1), dt.date(2024, 3, 15)) == P.WEEK


def _codes(df, **kw):
    return dict(Q.issues(df, kw.pop("as_of", dt.date(2025, 12, 31)), **kw))


def test_gate(flat, spark):
    raw = flat.select("date", "product", "revenue", "order_id")
    last = Q.snapshot(raw)
    assert _codes(raw, previous=last) == {}
    assert _codes(raw.union(raw))["duplicate_rows"] == Q.BLOCK
    assert _codes(raw.withColumn("revenue", F.when(F.hash("order_id") % 2 == 0, F.col("revenue"))))["null_spike"] == Q.BLOCK
    assert _codes(raw.where("month(date) not in (5, 6)"))["date_gaps"] == Q.BLOCK
    assert _codes(raw, as_of=dt.date(2024, 6, 1))["future_dates"] == Q.BLOCK
    assert _codes(raw.withColumn("revenue", F.col("revenue") * 100), previous=last)["distribution_shift"] == Q.BLOCK
    early = _codes(raw.where("date < '2024-05-01'"), previous=last)
    assert early["history_went_backwards"] == Q.BLOCK and early["row_count_collapse"] == Q.BLOCK
    assert _codes(raw.withColumn("revenue", -F.col("revenue")))["mostly_negative"] == Q.BLOCK
    assert _codes(raw.where("false")) == {"empty_file": Q.BLOCK} and Q.holds([("x", Q.BLOCK)]) and not Q.holds([("x", Q.WARN)])


def test_cells(spark):
    texts = ["N1,234.00", "(5)", "12-", "₦ 7", "n/a", "usd 3", "1e3", "abc", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(C.parsed_number(F.col("t"))).collect()] == [1234.0, -5.0, -12.0, 7.0, None, 3.0, 1000.0, None, None]
    pct = spark.createDataFrame([("10%",), ("5 %",), ("3",)], "t string")
    assert sorted(r["v"] for r in C.to_numeric(pct, "t", "v").collect()) == [0.03, 0.05, 0.1]
    days = spark.createDataFrame([("13/02/2024",), ("03/02/2024",), ("2024-02-05",)], "t string")
    assert sorted(str(r["d"]) for r in C.to_datetime(days, "t", "d").collect()) == ["2024-02-03", "2024-02-05", "2024-02-13"]
    serials = spark.createDataFrame([("45292",), ("45293",)], "t string")
    assert sorted(str(r["d"]) for r in C.to_datetime(serials, "t", "d").collect()) == ["2024-01-01", "2024-01-02"]
    labels = spark.createDataFrame([("In-Store",), ("in store",), ("In-Store",), ("Online",)], "t string")
    assert sorted(r["x"] for r in C.to_labels(labels, "t", "x").collect()) == ["In-Store", "In-Store", "In-Store", "Online"]


@pytest.mark.parametrize(
    ("name", "role"),
    [("Order_Date", "date"), ("invoice dt", "date"), ("Item Descrption", "product"), ("SKU", "product"), ("QTY", "quantity"), ("unitsSold", "quantity"), ("Amount (₦)", "revenue"), ("Total Paid", "revenue"), ("Unit Price", "unit_price"), ("cost price", "cost"), ("discount_amount", "discount"), ("Customer ID", "customer_id"), ("Order Number", "order_id"), ("Sales Channel", "channel"), ("Branch", "region"), ("Product Category", "category"), ("Mode of Payment", "payment_method")],
)
def test_names(name, role):
    scores = DT.name_scores(name)
    assert max(scores, key=scores.get) == role
    assert not set(DT.name_scores("Shipping Fee Amount")) & {"revenue", "cost"}


def test_messy_workbook_to_story(spark, tmp_path, falling):
    rows = falling.limit(900).collect()
    head = [["The shop", None, None, None, None], [None] * 5, ["Order Date", "Item", "Qty", "Amount Paid", "Sales Channel"]]
    body = [[r["date"].strftime("%d/%m/%Y"), r["product"] if i % 9 else r["product"].upper(), r["quantity"], f"N{r['revenue']:,.2f}", r["channel"]] for i, r in enumerate(rows)]
    body.insert(50, ["Subtotal", None, None, "N1,000.00", None])
    body.append(["GRAND TOTAL", None, None, "N9,999.00", None])
    workbook(f"{tmp_path}/shop.xlsx", {"Sales": head + body, "Notes": [["a", "b"], ["x", "y"]]})
    table, report = LD.load(spark, f"{tmp_path}/shop.xlsx")
    assert table.columns == head[2] and report.rows_out == 900 and report.skipped == ["Notes"]
    out = analyse_file(spark, f"{tmp_path}/shop.xlsx", as_of=dt.date(2026, 1, 1))
    assert out.detection.roles["revenue"] == "Amount Paid" and out.detection.roles["date"] == "Order Date" and not out.errors
    assert out.held or any(f.id == "product_ranking" for f in out.findings)
    assert DT.fingerprint(DT.profile(table)) == out.detection.fingerprint


def test_delimited_file_and_monthly_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report;;\nDate;Product;Total\n2024-01-01;Total Care Soap;5\n2024-01-02;Oil;6\nTotal;;11\n")
    table, report = LD.load(spark, f"{tmp_path}/a.csv")
    assert sorted(r["Product"] for r in table.collect()) == ["Oil", "Total Care Soap"] and report.rows_out == 2
    rows = [["Date", "Item"], ["2024-01-01", "x"]]
    workbook(f"{tmp_path}/m.xlsx", {"Jan": rows, "Feb": rows})
    table, report = LD.load(spark, f"{tmp_path}/m.xlsx")
    assert sorted(r[LD.SHEET] for r in table.collect()) == ["Feb", "Jan"]
    assert LD.unique_names(["a", "A", None, "Unnamed: 3"]) == ["a", "A_2", "column_3", "column_4"]
    with pytest.raises(ValueError, match="type"):
        LD.load(spark, "x.doc")


def test_alerts_fire_once(spark):
    a = spark.createDataFrame([("k", "low", "s", "2024", 2), ("k", "high", "s", "2024", 1), ("j", "high", "s", "2024", 3)], "kind string, level string, subject string, period string, seq int")
    fresh = M.fresh_alerts(a, spark.createDataFrame([], "key string"))
    assert [r["seq"] for r in fresh.collect()] == [1, 3]
    assert M.fresh_alerts(a, fresh).count() == 0 and len(fresh.first()["key"]) == 16
    assert fresh.first()["key"] == G.alert_key("k", "s", "2024")


def test_robust_scores(spark):
    v = [(float(x),) for x in [10] * 20 + [40, 50]]
    z = sorted(r["z"] for r in M.robust_scores(spark.createDataFrame(v, "value double")).collect())
    assert z[-1] > z[-2] > 3.5 and z[0] == 0
    assert {r["z"] for r in M.robust_scores(spark.createDataFrame([(3.0,)] * 4, "value double")).collect()} == {0.0}


def test_text_guards(spark):
    f = FN.Finding("revenue_decomposition", "DECOMPOSITION", "Revenue fell 12%.", "WATCH", 0.8, {"change_pct": -0.12, "contributions": [{"label": "a", "change": -3.0, "share_of_change": 1.0}]})
    said = GD.check_answers(spark, [("Revenue fell 12% because of a.", [f.id], []), ("It rose 12%.", [f.id], []), ("It fell 13%.", [f.id], []), ("x", ["y"], [])], [f])
    assert said == [[], ["direction:up"], ["number:13"], ["uncited"]]
    assert A.answer("Why did it happen?", [f]) == ("Revenue fell 12%.", f.id) and A.answer("hm", [f])[1] is None
    assert FN.advice_in("You should raise the price") and not FN.advice_in("Revenue rose")
    d = G.digest([f], [])
    assert G.as_text(d) == "- Revenue fell 12%." and "<li" in G.as_html(d) and "12%" in G.export_html([f]) and "revenue_decomposition" in G.export_json([f])
    q = spark.createDataFrame([(1, "Which products are most profitable, margin?"), (2, "zzz")], "i int, t string")
    assert [(r["i"], r["route"]) for r in X.route_scores(q, "i", "t").collect()] == [(1, "most_profitable")]
    t = spark.createDataFrame([("1,200.50 and 3.0. Next", )], "t string").select(X.numbers_in(F.col("t")), X.first_sentence(F.col("t")), X.known_terms(F.lit("gross margin here"), ["margin", "gross margin"])).first()
    assert t[0] == ["1200.5", "3"] and t[1] == "1,200.50 and 3.0." and t[2] == ["gross margin"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/catalog")
    row = lambda name: spark.createDataFrame([("d", name, "p", None)], "dataset_id string, name string, path string, recipient string")
    assert c.get("datasets", "d") is None
    c.put("datasets", row("one"))
    c.put("datasets", row("two"))
    assert c.get("datasets", "d")["name"] == "two"
    c.put_new("datasets", row("three"))
    assert c.get("datasets", "d")["name"] == "two"
    c.delete("datasets", "d")
    assert c.get("datasets", "d") is None


def test_streaming_gives_closed_days(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, 6 * (i % 4)), "a", 1.0) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = monitor.run_available(monitor.daily_totals(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {str(r["day"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01"] == 4.0 and "2024-01-05" not in got


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 50
