"""Trend and anomalies of sales with a strong season."""

from __future__ import annotations

import datetime as dt
import math

from salesprism.operators import periods as P
from salesprism.plans import digest as G
from salesprism.plans import findings as FN


def _sales(spark, months: int, slope: float = 0.0, drop: bool = False):
    """Two products, each with a peak in December; with `drop`, b sells a tenth in the last month."""
    rows = []
    for i in range(months):
        date = dt.date(2021 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(days=1)
        season = 2.5 if i % 12 == 11 else 1 + 0.02 * math.sin(i * 7)
        for product in ("a", "b"):
            low = 0.1 if drop and product == "b" and i == months - 1 else 1.0
            rows.append((date, product, round(1000 * season * (1 + slope * i) * low + 7 * (i * 37 % 11), 2)))
    return spark.createDataFrame(rows, "date date, product string, revenue double")


def test_trend_is_seen_through_the_season(spark):
    f = FN.trend_finding(_sales(spark, 36, -0.004), P.MONTH)[0]
    assert f.type == "TREND" and f.severity == "URGENT" and f.p_value < 0.01


def test_a_peak_of_the_season_is_no_anomaly_but_a_drop_is_an_alert(spark):
    assert FN.anomaly_findings(_sales(spark, 36), P.MONTH) == []
    found = {f.id: f for f in FN.anomaly_findings(_sales(spark, 46, drop=True), P.MONTH)}
    assert "anomaly_b" in found and "anomaly_a" not in found and found["anomaly_b"].type == "ANOMALY_DROP"
    alert = {a["subject"]: a for a in G.finding_alerts(list(found.values()), "2024-12")}["anomaly_b"]
    assert alert["kind"] == "ANOMALY_DROP" and alert["period"] == "2024-10-01"
    assert G.digest(list(found.values()), [alert])["alerts"] == [alert]
