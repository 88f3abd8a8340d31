"""Findings ask a table several times; it is computed once, and few analyses plan at a time."""

from __future__ import annotations

import datetime as dt

import pytest

from salesprism.operators import periods as P
from salesprism.plans import findings as FN
from tests.passes import counted


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(days=i), f"item {(i * 7 + k) % 5}", float(10 + i % 13 + k), f"o{i}", f"c{i % 40}") for i in range(360) for k in range(2)]
    return spark.createDataFrame(rows, "date date, product string, revenue double, order_id string, customer_id string")


@pytest.mark.parametrize(("analysis", "reads"), [(FN.rfm_finding, 2), (FN.spread_finding, 1), (FN.ranking_finding, 1), (FN.lifecycle_findings, 1), (FN.repeat_finding, 4)])
def test_sales_are_read_once_for_all_that_a_finding_asks(spark, sales, analysis, reads):
    own, read = counted(sales)
    analysis(own, P.MONTH)
    assert read.value <= reads * 720


def test_few_analyses_plan_at_a_time(spark, sales, monkeypatch):
    """The driver of a small cluster has room for two plans and the threads of their stages."""
    import threading
    import time

    lock, now, most = threading.Lock(), [0], [0]

    def slow(s, frequency):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return []

    monkeypatch.setattr(FN, "ANALYSES", (slow,) * 8)
    FN.collect_findings(sales)
    assert most[0] <= 2
