"""What compares parts of the time says nothing about two or three periods, and speaks from four on."""

from __future__ import annotations

import datetime as dt

import pytest

from salesprism.plans import findings as FN

COMPARING = {"revenue_decomposition", "price_volume_split", "products_stopped", "products_arrived", "repeat_vs_new"}


def days(spark, n, products=("A", "B", "C")):
    """Sales that grow and turn to other products from day to day."""
    rows = []
    for d in range(n):
        for k in range(24):
            product = products[(k + d) % len(products)] if d < n - 2 or len(products) < 3 else products[-1 - k % 2]
            rows.append((dt.date(2024, 3, 1) + dt.timedelta(days=d), product, float(10 + 6 * d + k % 5), float(1 + d), f"c{(k * (1 if d < 2 else 3) + 5 * (d > 1)) % 30}", f"o{d}-{k}", "web" if (k + d) % 3 else "shop"))
    return spark.createDataFrame(rows, "date date, product string, revenue double, quantity double, customer_id string, order_id string, channel string").selectExpr("*", "cast(null as double) as profit", "revenue / quantity as unit_price")


@pytest.mark.parametrize("n", [2, 3])
def test_short_files_are_not_compared(spark, n):
    found, errors = FN.collect_findings(days(spark, n))
    assert not errors and not {f.id for f in found} & COMPARING and not any(f.id.startswith("decomposition_") for f in found)


def test_four_periods_are(spark):
    found, errors = FN.collect_findings(days(spark, 5))
    ids = {f.id for f in found}
    assert not errors and {"revenue_decomposition", "products_stopped"} <= ids


def test_one_product_neither_stops_nor_arrives(spark):
    found, _ = FN.collect_findings(days(spark, 6, ("A",)))
    assert not {f.id for f in found} & {"products_stopped", "products_arrived"}
