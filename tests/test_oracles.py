"""A dozen registered queries against their SQL on the smallest tables; bench and driver cover the rest."""

from __future__ import annotations

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ("product_ranking", "period_sum_month", "margin_by_product", "concentration_stats", "revenue_decomposition", "lifecycle_status", "order_value_quantiles", "trend_regression", "rfm_scores", "cohort_retention", "basket_lift", "anomaly_candidates", "label_folding", "keyword_routing")


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    own = e.queries()[name](spark, DATA)
    cols = sorted(own.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in own.toArrow().to_pylist()), key=repr)
    found = con.execute(e.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
