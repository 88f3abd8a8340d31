"""Streams with keyed state against their batch forms, over restarts: the gate, months, alerts of repeated and simultaneous batches."""

from __future__ import annotations

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from salesprism.operators import quality as Q
from salesprism.sources.catalog import Catalog
from salesprism.streaming import gate as G
from salesprism.streaming.monitor import run_available

SNAPSHOT = "rows long, median_value double, last_date date"


def runs(seed, n=24):
    rng = random.Random(seed)
    out = []
    for d in ("a", "b"):
        rows, value = 1000, 50.0
        for k in range(n):
            now = (max(0, int(rows * rng.choice([1, 1.05, 1.02, 0.7, 0.4]))), value * rng.choice([1, 1.1, 0.95, 2, 4, 0.3]) if rng.random() < 0.95 else None, dt.date(2024, 1, 1) + dt.timedelta(days=k + rng.choice([0, 0, 0, -9])))
            out.append((d, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), *now, rng.random() < 0.1))
    return out


def test_codes_are_those_of_the_batch_form(spark):
    own = [r[2:5] for r in runs(1)] + [(0, None, None), (0, 0.0, dt.date(2024, 1, 1)), (10, 5.0, dt.date(2024, 1, 2))]
    rng = random.Random(2)
    for now, before in [(rng.choice(own), rng.choice(own)) for _ in range(25)]:
        expected = [r["code"] for r in Q.against_snapshot(spark.createDataFrame([now], SNAPSHOT), spark.createDataFrame([before], SNAPSHOT)).collect()]
        assert G.codes_against(now, before) == expected, (now, before)


def test_replayed_runs_give_the_verdicts_of_one_after_another_over_restarts(spark, tmp_path):
    own = sorted(runs(3), key=lambda r: r[1])
    expected, good = [], {}
    for d, ts, *now, held in own:
        codes = G.codes_against(tuple(now), good.get(d))
        held = held or any(Q.SEVERITY[c] == Q.BLOCK for c in codes)
        expected.append((d, ts, held, ",".join(codes)))
        if not held:
            good[d] = tuple(now)
    for part in range(3):
        chunk = own[part * 16 : part * 16 + 16]
        spark.createDataFrame(chunk, G.RUNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(G.RUNS).parquet(f"{tmp_path}/in")
        run_available(G.gate_runs(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(expected) and any(r[2] for r in got) and len({r[3] for r in got}) > 3


def test_months_close_by_the_calendar(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice("xy"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 100)), float(rng.randint(1, 9))) for _ in range(300)]
    events.sort(key=lambda e: e[1])
    schema = "event_type string, ts timestamp, value double"
    for part in range(3):
        spark.createDataFrame(events[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run_available(G.closed_months(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    expected = {}
    for k, ts, v in events:
        if ts < dt.datetime(2024, 4, 1):
            value, n = expected.get((k, ts.date().replace(day=1)), (0.0, 0))
            expected[k, ts.date().replace(day=1)] = (value + v, n + 1)
    got = {(r["key"], r["month"]): (r["value"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == expected and {m for _, m in got} == {dt.date(2024, m, 1) for m in (1, 2, 3)}


@pytest.mark.parametrize("at_once", [False, True])
def test_alerts_of_repeated_and_simultaneous_batches_are_there_once(spark, tmp_path, at_once):
    c = Catalog(spark, f"{tmp_path}/catalog")
    rows = spark.createDataFrame([("DROP", "high", f"s{k % 5}", "2024-01") for k in range(20)], "kind string, level string, subject string, period string")
    write = G.alert_sink(c, "d")
    if at_once:
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(lambda n: write(rows, n), range(2)))
    else:
        write(rows, 0)
        write(rows, 0)
        write(rows.union(spark.createDataFrame([("DROP", "high", "new", "2024-01")], rows.schema)), 1)
    alerts = c.read("alerts")
    assert alerts.count() == alerts.select("key").distinct().count() == (5 if at_once else 6)
    if not at_once:
        assert c._all("alerts").count() == 6  # the repeated batch has written nothing
