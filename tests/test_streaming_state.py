"""Streams whose state stays bounded: alerts once per key within a time, the last good run of each data set."""

from __future__ import annotations

import datetime as dt

from salesprism.streaming import monitor


def test_alerts_once_and_last_good_runs(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    alerts = [("a", "x", "2024-01", day(0)), ("a", "x", "2024-01", day(3)), ("a", "y", "2024-01", day(4)), ("b", "x", "2024-01", day(5))]
    schema = "kind string, subject string, period string, ts timestamp"
    spark.createDataFrame(alerts, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    monitor.run_available(monitor.once_per_key(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r["kind"], r["subject"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "x"), ("a", "y"), ("b", "x")]

    runs = [("d", day(0), 10, 5.0, False), ("d", day(2), 12, 6.0, False), ("d", day(3), 1, 0.5, True), ("e", day(1), 7, 2.0, True)]
    schema = "dataset_id string, ts timestamp, rows long, median_value double, held boolean"
    spark.createDataFrame(runs, schema).write.parquet(f"{tmp_path}/runs")
    last = monitor.last_good_run(spark.readStream.schema(schema).parquet(f"{tmp_path}/runs"))
    q = last.writeStream.outputMode("complete").format("memory").queryName("last_runs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("last_runs").collect()] == [("d", day(2), 12, 6.0)]
