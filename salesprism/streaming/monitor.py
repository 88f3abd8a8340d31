"""Optional streaming forms of the batch operators: closed daily totals, and alerts that fire once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salesprism.operators.monitoring import alert_key


def daily_totals(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """(day, key, value, n) of a stream; append mode gives a day once the watermark has passed it."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", "1 day"), key).agg(F.sum(value).alias("value"), F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), key, "value", "n")


def once_per_key(alerts: DataFrame, time: str | None = None, late: str = "400 days") -> DataFrame:
    """Alerts (kind, subject, period) of a stream with their key, each key once.

    time: the column by which keys are forgotten `late` after the newest alert, so that state stays bounded; without
    one every key is remembered for good.
    """
    keyed = alerts.withColumn("key", alert_key(F.col("kind"), F.col("subject"), F.col("period")))
    if not time:
        return keyed.dropDuplicates(["key"])
    return keyed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def last_good_run(runs: DataFrame, time: str = "ts") -> DataFrame:
    """(dataset_id, ts, rows, median_value) of the newest run of each data set that wasn't held; one row of state a data set."""
    passed = runs.where(~F.col("held"))
    return passed.groupBy("dataset_id").agg(F.max_by(F.struct(time, "rows", "median_value"), time).alias("x")).select("dataset_id", "x.*")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there and ends; the next call goes on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
