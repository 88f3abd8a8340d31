"""The gate over a stream of runs, months that close by event time, and alerts that repeated batches add once.

Keyed state holds the last good snapshot of each data set: a run is judged against it, and replaces it unless the run
is held. Calendar months have no fixed length, so no window closes them: their sums are keyed state with a timer at
each month's end, which gives the month out and forgets it. State lives in the checkpoint of the query, so a restart
goes on where the last batch ended.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from salesprism.operators.monitoring import alert_key
from salesprism.operators.quality import BLOCK, SEVERITY
from salesprism.sources.catalog import Catalog

RUNS = "dataset_id string, ts timestamp, rows long, median_value double, last_date date, held boolean"
VERDICTS = "dataset_id string, ts timestamp, held boolean, codes string"
MONTHS = "key string, month date, value double, n long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def codes_against(now: tuple, before: tuple | None) -> list[str]:
    """Codes of a snapshot (rows, median value, last date) against the last good one, as against_snapshot() has them for tables."""
    if before is None:
        return []
    out = []
    if before[0]:
        change = now[0] / before[0] - 1
        out += ["row_count_collapse"] if change <= -0.5 else ["row_count_drop"] if change <= -0.25 else []
    if now[1] is not None and before[1]:
        ratio = now[1] / before[1]
        out += ["distribution_shift"] if ratio > 3 or ratio < 1 / 3 else ["value_shift"] if ratio > 1.6 or ratio < 1 / 1.6 else []
    return out + (["history_went_backwards"] if now[2] is not None and before[2] is not None and now[2] < before[2] else [])


def _none(x):
    import pandas as pd

    return None if pd.isna(x) else x


class Gate(StatefulProcessor):
    """Runs of a data set in order of time, each against the last one that passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_good", "ts timestamp, rows long, median_value double, last_date date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        own = pd.concat(list(rows)).sort_values("ts", kind="stable")
        held_before = self.last.get() if self.last.exists() else None
        good, out = (tuple(held_before)[1:] if held_before else None), []
        newest = tuple(held_before)[0] if held_before else None
        for r in own.itertuples():
            now = (int(r.rows), _none(r.median_value), _none(r.last_date))
            found = codes_against(now, good)
            held = bool(r.held) or any(SEVERITY[c] == BLOCK for c in found)
            out.append((key[0], r.ts, held, ",".join(found)))
            if not held:
                good, newest = now, r.ts.to_pydatetime()
        if good is not None:
            self.last.update((newest, *good))
        yield pd.DataFrame(out, columns=["dataset_id", "ts", "held", "codes"])

    def close(self) -> None:
        pass


def gate_runs(runs: DataFrame) -> DataFrame:
    """Verdicts (dataset_id, ts, held, codes) of a stream of runs (dataset_id, ts, rows, median_value, last_date, held); held: what the file alone came to."""
    with_state(runs.sparkSession)
    return runs.groupBy("dataset_id").transformWithStateInPandas(statefulProcessor=Gate(), outputStructType=VERDICTS, outputMode="Append", timeMode="None")


def month_end(month: dt.date) -> int:
    """Milliseconds at which the month is over, in UTC."""
    following = (month.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return int(dt.datetime(following.year, following.month, 1, tzinfo=dt.UTC).timestamp() * 1000)


class Months(StatefulProcessor):
    """Sums of a key by month; a month goes out when the watermark passes its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "month date", "value double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        for batch in rows:
            sums = batch.assign(month=batch["time"].dt.to_period("M").dt.to_timestamp()).groupby("month")["value"].agg(["sum", "count"])
            for month, r in sums.iterrows():
                at = (month.date(),)
                known = self.open.getValue(at) if self.open.containsKey(at) else (0.0, 0)
                if known[1] == 0:
                    self.handle.registerTimer(month_end(month.date()))
                self.open.updateValue(at, (float(known[0] + r["sum"]), int(known[1] + r["count"])))
        yield pd.DataFrame(columns=["key", "month", "value", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        over, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for at in [tuple(k) for k in self.open.keys()]:
            if month_end(at[0]) <= over:
                value, n = self.open.getValue(at)
                out.append((key[0], at[0], value, n))
                self.open.removeKey(at)
        yield pd.DataFrame(out, columns=["key", "month", "value", "n"])

    def close(self) -> None:
        pass


def closed_months(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """(key, month, value, n) of a stream, each month once, when the newest event is `late` past its end; later events of it are left out."""
    with_state(events.sparkSession)
    t = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value")).withWatermark("time", late)
    return t.groupBy("key").transformWithStateInPandas(statefulProcessor=Months(), outputStructType=MONTHS, outputMode="Append", timeMode="EventTime")


def alert_sink(catalog: Catalog, dataset_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: alerts (kind, level, subject, period) of a batch that the catalogue doesn't have yet are added, under the batch's number.

    A batch that is repeated finds its own keys and adds nothing; of two writers at once the first to write a key counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("key", alert_key(F.col("kind"), F.col("subject"), F.col("period"))).dropDuplicates(["key"])
        catalog.put_new("alerts", keyed.select("key", F.lit(dataset_id).alias("dataset_id"), "kind", "level", "subject", F.col("period").cast("string").alias("period"), F.lit(False).alias("acknowledged")))

    return write
