"""Robust scores, anomalies of series, alerts that fire once, goals and their pace."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.seasonal import seasonal_parts
from salesprism.functions.stats import benjamini_hochberg, normal_p
from salesprism.operators.descriptive import product_ranking
from salesprism.operators.periods import DAY, MONTH, SEASONS, WEEK, by_period, filled, half_means, kept_sums, money, period_of, spread_out, whole_sums, with_half
from salesprism.scratch import written

LEVELS = {"high": 0, "medium": 1, "low": 2}


def robust_scores(series: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """series with median and z: 0.6745 (x - median) / MAD, 0.7979 (x - median) / mean deviation if MAD is 0, else 0."""
    by = list(keys)
    middle = series.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    t = series.join(middle, by) if by else series.crossJoin(middle)
    t = t.withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = t.groupBy(*by).agg(F.percentile("_off", F.lit(0.5)).alias("mad"), F.avg("_off").alias("mean_dev"))
    t = t.join(spread, by) if by else t.crossJoin(spread)
    off = F.col(value) - F.col("median")
    return t.withColumn("z", F.when(F.col("mad") > 0, 0.6745 * off / F.col("mad")).when(F.col("mean_dev") > 0, 0.7979 * off / F.col("mean_dev")).otherwise(0.0)).drop("_off", "mean_dev")


def anomalies(series: DataFrame, recent: int = 2, z: float = 3.5, share: float = 0.2, least: int = 8, scored: str = "value") -> DataFrame:
    """Of (subject, period, value): recent points far out (by `scored`) and far from the median of the values, the strongest of each subject, adjusted."""
    w = Window.partitionBy("subject")
    t = robust_scores(series, "subject", value=scored).withColumn("median", F.percentile("value", F.lit(0.5)).over(w)).withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.col("period").desc())))
    hits = t.where((F.col("n") >= least) & (F.col("back") <= recent) & (F.abs("z") >= z) & (F.abs(F.try_divide(F.col("value") - F.col("median"), F.abs("median"))) >= share))
    best = hits.groupBy("subject").agg(F.max_by(F.struct("period", "value", "median", "z"), F.struct(F.abs("z"), "period")).alias("x"), F.count("*").alias("run")).select("subject", "x.*", "run")
    best = best.withColumn("p", normal_p(F.col("z"))).withColumn("kind", F.when(F.col("z") < 0, "ANOMALY_DROP").otherwise("ANOMALY_SPIKE"))
    return benjamini_hochberg(best, "p", "subject")


def sales_anomalies(sales: DataFrame, frequency: str = MONTH, least_share: float = 0.05, cap: int = 6) -> DataFrame:
    """anomalies() of the whole business (subject "", a test of its own) and of products from 5 % of revenue, less the season where two cycles are there."""
    sums = kept_sums(sales, frequency, "product", value="revenue")
    whole = whole_sums(sums, frequency)
    names = [r["product"] for r in product_ranking(sums, measure="value").where((F.col("share") >= least_share) & (F.col("value") > 0)).collect()]
    total = spread_out(whole.groupBy("period").agg(money("value").alias("value")), frequency, "value").withColumn("subject", F.lit(""))
    cells = filled(whole.groupBy("period", F.when(F.col("product").isin(names), F.col("product")).alias("subject")).agg(money("value").alias("value")), "subject").where("subject is not null")
    series = seasonal_parts(total.unionByName(cells), SEASONS[frequency]).withColumn("scored", F.coalesce("adjusted", "value"))
    found = anomalies(series, least=8, scored="scored").where("median > 0").drop("adjusted").withColumn("kind", F.when(F.col("value") < F.col("median"), "ANOMALY_DROP").otherwise("ANOMALY_SPIKE")).withColumn("_whole", F.col("subject") == "")
    return benjamini_hochberg(found, "p", "subject", family="_whole").where("adjusted < 0.05").drop("_whole").orderBy(F.abs("z").desc(), "subject").limit(cap)


def alert_key(kind: Column, subject: Column, period: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", kind, subject, period.cast("string")), 256), 1, 16)


def fresh_alerts(alerts: DataFrame, sent: DataFrame, cap: int = 6) -> DataFrame:
    """(kind, level, subject, period, seq): the first of each key that wasn't sent, by level, `cap` at most."""
    keyed = alerts.withColumn("key", alert_key(F.col("kind"), F.col("subject"), F.col("period")))
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("_r = 1").drop("_r")
    level = F.coalesce(F.element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), F.col("level")), F.lit(9))
    return first.join(sent.select("key"), "key", "left_anti").orderBy(level, "seq").limit(cap)


def quality_alerts(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(code, {"BLOCK": "high", "WARN": "medium"}[severity]) for code, severity in found if severity != "INFO"]


ALERT = "kind string, level string, subject string, period string, text string, seq long"


def goal_alerts(progress: DataFrame) -> DataFrame:
    """An alert for each goal that is out of reach."""
    text = F.concat(F.lit("The goal "), F.col("id"), F.lit(" is out of reach at this pace."))
    return progress.where("needs_alert").select(F.lit("GOAL_PACE").alias("kind"), F.lit("high").alias("level"), F.col("id").alias("subject"), F.col("end").cast("string").alias("period"), text.alias("text"), F.lit(0).cast("long").alias("seq"))


def anomaly_alerts(found: DataFrame) -> DataFrame:
    """An alert for each anomaly under the period it fell in; drops are high, the rest low."""
    drop = F.col("kind") == "ANOMALY_DROP"
    text = F.concat(F.when(F.col("subject") == "", "Revenue").otherwise(F.col("subject")), F.when(drop, " fell far below its usual.").otherwise(" rose far above its usual."))
    return found.select("kind", F.when(drop, "high").otherwise("low").alias("level"), "subject", F.col("period").cast("string").alias("period"), text.alias("text"), F.row_number().over(Window.orderBy(F.abs("z").desc(), "subject")).cast("long").alias("seq"))


def goal_progress(sales: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (id, metric, target, start, end) with what was reached inside their windows as of the last sale, and the state.

    A goal on profit has no row where no sale has a profit.
    """
    return progress_of(kept_days(sales), goals)


def kept_days(sales: DataFrame) -> DataFrame:
    """(day, revenue, profit, profits): sums of days with how many sales have a profit, kept in the shared folder."""
    day = F.to_date("date")
    days = sales.groupBy(day.alias("day")).agg(money("revenue").alias("revenue"), money("profit").alias("profit"), F.count("profit").alias("profits"))
    return written(days, "days")


def progress_of(days: DataFrame, goals: DataFrame) -> DataFrame:
    """goal_progress() of kept_days()."""
    last, daily = days.agg(F.max("day").alias("as_of"), F.coalesce(F.sum("profits"), F.lit(0)).alias("profits")), days.select("day", "revenue", "profit")
    # goals are typed in by users, a handful of rows: sums of days, not sales rows, meet them
    t = goals.crossJoin(last).where((F.col("metric") != "profit") | (F.col("profits") > 0)).drop("profits").join(daily, F.col("day").between(F.col("start"), F.col("end")), "left")
    value = F.when(F.col("metric") == "profit", F.col("profit")).otherwise(F.col("revenue"))
    t = t.groupBy("id", "metric", "target", "start", "end", "as_of").agg(F.coalesce(money(value), F.lit(0.0)).alias("actual"))
    total = F.datediff("end", "start") + 1
    elapsed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.datediff(F.least("as_of", "end"), F.col("start")) + 1) / total))
    state = F.when(F.col("as_of") < F.col("start"), "not_started").when(F.col("as_of") >= F.col("end"), "finished").otherwise("in_progress")
    t = t.withColumn("elapsed", elapsed).withColumn("state", state)
    early = (F.col("state") != "in_progress") | (F.col("elapsed") < 0.08)
    run_rate = F.when(F.col("state") == "finished", F.col("actual")).when(early, None).otherwise(F.try_divide("actual", "elapsed"))
    t = t.withColumn("projected", run_rate).withColumn("reached_share", F.try_divide("actual", "target"))
    return t.withColumn("needs_alert", F.col("projected").isNotNull() & (F.col("projected") < F.col("target")))


#: Days of a period, periods ahead that a goal's remainder is projected, the most that the band of a run rate may be.
DAYS = {MONTH: 30.44, WEEK: 7.0, DAY: 1.0}
GOAL_HORIZON, MOST_SPREAD = 6, 0.6


def goal_projection(sales: DataFrame, goals: DataFrame, frequency: str = MONTH) -> DataFrame:
    """goal_progress() with a band: what is left of a window as a model of the metric projects it, else the run rate with the variation of periods.

    The model's periods count as far as they lie before the window's end, the next one by its share; beyond the horizon
    the last one goes on. on_track: the projection reaches the target; could_still_hit: its upper end does.
    """
    from salesprism.functions.arima import forecasts

    days = kept_days(sales)
    whole = whole_sums(kept_sums(days.withColumnRenamed("day", "date"), frequency, revenue="revenue", profit="profit"), frequency)
    known = ["revenue"] + ([] if days.where("profits > 0").isEmpty() else ["profit"])
    series = None
    for m in known:
        own = spread_out(whole, frequency, m).withColumnRenamed(m, "value").withColumn("subject", F.lit(m))
        series = own if series is None else series.unionByName(own)
    spread = series.groupBy("subject").agg(F.when((F.count("*") >= 3) & (F.avg("value") > 0), F.least(F.stddev_samp("value") / F.avg("value"), F.lit(MOST_SPREAD))).otherwise(0.0).alias("variation"))
    steps = forecasts(series, GOAL_HORIZON, frequency=frequency).where("trusted").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("step", "mean", "lower80", "upper80"))).alias("ahead"), F.first("model").alias("model"))
    t = progress_of(days, goals).drop("needs_alert").join(F.broadcast(spread), F.col("metric") == F.col("subject"), "left").drop("subject")
    t = t.join(F.broadcast(steps), F.col("metric") == F.col("subject"), "left").drop("subject")
    needed = F.greatest(F.lit(0), F.datediff("end", F.least("as_of", "end"))) / DAYS[frequency]
    part = lambda x: F.when(x["step"] == GOAL_HORIZON, F.greatest(F.lit(0.0), needed - (GOAL_HORIZON - 1))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), needed - (x["step"] - 1))))
    rest = lambda field: F.aggregate("ahead", F.lit(0.0), lambda a, x: a + x[field] * part(x))
    open_ = (F.col("state") == "in_progress") & F.col("projected").isNotNull()
    modelled = open_ & F.col("ahead").isNotNull()
    band = F.col("projected") * F.coalesce("variation", F.lit(0.0))
    t = t.withColumns({
        "projected_low": F.when(modelled, F.col("actual") + rest("lower80")).when(open_, F.greatest("actual", F.col("projected") - band)).otherwise(F.col("projected")),
        "projected_high": F.when(modelled, F.col("actual") + rest("upper80")).when(open_, F.col("projected") + band).otherwise(F.col("projected")),
        "projected": F.when(modelled, F.col("actual") + rest("mean")).otherwise(F.col("projected")),
        "method": F.when(modelled, F.concat(F.lit("ARIMA "), F.col("model"))).when(open_, "run rate").when(F.col("state") == "finished", "actual").otherwise("none"),
    })
    t = t.withColumn("on_track", F.col("projected") >= F.col("target")).withColumn("could_still_hit", F.col("projected_high") >= F.col("target"))
    return t.withColumn("needs_alert", F.coalesce(~F.col("on_track") & ~F.col("could_still_hit"), F.lit(False))).drop("ahead", "model", "variation")


def check_goal(metric: str, target: float, start: dt.date, end: dt.date) -> list[str]:
    """Why a goal can't be taken."""
    out = [] if metric in ("revenue", "profit") else [f"no metric {metric}"]
    out += [] if target > 0 else ["the target isn't above 0"]
    return out + ([] if end > start else ["the window ends before it begins"])


def goal_pace(sales: DataFrame, target: float, start: dt.date, end: dt.date, measure: str = "revenue") -> DataFrame:
    """Months of the window with what they brought and what each month needs: target / ceil(days / 30.44)."""
    days = (end - start).days + 1
    needed = target / -(-days // 30.44)
    window = sales.where(F.to_date("date").between(F.lit(start), F.lit(end)))
    return by_period(window, MONTH, measure).withColumn("needed", F.lit(float(needed))).withColumn("ahead", F.col("value") >= F.col("needed"))


def goal_gap_drivers(sales: DataFrame, start: dt.date, end: dt.date, key: str = "product", measure: str = "revenue", limit: int = 5) -> DataFrame:
    """Items whose mean per month fell between the halves of the window, worst first."""
    window = sales.where(F.to_date("date").between(F.lit(start), F.lit(end)))
    sums = window.groupBy(period_of(MONTH).alias("period"), key).agg(money(measure).alias("value"))
    grid = sums.select("period").distinct().join(sums.select(key).distinct()).join(sums, ["period", key], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    t = half_means(grid, key).withColumn("change", F.col("after") - F.col("before")).where("change < 0")
    return t.withColumn("rank", F.row_number().over(Window.orderBy("change", key))).where(F.col("rank") <= limit)


__all__ = ["alert_key", "anomalies", "fresh_alerts", "goal_gap_drivers", "goal_pace", "goal_alerts", "goal_progress", "goal_projection", "anomaly_alerts", "check_goal", "quality_alerts", "robust_scores", "sales_anomalies", "with_half"]
