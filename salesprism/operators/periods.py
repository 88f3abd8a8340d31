"""Calendar shaping: period labels, sums with gaps filled, long product-by-period tables, halves, last periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from salesprism.scratch import written

MONTH, WEEK, DAY = "month", "week", "day"
SEASONS = {MONTH: 12, WEEK: 52, DAY: 7}


def everything() -> WindowSpec:
    """The window of a whole table; for tables of items or periods."""
    return Window.partitionBy()


def money(column: str | Column) -> Column:
    """An exact sum of amounts in cents, as a double."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def period_of(frequency: str, date: str = "date") -> Column:
    """The label of the period: first of the month, the Sunday that ends the week, or the day."""
    c = F.to_date(date)
    return {MONTH: F.trunc(c, "MM"), WEEK: F.date_add(F.to_date(F.date_trunc("week", c)), 6), DAY: c}[frequency]


def natural_frequency(first: dt.date, last: dt.date) -> str:
    days = (last - first).days
    return MONTH if days >= 180 else WEEK if days >= 60 else DAY


def bounds(sales: DataFrame) -> tuple[dt.date | None, dt.date | None]:
    """First and last date; from the table that a view names for it, if it does."""
    r = getattr(sales, "dates", sales).agg(F.to_date(F.min("date")).alias("a"), F.to_date(F.max("date")).alias("b")).first()
    return r["a"], r["b"]


def open_start(first: dt.date | None, last: dt.date | None, frequency: str) -> dt.date | None:
    """The first day of the period of the last date if that isn't over, unless it is the only one."""
    if last is None:
        return None
    ends = {MONTH: (last.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1), WEEK: last + dt.timedelta(days=6 - last.weekday()), DAY: last}[frequency]
    starts = {MONTH: last.replace(day=1), WEEK: last - dt.timedelta(days=last.weekday()), DAY: last}[frequency]
    return starts if last < ends and first < starts else None


def open_period(sales: DataFrame, frequency: str) -> dt.date | None:
    """open_start() of a table."""
    return open_start(*bounds(sales), frequency)


def whole_periods(sales: DataFrame, frequency: str) -> DataFrame:
    """sales without a last period that isn't over, unless it is the only one."""
    cut = open_period(sales, frequency)
    return sales.where(F.to_date("date") < F.lit(cut)) if cut else sales


def kept_sums(sales: DataFrame, frequency: str, *keys: str, **measures: str) -> DataFrame:
    """(period, *keys, sums by name, first, last): sums by period with their first and last date, kept in the shared folder, so that the sales are read once."""
    dates = F.to_date("date")
    sums = sales.groupBy(period_of(frequency).alias("period"), *keys).agg(*[money(m).alias(name) for name, m in measures.items()], F.min(dates).alias("first"), F.max(dates).alias("last"))
    return written(sums, "sums")


def whole_sums(sums: DataFrame, frequency: str) -> DataFrame:
    """kept_sums() without a last period that isn't over, as whole_periods() has it."""
    cut = open_start(*sums.agg(F.min("first"), F.max("last")).first(), frequency)
    if cut:
        sums = sums.where(F.col("period") < (cut + dt.timedelta(days=6) if frequency == WEEK else cut))
    return sums.drop("first", "last")


def spread_out(sums: DataFrame, frequency: str, *names: str) -> DataFrame:
    """(period, *names) of sums by period, inner periods without rows filled with 0."""
    step = {MONTH: "interval 1 month", WEEK: "interval 7 days", DAY: "interval 1 day"}[frequency]
    spine = sums.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    return spine.join(sums, "period", "left").select("period", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in names])


def by_period(sales: DataFrame, frequency: str, measure: str = "revenue", **more: str) -> DataFrame:
    """(period, value), inner periods without rows filled with 0; more: names of further columns and their measures."""
    wanted = {"value": measure, **more}
    return spread_out(kept_sums(sales, frequency, **wanted), frequency, *wanted)


def filled(sums: DataFrame, key: str) -> DataFrame:
    """(period, key, value) for every period and every key of the kept sums, cells without rows 0."""
    grid = sums.select("period").distinct().join(sums.select(key).distinct())
    return grid.join(sums, ["period", key], "left").select("period", key, F.coalesce("value", F.lit(0.0)).alias("value"))


def by_period_and(sales: DataFrame, key: str, frequency: str, measure: str = "revenue") -> DataFrame:
    """(period, key, value) for every period that has rows and every key, cells without rows 0."""
    return filled(kept_sums(sales, frequency, key, value=measure), key)


def whole_by_period_and(sales: DataFrame, key: str, frequency: str, measure: str = "revenue") -> DataFrame:
    """by_period_and() of the whole periods, whose bounds come from the same pass."""
    return filled(whole_sums(kept_sums(sales, frequency, key, value=measure), frequency), key)


def with_half(cells: DataFrame) -> DataFrame:
    """cells with n (periods), half (n // 2), ordinal of the period and whether it is in the first half."""
    order = Window.orderBy("period")
    periods = cells.select("period").distinct().withColumn("ordinal", F.row_number().over(order))
    periods = periods.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("half", F.expr("n div 2")).withColumn("early", F.col("ordinal") <= F.col("half"))
    return cells.join(periods, "period")


def half_means(cells: DataFrame, *keys: str) -> DataFrame:
    """Means per period of the first and the second half: before, after, for each key."""
    h = with_half(cells)
    early = F.sum(F.when(F.col("early"), F.col("value")).otherwise(0.0)) / F.max("half")
    late = F.sum(F.when(~F.col("early"), F.col("value")).otherwise(0.0)) / F.max(F.col("n") - F.col("half"))
    return h.groupBy(*keys).agg(early.alias("before"), late.alias("after"))


def median_gap(table: DataFrame, date: str = "period") -> DataFrame:
    """One row: the median of the days between one date and the next; for tables of periods."""
    days = F.datediff(date, F.lag(date).over(Window.orderBy(date)))
    return table.select(date).distinct().select(days.alias("days")).where("days is not null").agg(F.percentile("days", F.lit(0.5)).alias("median_days"), F.count("*").alias("gaps"))


def pct_change(new: Column, old: Column) -> Column:
    """(new - old) / abs(old), null if old is 0 or null."""
    return F.try_divide(new - old, F.abs(old))
