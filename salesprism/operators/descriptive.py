"""Descriptive analyses as tables of facts: rankings, margins, concentration, decompositions, lifecycle, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.operators.periods import MONTH, everything, by_period, half_means, kept_sums, money, open_period, pct_change, period_of, whole_by_period_and, whole_periods, whole_sums, with_half
from salesprism.scratch import written


def product_ranking(sales: DataFrame, key: str = "product", measure: str = "revenue") -> DataFrame:
    t = sales.groupBy(key).agg(money(measure).alias("value"))
    t = t.withColumn("share", F.try_divide("value", F.sum("value").over(everything())))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), key)))


def margin_by_product(sales: DataFrame, key: str = "product") -> DataFrame:
    """Revenue, profit, margin of the sums (null without revenue), ranks by revenue and by profit."""
    t = sales.groupBy(key).agg(money("revenue").alias("revenue"), money("profit").alias("profit"))
    t = t.withColumn("margin", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue")))
    t = t.withColumn("revenue_rank", F.row_number().over(Window.orderBy(F.col("revenue").desc(), key)))
    return t.withColumn("profit_rank", F.row_number().over(Window.orderBy(F.col("profit").desc(), key)))


def concentration(sales: DataFrame, key: str = "product", measure: str = "revenue") -> DataFrame:
    """One row over positive totals: shares of the first one, two and three, Herfindahl index, items for half."""
    t = sales.groupBy(key).agg(money(measure).alias("v")).where("v > 0")
    order = Window.orderBy(F.col("v").desc(), key)
    t = t.withColumn("share", F.col("v") / F.sum("v").over(everything())).withColumn("r", F.row_number().over(order))
    t = t.withColumn("until", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    top = lambda k: F.sum(F.when(F.col("r") <= k, F.col("share")).otherwise(0.0))
    return t.agg(
        F.min_by(key, "r").alias("leader"), top(1).alias("top1_share"), top(2).alias("top2_share"), top(3).alias("top3_share"),
        F.sum(F.col("share") * F.col("share")).alias("herfindahl"), (F.count_if(F.col("until") < 0.5) + 1).alias("items_for_half"),
        F.count("*").alias("item_count"), money("v").alias("total"),
    )


def pareto_classes(sales: DataFrame, key: str = "product", vital: float = 0.8, tail: float = 0.01) -> DataFrame:
    """Each item's share and cumulated share; vital up to the item that reaches 80 %, tail below 1 %."""
    t = sales.groupBy(key).agg(money("revenue").alias("value")).where("value > 0")
    order = Window.orderBy(F.col("value").desc(), key)
    t = t.withColumn("share", F.col("value") / F.sum("value").over(everything())).withColumn("rank", F.row_number().over(order))
    t = t.withColumn("cumulative", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(everything()))
    n_vital = F.count_if(F.col("cumulative") < vital).over(everything()) + 1
    return t.withColumn("is_vital", F.col("rank") <= n_vital).withColumn("is_tail", F.col("share") < tail)


def decomposition(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    """Each item's mean per period before and after, its change, and its share of the whole change; changes add up exactly."""
    t = half_means(whole_by_period_and(sales, key, frequency), key)
    t = t.withColumn("change", F.col("after") - F.col("before"))
    return t.withColumn("share_of_change", F.try_divide("change", F.sum("change").over(everything())))


def dimension_decomposition(sales: DataFrame, dimensions: list[str], frequency: str = MONTH, levels: tuple[int, int] = (2, 12), dominant: float = 0.75, steady: float = 0.1) -> DataFrame:
    """decomposition() of each dimension in one table, with the guards as columns."""
    cut = open_period(sales, frequency)
    # one pass: a row for each dimension of a sale, summed by period, of which there are few
    long = sales.select("date", "revenue", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dimensions])).alias("x"))
    sums = long.where("x.level is not null").groupBy("x.dimension", "x.level", period_of(frequency).alias("period"), (F.to_date("date") >= F.lit(cut)).alias("open")).agg(money("revenue").alias("value"), F.count("*").alias("rows"))
    rows = sums.groupBy("dimension", "level").agg(F.sum("rows").alias("n_rows"))
    cells = sums.where(~F.coalesce("open", F.lit(False)))
    own = Window.partitionBy("dimension")
    periods = cells.select("dimension", "period").distinct().withColumn("ordinal", F.row_number().over(own.orderBy("period"))).withColumn("n", F.count("*").over(own))
    half = F.expr("n div 2")
    early, late = F.col("ordinal") <= half, F.col("ordinal") > half
    t = cells.join(periods, ["dimension", "period"]).groupBy("dimension", "level").agg((F.sum(F.when(early, F.col("value")).otherwise(0.0)) / F.max(half)).alias("before"), (F.sum(F.when(late, F.col("value")).otherwise(0.0)) / F.max(F.col("n") - half)).alias("after"))
    out = t.join(rows, ["dimension", "level"])
    w = Window.partitionBy("dimension")
    out = out.withColumn("change", F.col("after") - F.col("before")).withColumn("share_of_change", F.try_divide("change", F.sum("change").over(w)))
    n = F.count("*").over(w)
    guard = n.between(*levels) & (F.max("n_rows").over(w) <= dominant * F.sum("n_rows").over(w))
    return out.withColumn("usable", guard).withColumn("is_steady", F.coalesce(F.abs(pct_change(F.col("after"), F.col("before"))) < steady, F.lit(False)))


def price_volume_split(sales: DataFrame, frequency: str = MONTH) -> DataFrame:
    """One row: units and price before and after, and the change split into volume (at the old price) and price (at the new units)."""
    h = with_half(by_period(whole_periods(sales, frequency), frequency, quantity="quantity"))
    mean = lambda c, early: F.sum(F.when(F.col("early") == early, F.col(c)).otherwise(0.0)) / F.max(F.col("half") if early else F.col("n") - F.col("half"))
    t = h.agg(mean("value", True).alias("before"), mean("value", False).alias("after"), mean("quantity", True).alias("q0"), mean("quantity", False).alias("q1"))
    p0, p1 = F.try_divide(F.col("before"), F.col("q0")), F.try_divide(F.col("after"), F.col("q1"))
    return t.select(
        F.col("q0").alias("quantity_before"), F.col("q1").alias("quantity_after"), p0.alias("price_before"), p1.alias("price_after"),
        ((F.col("q1") - F.col("q0")) * p0).alias("volume_effect"), ((p1 - p0) * F.col("q1")).alias("price_effect"), (F.col("after") - F.col("before")).alias("total_change"),
    )


def month_index(sales: DataFrame) -> DataFrame:
    """Mean of each calendar month's totals against the mean of all, minus 1."""
    t = by_period(whole_periods(sales, MONTH), MONTH)
    overall = F.avg("value").over(everything())
    t = t.withColumn("overall", overall).groupBy(F.month("period").alias("month"), "overall").agg(F.avg("value").alias("mean"), F.count("*").alias("years"))
    return t.select("month", "years", "mean", (F.try_divide("mean", "overall") - 1).alias("lift"))


def lifecycle(sales: DataFrame, key: str = "product", frequency: str = MONTH, recent: int = 2) -> DataFrame:
    """Each item's activity in the last `recent` observed periods and before, and what follows from it."""
    cells = with_half(whole_by_period_and(sales, key, frequency))
    late, active = F.col("ordinal") > F.col("n") - recent, F.col("value") > 0
    t = cells.groupBy(key).agg(
        F.count_if(active & ~late).alias("earlier_active"), F.count_if(active & late).alias("recent_active"), F.max(F.when(active, F.col("period"))).alias("last_seen"),
        F.sum(F.when(~late, F.col("value")).otherwise(0.0)).alias("earlier_value"), F.sum(F.when(late, F.col("value")).otherwise(0.0)).alias("recent_value"), F.max("n").alias("n"),
    )
    enough = F.greatest(F.lit(3), F.expr(f"(n - {recent}) div 3"))
    status = F.when((F.col("recent_active") == 0) & (F.col("earlier_active") >= enough), "stopped").when((F.col("earlier_active") == 0) & (F.col("recent_active") > 0), "arrived").otherwise("trading")
    return t.withColumn("status", status).drop("n")


def order_values(sales: DataFrame, order: str = "order_id") -> DataFrame:
    return sales.groupBy(order).agg(money("revenue").alias("value")).where("value > 0")


#: Ranges of values to a factor of two, by which quantiles are found.
VALUE_BINS = 64


def value_bin(v: Column) -> Column:
    """The number of a value's range: one for 0, others of about one per cent of the value, in the order of values."""
    size = F.floor(F.log2(F.abs(v)) * VALUE_BINS) + 1100 * VALUE_BINS
    return F.when(v > 0, size).when(v < 0, -size - 1).otherwise(0).cast("long")


def group_quantiles(values: DataFrame, by: list[str], column: str = "value", weight: str | None = None, **wanted: float) -> DataFrame:
    """(*by, each wanted): exact quantiles of each group, between neighbours by share; weight: a column with the times that a value counts.

    Values are counted by group and range first. Only ranges that hold a wanted rank are looked into, where equal
    values are counted and the ranges narrowed before values are put in order; so no task holds a group's values, or
    those of one value, or all values that lie close together.
    """
    v, times = F.col(column), F.col(weight) if weight else F.lit(1)
    binned = values.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*by, v.cast("double").alias("_v"), times.cast("long").alias("_k")).withColumn("_bin", value_bin(F.col("_v")))
    own = Window.partitionBy(*by)
    bins = binned.groupBy(*by, "_bin").agg(F.sum("_k").alias("_n"))
    bins = bins.withColumn("_until", F.sum("_n").over(own.orderBy("_bin"))).withColumn("_total", F.sum("_n").over(own))
    at = lambda q: F.lit(q) * (F.col("_total") - 1)
    share = lambda q: at(q) - F.floor(at(q))
    ranks = [F.struct(F.lit(k).alias("_name"), (F.floor(at(q)) + step).cast("long").alias("_rank"), w.alias("_weight")) for k, q in wanted.items() for step, w in ((0, 1 - share(q)), (1, share(q)))]
    need = bins.withColumn("_x", F.explode(F.array(*ranks))).select(*by, "_bin", (F.col("_until") - F.col("_n")).alias("_before"), "_until", "_x.*")
    need = need.where("_weight > 0 and _rank >= _before and _rank < _until")
    asked = need.groupBy(*by, "_bin").agg(F.max("_before").alias("_before"), F.collect_list(F.struct("_name", "_rank", "_weight")).alias("_asked"))
    asked = written(asked.withColumn("_place", F.monotonically_increasing_id()), "asked")
    at_place = asked.select("_place", F.col("_bin").alias("_at"), *[F.col(c).alias(f"_of_{c}") for c in by])
    meets = F.col("_bin") == F.col("_at")
    for c in by:
        meets &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    held = written(binned.join(at_place, meets).groupBy("_place", "_v").agg(F.sum("_k").alias("_k")), "held")
    for _ in range(NARROWED):
        held, asked = narrowed(held, asked.select("_place", *by, "_before", "_asked"))
    held = held.join(asked, "_place")
    until = F.col("_before") + F.sum("_k").over(Window.partitionBy("_place").orderBy("_v"))
    hits = held.withColumn("_to", until).select(*by, "_v", "_k", "_to", F.explode("_asked").alias("_x")).where("_x._rank < _to and _x._rank >= _to - _k")
    return hits.groupBy(*by).agg(*[F.sum(F.when(F.col("_x._name") == k, F.col("_v") * F.col("_x._weight"))).alias(k) for k in wanted])


#: Equal parts that a range of values is cut into, and how often: of the doubles in a range of one per cent, at most a million share a part of a part.
RANGE_PARTS, NARROWED = 8192, 2


def narrowed(held: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values (_place, _v, _k) and ranks (_place, ..., _before, _asked) by the parts of each place's range that hold an asked rank; each part is a place of its own."""
    ends = held.groupBy("_place").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    part = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGE_PARTS)).otherwise(0)
    cut = held.join(ends, "_place").withColumn("_part", part).drop("_low", "_high")
    parts = cut.groupBy("_place", "_part").agg(F.sum("_k").alias("_n")).withColumn("_to", F.sum("_n").over(Window.partitionBy("_place").orderBy("_part")))
    parts = parts.join(asked, "_place").withColumn("_until", F.col("_before") + F.col("_to")).withColumn("_before", F.col("_until") - F.col("_n"))
    parts = parts.where(F.exists("_asked", lambda x: (x["_rank"] < F.col("_until")) & (x["_rank"] >= F.col("_before"))))
    wanted = written(parts.drop("_n", "_to", "_until").withColumn("_next", F.monotonically_increasing_id()), "asked")
    found = cut.join(wanted.select("_place", "_part", "_next"), ["_place", "_part"]).select(F.col("_next").alias("_place"), "_v", "_k")
    return written(found, "held"), wanted.drop("_place", "_part").withColumnRenamed("_next", "_place")


def quantiles(values: DataFrame, column: str = "value", **wanted: float) -> DataFrame:
    """One row of exact quantiles of all values, null without values."""
    return group_quantiles(values.withColumn("_all", F.lit(0)), ["_all"], column, **wanted).agg(*[F.max(k).alias(k) for k in wanted])


def order_spread(orders: DataFrame) -> DataFrame:
    """One row: count, mean, median, 10th and 90th percentile, and the share of the largest tenth of orders by count."""
    stats = orders.agg(F.count("*").alias("orders"), F.avg("value").alias("mean")).crossJoin(quantiles(orders, median=0.5, p10=0.1, p90=0.9))
    return stats.crossJoin(top_decile(orders)).withColumn("mean_to_median", F.try_divide("mean", "median"))


def top_decile(orders: DataFrame) -> DataFrame:
    """The share of the ceil(n / 10) largest orders. Orders fall into value bins first, so that no task ranks all of them.

    A bin is a range of 2 % of the value; whole bins above the cut are summed, only the bin that holds it is ranked.
    """
    binned = orders.withColumn("bin", F.floor(F.log1p("value") * 50))
    bins = binned.groupBy("bin").agg(F.count("*").alias("n"), money("value").alias("s"))
    down = Window.orderBy(F.col("bin").desc())
    bins = bins.withColumn("above", F.sum("n").over(down) - F.col("n")).withColumn("k", F.ceil(F.sum("n").over(everything()) / 10)).withColumn("total", F.sum("s").over(everything()))
    whole = bins.where(F.col("above") + F.col("n") <= F.col("k")).agg(F.coalesce(money("s"), F.lit(0.0)).alias("whole"))
    cut = bins.where((F.col("above") < F.col("k")) & (F.col("above") + F.col("n") > F.col("k"))).select("bin", (F.col("k") - F.col("above")).alias("take"))
    ranked = binned.join(cut, "bin").withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(F.col("value").desc())))
    part = ranked.where("r <= take").agg(F.coalesce(money("value"), F.lit(0.0)).alias("part"))
    total = bins.agg(F.max("total").alias("total"))
    return whole.crossJoin(part).crossJoin(total).select(F.try_divide(F.col("whole") + F.col("part"), F.col("total")).alias("top_decile_share"))


def price_points(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    """Units, revenue and price of each item and period with both positive."""
    t = whole_sums(kept_sums(sales, frequency, key, units="quantity", revenue="revenue"), frequency).select(key, "period", "units", "revenue")
    return t.where("units > 0 and revenue > 0").withColumn("price", F.col("revenue") / F.col("units"))
