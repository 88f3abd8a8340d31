"""Customer analyses: repeat and new trade, recency-frequency-money segments, cohorts, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesprism.operators.descriptive import value_bin
from salesprism.operators.periods import MONTH, everything, half_means, money, pct_change, period_of, whole_periods
from salesprism.scratch import written


def first_purchases(sales: DataFrame) -> DataFrame:
    return sales.where("customer_id is not null").groupBy("customer_id").agg(F.min("date").alias("first_date"))


def repeat_and_new(sales: DataFrame, frequency: str = MONTH) -> DataFrame:
    """(period, new, repeat): revenue at a customer's first timestamp, and later."""
    rows = whole_periods(sales, frequency).join(first_purchases(sales), "customer_id").withColumn("is_new", F.col("date") == F.col("first_date"))
    t = rows.groupBy(period_of(frequency).alias("period")).agg(money(F.when(F.col("is_new"), F.col("revenue")).otherwise(0)).alias("new"), money(F.when(~F.col("is_new"), F.col("revenue")).otherwise(0)).alias("repeat"))
    return t


def repeat_vs_new(sales: DataFrame, frequency: str = MONTH) -> DataFrame:
    t = written(repeat_and_new(sales, frequency), "repeat")
    both = t.select("period", F.explode(F.create_map(F.lit("new"), F.col("new"), F.lit("repeat"), F.col("repeat"))).alias("side", "value"))
    return half_means(both, "side").withColumn("change_pct", pct_change(F.col("after"), F.col("before")))


def quartile_cuts(values: DataFrame) -> DataFrame:
    """(c, level, from_value, to_value) for the levels 2 to 4 of values (c, v): the least value in that quartile or a higher one, and the largest where quartiles count downwards.

    A value's quartile is that of its mean rank over all rows. Values fall into ranges that are counted first; only
    ranges in which a quarter ends are looked into.
    """
    counted = values.groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("bin", value_bin(F.col("v")))
    own = Window.partitionBy("c")
    bins = counted.groupBy("c", "bin").agg(F.sum("n").alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
    bins = written(bins.withColumn("below", F.sum("s").over(own.orderBy("bin")) - F.col("s")).withColumn("total", F.sum("s").over(own)), "bins")
    quarters = F.floor(4 * (F.col("below") + F.col("s")) / F.col("total")) > F.floor(4 * F.col("below") / F.col("total"))
    inner = counted.join(bins.where(quarters).select("c", "bin", "below", "total"), ["c", "bin"])
    until = F.col("below") + F.sum("n").over(Window.partitionBy("c", "bin").orderBy("v"))
    rank = (until - (F.col("n") - 1) / 2) / F.col("total")
    placed = inner.select("c", rank.alias("low"), rank.alias("high"), F.col("v").alias("least"), F.col("v").alias("most"))
    # all values of another range are in one quartile
    whole = bins.where(~quarters).select("c", ((F.col("below") + 1) / F.col("total")).alias("low"), ((F.col("below") + F.col("s")) / F.col("total")).alias("high"), "least", "most")
    both = placed.unionByName(whole)
    level = lambda x: F.least(F.greatest(F.ceil(x * 4), F.lit(1)), F.lit(4))
    levels = both.withColumn("level", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return levels.groupBy("c", "level").agg(F.min(F.when(level(F.col("low")) >= F.col("level"), F.col("least"))).alias("from_value"), F.max(F.when(level(1 - F.col("high")) >= F.col("level"), F.col("most"))).alias("to_value"))


def _quartiles(customers: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """customers with the quartiles of several columns, reversed where the flag says so: steps at three cuts a column, which travel."""
    entries = F.array(*[F.struct(F.lit(name).alias("c"), F.col(column).cast("double").alias("v")) for name, (column, _) in columns.items()])
    cuts = quartile_cuts(customers.select(F.explode(entries).alias("x")).select("x.c", "x.v"))
    of = lambda name, level, side: F.max(F.when((F.col("c") == name) & (F.col("level") == level), F.col(side)))
    wide = cuts.agg(*[of(name, level, "to_value" if reverse else "from_value").alias(f"_{name}{level}") for name, (_, reverse) in columns.items() for level in (2, 3, 4)])
    out = customers.crossJoin(F.broadcast(wide))
    for name, (column, reverse) in columns.items():
        v = F.col(column).cast("double")
        steps = [F.coalesce(v <= F.col(f"_{name}{level}") if reverse else v >= F.col(f"_{name}{level}"), F.lit(False)).cast("int") for level in (2, 3, 4)]
        out = out.withColumn(name, 1 + steps[0] + steps[1] + steps[2])
    return out.drop(*[f"_{name}{level}" for name in columns for level in (2, 3, 4)])


def rfm(sales: DataFrame) -> DataFrame:
    """One row a customer: recency and age in days, orders, spend, quartiles r, f, m and the segment."""
    rows = sales.where("customer_id is not null")
    now = sales.agg(F.to_date(F.max("date")).alias("now"))
    t = rows.groupBy("customer_id").agg(F.to_date(F.max("date")).alias("last"), F.to_date(F.min("date")).alias("first"), F.count("*").alias("lines"), money("revenue").alias("spend"))
    t = written(t.crossJoin(now).select("customer_id", F.datediff("now", "last").alias("recency"), F.datediff("now", "first").alias("age"), "lines", "spend"), "customers")
    t = _quartiles(t, {"r": ("recency", True), "f": ("lines", False), "m": ("spend", False)})
    young = t.agg(F.greatest(F.lit(30), F.floor(F.percentile("recency", F.lit(0.5)))).alias("young"))
    t = t.crossJoin(young)
    r, f, new = F.col("r"), F.col("f"), F.col("age") <= F.col("young")
    segment = F.when((r >= 3) & (f >= 3), "champions").when((r >= 3) & new & (f <= 2), "new").when(r >= 3, "loyal").when((r <= 2) & (f >= 3), "at_risk").when(r == 1, "lost").otherwise("occasional")
    return t.withColumn("segment", segment).drop("young")


def chart_sample(sales: DataFrame, limit: int = 400) -> DataFrame:
    """At most `limit` customers for a chart, the same ones each time: those whose ids have the smallest digests."""
    return sample_of(rfm(sales), limit)


def sample_of(customers: DataFrame, limit: int = 400) -> DataFrame:
    """chart_sample() of a table that rfm() made."""
    return customers.orderBy(F.sha2("customer_id", 256), "customer_id").limit(limit).select("customer_id", "recency", F.col("lines").alias("frequency"), F.col("spend").alias("monetary"), "segment")


def rfm_segments(sales: DataFrame) -> DataFrame:
    return segments_of(rfm(sales))


def segments_of(customers: DataFrame) -> DataFrame:
    """rfm_segments() of a table that rfm() made."""
    t = customers.groupBy("segment").agg(F.count("*").alias("customers"), money("spend").alias("spend"), F.avg("recency").alias("avg_recency"), F.avg("lines").alias("avg_lines"))
    return t.withColumn("share", F.col("customers") / F.sum("customers").over(everything()))


def cohort_counts(sales: DataFrame) -> DataFrame:
    """(cohort, age, customers): customers first seen in the cohort's month who bought `age` months later."""
    rows = sales.join(first_purchases(sales), "customer_id").select("customer_id", F.trunc("first_date", "MM").alias("cohort"), F.trunc("date", "MM").alias("month"))
    age = (12 * (F.year("month") - F.year("cohort")) + F.month("month") - F.month("cohort")).cast("int")
    return rows.select("customer_id", "cohort", age.alias("age")).distinct().groupBy("cohort", "age").agg(F.count("*").alias("customers"))


def cohort_sizes(sales: DataFrame) -> DataFrame:
    return cohort_counts(sales).where("age = 0").select("cohort", F.col("customers").alias("size"))


def cohort_retention(sales: DataFrame, least: int = 8) -> DataFrame:
    """(cohort, age, size, retained, rate) for cohorts of at least 8, at every age they are old enough for; unseen is 0."""
    counts = written(cohort_counts(sales), "cohorts")
    sizes = counts.where("age = 0").select("cohort", F.col("customers").alias("size")).where(F.col("size") >= least)
    last = sales.agg(F.trunc(F.max("date"), "MM").alias("last"))
    grid = sizes.crossJoin(last).withColumn("oldest", (12 * (F.year("last") - F.year("cohort")) + F.month("last") - F.month("cohort")).cast("int"))
    grid = grid.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("oldest"))))
    t = grid.join(counts, ["cohort", "age"], "left")
    return t.select("cohort", "age", "size", F.coalesce("customers", F.lit(0)).alias("retained"), (F.coalesce("customers", F.lit(0)) / F.col("size")).alias("rate"))


def retention_curve(sales: DataFrame, least: int = 8) -> DataFrame:
    """(age, cohorts, rate): mean over the cohorts old enough, for ages from 1 with at least two of them."""
    return cohort_retention(sales, least).where("age >= 1").groupBy("age").agg(F.count("*").alias("cohorts"), F.avg("rate").alias("rate")).where("cohorts >= 2")


def baskets(sales: DataFrame, item: str = "product") -> DataFrame:
    """Distinct (basket, item); the basket is the order, without one the customer's day. Rows with neither are left out."""
    order = F.col("order_id") if "order_id" in sales.columns else F.lit(None).cast("string")
    day = F.when(F.col("customer_id").isNotNull(), F.concat_ws("|", "customer_id", F.to_date("date").cast("string"))) if "customer_id" in sales.columns else F.lit(None).cast("string")
    key = F.coalesce(order, day)
    rows = sales.where(key.isNotNull())
    return rows.select(key.alias("basket"), F.col(item).alias("item")).distinct()


def basket_pairs(sales: DataFrame, item: str = "product") -> DataFrame:
    """(a, b, together) over baskets of two items or more."""
    b = baskets(sales, item)
    pairs = b.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")).where("size(items) >= 2")
    # a basket's items are one order's lines; pairs come out of the sorted array without a self join
    i = F.posexplode("items").alias("at", "a")
    return pairs.select("items", i).select("a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("together"))


def basket_lift(sales: DataFrame, item: str = "product", floor_share: float = 0.01, floor_least: int = 8) -> DataFrame:
    """Pairs with the counts of both items, all baskets of two or more, lift and support; supported says if above the floor."""
    many = baskets(sales, item).withColumn("n", F.count("*").over(Window.partitionBy("basket"))).where("n >= 2")
    single = many.groupBy("item").agg(F.count("*").alias("n_item"))
    total = many.agg(F.countDistinct("basket").alias("n_baskets"))
    t = basket_pairs(sales, item).join(single.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a").join(single.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b").crossJoin(total)
    t = t.withColumn("lift", F.col("together").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).withColumn("support", F.col("together") / F.col("n_baskets"))
    return t.withColumn("supported", F.col("together") >= F.greatest(F.lit(floor_least), F.floor(floor_share * F.col("n_baskets"))))
