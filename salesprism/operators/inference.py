"""Tests as sufficient statistics in Spark, with tail probabilities added on the few rows that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.seasonal import seasonal_parts
from salesprism.functions.stats import benjamini_hochberg, chi2_p, f_p, fisher_p, step_up, t_p
from salesprism.operators.customers import baskets
from salesprism.operators.descriptive import price_points
from salesprism.operators.pairs import correlated_pairs, item_vectors, pairs_tested, supported_pairs
from salesprism.operators.periods import MONTH, SEASONS, by_period, whole_periods
from salesprism.scratch import written


def slopes(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Least squares of y on x for each key: n, slope, r2, standard error, t."""
    t = points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(y).alias("mean_y"))
    rest = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    t = t.withColumn("se", F.sqrt(F.try_divide(rest, F.col("n") - 2) / F.nullif("sxx", F.lit(0.0))))
    t = t.withColumn("r2", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    return t.withColumn("t", F.try_divide("slope", "se")).drop("sxx", "syy", "sxy")


def trend(sales: DataFrame, frequency: str = MONTH, deseasonalised: bool = False) -> DataFrame:
    """One row: slope of the period sums, less their season if wanted and two cycles are there, on their number from 0, effect and fitted change against the mean."""
    series = by_period(whole_periods(sales, frequency), frequency)
    if deseasonalised:
        series = seasonal_parts(series.withColumn("subject", F.lit("")), SEASONS[frequency]).select("period", F.coalesce("adjusted", "value").alias("value"))
    series = series.withColumn("i", (F.row_number().over(Window.orderBy("period")) - 1).cast("double"))
    t = slopes(series, "i", "value")
    return t.withColumn("effect", F.try_divide("slope", F.abs("mean_y"))).withColumn("fitted_change", F.try_divide(F.col("slope") * (F.col("n") - 1), F.abs("mean_y")))


def trend_test(sales: DataFrame, frequency: str = MONTH, deseasonalised: bool = False) -> DataFrame:
    return trend(sales, frequency, deseasonalised).withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))


def elasticity(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    """Slope of log units on log price for each item, with the variation of its prices (population deviation over mean)."""
    points = price_points(sales, key, frequency).select(key, "price", F.ln("price").alias("x"), F.ln("units").alias("y"))
    spread = points.groupBy(key).agg(F.try_divide(F.stddev_pop("price"), F.avg("price")).alias("price_variation"))
    return slopes(points, "x", "y", key).join(spread, key).withColumn("usable", (F.col("n") >= 6) & (F.col("price_variation") >= 0.05))


def elasticity_tests(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    t = elasticity(sales, key, frequency).where("usable and t is not null").withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))
    return step_up(t, "p").withColumn("responds", (F.col("adjusted") < 0.05) & (F.abs("slope") >= 0.3))


def level_shift(series: DataFrame, split: Column) -> DataFrame:
    """One row: Welch's t of the mean of (period, value) where split is false against where it is true, with its degrees of freedom."""
    one = lambda c: (F.count_if(c).alias, F.avg(F.when(c, F.col("value"))), F.var_samp(F.when(c, F.col("value"))))
    (n0, m0, v0), (n1, m1, v1) = one(~split), one(split)
    t = series.agg(n0("n_before"), n1("n_after"), m0.alias("mean_before"), m1.alias("mean_after"), v0.alias("var_before"), v1.alias("var_after"))
    a, b = F.col("var_before") / F.col("n_before"), F.col("var_after") / F.col("n_after")
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n_before") - 1) + b * b / (F.col("n_after") - 1))
    return t.withColumn("t", F.try_divide(F.col("mean_after") - F.col("mean_before"), F.sqrt(a + b))).withColumn("df", df).drop("var_before", "var_after")


def level_shift_test(series: DataFrame, split: Column) -> DataFrame:
    return level_shift(series, split).withColumn("p", t_p("t", "df"))


def by_dimension(sales: DataFrame, dimensions: list[str], *columns: str) -> DataFrame:
    """(dimension, level, *columns): a row for each dimension of a sale that has a level, so that one pass serves all dimensions."""
    long = sales.select(*columns, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dimensions])).alias("x"))
    return long.select("x.dimension", "x.level", *columns).where("level is not null")


def group_statistics(sales: DataFrame, dimensions: list[str], measure: str = "revenue") -> DataFrame:
    return by_dimension(sales, dimensions, measure).where(F.col(measure).isNotNull()).groupBy("dimension", "level").agg(F.count("*").alias("n"), F.avg(measure).alias("mean"), F.var_samp(measure).alias("var"))


def group_difference(sales: DataFrame, dimensions: list[str], measure: str = "revenue", least: int = 5) -> DataFrame:
    """For each dimension: F of one-way analysis of variance (Welch's t squared and its degrees for two levels), effect."""
    g = group_statistics(sales, dimensions, measure).where(F.col("n") >= least)
    # products of counts are doubles: as longs they overflow at some two million rows a level
    n = F.col("n").cast("double")
    out = g.groupBy("dimension").agg(
        F.count("*").alias("levels"), F.sum("n").alias("rows"), F.sum(n * F.col("mean")).alias("s"), F.sum(n * F.col("mean") * F.col("mean")).alias("ss"), F.sum((n - 1) * F.col("var")).alias("within"),
        F.max("mean").alias("high"), F.min("mean").alias("low"), F.sum(F.col("var") / n).alias("se2"), F.sum(F.col("var") * F.col("var") / (n * n * (n - 1))).alias("wd"),
    )
    mean = F.col("s") / F.col("rows")
    between = F.col("ss") - F.col("s") * mean
    anova = F.try_divide(between / (F.col("levels") - 1), F.col("within") / (F.col("rows") - F.col("levels")))
    welch = F.try_divide((F.col("high") - F.col("low")) * (F.col("high") - F.col("low")), F.col("se2"))
    two = F.col("levels") == 2
    out = out.where("levels between 2 and 12").select(
        "dimension", "levels", "rows", F.when(two, welch).otherwise(anova).alias("statistic"), (F.col("levels") - 1).cast("double").alias("df1"),
        F.when(two, F.try_divide(F.col("se2") * F.col("se2"), F.col("wd"))).otherwise(F.col("rows") - F.col("levels")).cast("double").alias("df2"), ((F.col("high") - F.col("low")) / F.abs(mean)).alias("effect"),
    )
    return out


def segmentation_tests(sales: DataFrame, dimensions: list[str], item: str = "product") -> DataFrame:
    """group_difference() with p, adjusted p over the dimensions, and whether the product mix differs between levels."""
    t = benjamini_hochberg(group_difference(sales, dimensions).withColumn("p", f_p("statistic", "df1", "df2")), "p", "dimension")
    mixes = mix_statistics(mix_grid(sales, dimensions, item))
    mixes = mixes.withColumn("mix_p", F.when(F.col("small_share") <= 0.2, chi2_p("chi2", F.col("df").cast("double"))))
    return t.join(mixes.select("dimension", "mix_p"), "dimension", "left").withColumn("confounded", F.coalesce(F.col("mix_p") < 0.05, F.lit(False)))


def mix_grid(sales: DataFrame, dimensions: list[str], item: str = "product") -> DataFrame:
    """Counts of all pairs of level and item of each dimension, with the count expected if they were independent. The sales are read once."""
    t = written(by_dimension(sales, dimensions, item).groupBy("dimension", "level", F.col(item).alias("item")).agg(F.count("*").alias("n")), "mix")
    levels = t.groupBy("dimension", "level").agg(F.sum("n").alias("n_level"))
    items = t.groupBy("dimension", "item").agg(F.sum("n").alias("n_item"))
    grid = levels.join(items, "dimension").join(t, ["dimension", "level", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("expected", F.col("n_level").cast("double") * F.col("n_item") / F.sum("n").over(Window.partitionBy("dimension")))


def mix_statistics(grid: DataFrame) -> DataFrame:
    """For each dimension: chi-squared (Yates' correction for one degree of freedom), degrees, share of cells expected below 5."""
    df = ((F.countDistinct("level") - 1) * (F.countDistinct("item") - 1)).alias("df")
    gap = F.abs(F.col("n") - F.col("expected"))
    plain = F.sum(gap * gap / F.col("expected"))
    yates = F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / F.col("expected"))
    t = grid.groupBy("dimension").agg(df, plain.alias("plain"), yates.alias("yates"), F.avg((F.col("expected") < 5).cast("double")).alias("small_share"))
    return t.select("dimension", F.when(F.col("df") == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), "df", "small_share")


def mix_table(sales: DataFrame, dimension: str, item: str = "product") -> DataFrame:
    """mix_grid() of one dimension."""
    return mix_grid(sales, [dimension], item).drop("dimension")


def mix_statistic(sales: DataFrame, dimension: str, item: str = "product") -> DataFrame:
    """mix_statistics() of one dimension."""
    return mix_statistics(mix_grid(sales, [dimension], item)).drop("dimension")


def product_correlation(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    """Pearson's r of each pair of items active often enough, over the observed periods."""
    vectors = item_vectors(sales, key, frequency)
    return correlated_pairs(vectors, vectors.count())


def correlation_tests(sales: DataFrame, key: str = "product", frequency: str = MONTH, bound: float | None = None) -> DataFrame:
    """Tests of all pairs with adjusted p; with a bound, of the pairs whose p is at most that, adjusted among all that were tested.

    An adjusted p is never below the p itself, so up to the bound the adjusted ones are the same without the rest.
    """
    vectors = item_vectors(sales, key, frequency)
    t = correlated_pairs(vectors, vectors.count(), bound).where("r is not null")
    stat = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15))))
    t = step_up(t.withColumn("p", t_p(stat, (F.col("n") - 2).cast("double"))), "p", total=None if bound is None else pairs_tested(vectors))
    return t.withColumn("related", (F.col("adjusted") < 0.05) & (F.abs("r") >= 0.5))


def basket_tests(sales: DataFrame, item: str = "product") -> DataFrame:
    """Fisher's exact test of each supported pair with lift, support and adjusted p; frequent items and so supported pairs are few."""
    t = supported_pairs(baskets(sales, item))
    t = t.withColumn("lift", F.col("together").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).withColumn("support", F.col("together") / F.col("n_baskets"))
    t = t.withColumn("p", fisher_p(*[F.col(c).cast("double") for c in ("together", "n_a", "n_b", "n_baskets")]))
    return benjamini_hochberg(t, "p", "a", "b").withColumn("confirmed", (F.col("adjusted") < 0.05) & (F.col("lift") >= 1.5))
