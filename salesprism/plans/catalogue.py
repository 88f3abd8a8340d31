"""Registered queries of the sales engine and the SQL that checks them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.functions import cleaning as C
from salesprism.functions import text as X
from salesprism.functions.stats import benjamini_hochberg
from salesprism.operators import customers as K
from salesprism.operators import descriptive as D
from salesprism.operators import inference as I
from salesprism.operators import monitoring as M
from salesprism.operators import periods as P
from salesprism.operators import quality as Q
from salesprism.plans.oracles import SQL
from salesprism.plans.sales import EVERY_COLUMN, sales_view

Query = Callable[[SparkSession, str], DataFrame]
DIMENSIONS = ["channel", "region", "group_segment"]
GOAL_START, GOAL_END, GOAL_TARGET = dt.date(2000, 1, 1), dt.date(2000, 12, 31), 1e9
AS_OF = dt.date(2001, 8, 1)
_REGISTRY: dict[str, Query] = {}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def _query(*columns: str) -> Callable:
    """Registers an analysis of the sales table, of these columns or of all, under its name."""

    def register(f: Callable[[DataFrame], DataFrame]):
        _REGISTRY[f.__name__] = lambda spark, sf_dir: _rounded(f(sales_view(spark, sf_dir, columns or EVERY_COLUMN)))
        return f

    return register


def _table_query(table: str):
    def register(f):
        _REGISTRY[f.__name__] = lambda spark, sf_dir: _rounded(f(spark.read.parquet(f"{sf_dir}/{table}.parquet")))
        return f

    return register


@_query("date", "revenue")
def period_sum_month(s):
    return P.by_period(s, P.MONTH)


@_query("date", "revenue")
def period_sum_week(s):
    return P.by_period(P.whole_periods(s, P.WEEK), P.WEEK)


def _event_sales(e: DataFrame) -> DataFrame:
    return e.select(F.to_date("ts").alias("date"), F.col("event_type").alias("product"), F.round("value", 2).alias("revenue"))


@_table_query("events")
def period_sum_day(e):
    return P.by_period(_event_sales(e), P.DAY)


@_query("date", "category", "revenue")
def product_period_matrix(s):
    return P.whole_by_period_and(s, "category", P.MONTH)


@_query("product", "revenue")
def product_ranking(s):
    return D.product_ranking(s)


@_query("category", "revenue", "profit")
def margin_by_product(s):
    return D.margin_by_product(s, "category")


@_query("category", "revenue")
def concentration_stats(s):
    return D.concentration(s, "category")


@_query("category", "revenue")
def pareto_classes(s):
    return D.pareto_classes(s, "category")


@_query("date", "product", "revenue")
def revenue_decomposition(s):
    return D.decomposition(s)


@_query("date", "channel", "region", "group_segment", "revenue")
def dimension_decomposition(s):
    return D.dimension_decomposition(s, DIMENSIONS)


@_query("date", "revenue", "quantity")
def price_volume_split(s):
    return D.price_volume_split(s)


@_query("date", "revenue")
def month_of_year_index(s):
    return D.month_index(s)


@_query("date", "category", "revenue")
def lifecycle_status(s):
    return D.lifecycle(s, "category")


@_query("order_id", "revenue")
def order_value_quantiles(s):
    return D.order_spread(D.order_values(s))


@_query("order_id", "revenue")
def top_decile_share(s):
    return D.top_decile(D.order_values(s))


@_query("date", "revenue")
def trend_regression(s):
    return I.trend(s).select("n", "slope", "r2", "t", "effect", "fitted_change")


@_query("date", "category", "revenue", "quantity")
def price_elasticity(s):
    return I.elasticity(s, "category").select("category", "n", "slope", "r2", "t", "price_variation", "usable")


@_query("channel", "region", "group_segment", "revenue")
def segment_anova_stats(s):
    return I.group_difference(s, DIMENSIONS)


@_query("channel", "product")
def product_mix_crosstab(s):
    return I.mix_table(s, "channel")


@_query("region", "product")
def product_mix_chi2(s):
    return I.mix_statistic(s, "region")


@_query("date", "category", "revenue")
def product_correlation(s):
    return I.product_correlation(s, "category")


@_query("category", "profit")
def bh_adjustment(s):
    """Adjusted values of a family of numbers in 0..1: each category's share of its revenue that lost money."""
    t = s.groupBy("category").agg(F.round(F.avg((F.col("profit") < 0).cast("double")), 9).alias("p"))
    return benjamini_hochberg(t, "p", "category")


@_query("date", "customer_id", "revenue")
def repeat_vs_new(s):
    return K.repeat_vs_new(s)


@_query("date", "customer_id", "revenue")
def rfm_scores(s):
    return K.rfm(s)


@_query("date", "customer_id", "revenue")
def rfm_segments(s):
    return K.rfm_segments(s)


@_query("date", "customer_id")
def cohort_sizes(s):
    return K.cohort_sizes(s)


@_query("date", "customer_id")
def cohort_retention(s):
    return K.cohort_retention(s)


@_query("date", "customer_id")
def retention_curve(s):
    return K.retention_curve(s)


@_query("order_id", "product")
def basket_pairs(s):
    return K.basket_pairs(s)


@_query("order_id", "category")
def basket_lift(s):
    return K.basket_lift(s, "category")


@_query("order_id", "product")
def basket_fisher(s):
    return I.basket_tests(s).select("a", "b", "together", "lift", "p", "adjusted", "confirmed")


def _goals(spark: SparkSession) -> DataFrame:
    rows = [("year", "revenue", GOAL_TARGET, GOAL_START, GOAL_END), ("margin", "profit", 5e6, dt.date(2001, 1, 1), dt.date(2001, 12, 31)), ("later", "revenue", 1e6, dt.date(2002, 1, 1), dt.date(2002, 12, 31))]
    return spark.createDataFrame(rows, "id string, metric string, target double, start date, end date")


@_query("date", "revenue", "profit")
def goal_progress(s):
    return M.goal_progress(s, _goals(s.sparkSession))


@_query("date", "revenue")
def goal_pace(s):
    return M.goal_pace(s, GOAL_TARGET, GOAL_START, GOAL_END)


@_query("date", "category", "revenue")
def goal_gap_drivers(s):
    return M.goal_gap_drivers(s, GOAL_START, GOAL_END, "category")


def _series(s: DataFrame) -> DataFrame:
    return P.whole_by_period_and(s, "category", P.MONTH).withColumnRenamed("category", "subject")


@_query("date", "category", "revenue")
def robust_z_scores(s):
    return M.robust_scores(_series(s), "subject")


@_query("date", "category", "revenue")
def anomaly_candidates(s):
    return M.anomalies(_series(s), recent=80, z=2.5).select("subject", "period", "value", "median", "z", "run", "kind")


@_table_query("lineitem")
def quality_duplicates(t):
    return Q.duplicates(t.select("l_orderkey", "l_linenumber"))


@_table_query("documents")
def quality_nulls(t):
    return Q.null_rates(t, ["text", "lang", "source"])


@_query("date")
def quality_gaps(s):
    return Q.month_gaps(s.where(F.month("date") % 5 != 0))


@_query("date")
def quality_duplicated_period(s):
    busy = s.where(F.month("date") == 3)
    return Q.doubled_months(s.select("date").union(busy.select("date")))


@_query("profit")
def quality_values(s):
    return Q.value_shares(s, "profit")


@_query("date")
def quality_dates(s):
    return Q.date_shares(s, dt.date(2001, 1, 1))


@_query("date", "product", "revenue")
def quality_vs_snapshot(s):
    return Q.against_snapshot(Q.snapshot(s.where(F.col("date") < F.lit(dt.date(1998, 1, 1)))), Q.snapshot(s))


@_query("date", "category", "revenue")
def snapshot(s):
    return Q.snapshot(s, product="category")


PLANTED = {"date": "Order Date", "product": "Item", "revenue": "Amount Paid"}


def _planted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as a file of texts in which the dates of returned ones are missing."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    date = F.when(F.col("l_returnflag") == "R", " ").otherwise(F.to_date("o_orderdate").cast("string"))
    return t.select(date.alias("Order Date"), F.col("l_partkey").cast("string").alias("Item"), F.col("l_extendedprice").cast("string").alias("Amount Paid"))


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of that file before any of its rows is dropped."""
    raw = _planted_file(spark, sf_dir)
    return Q.judged(Q.gate_facts(Q.raw_view(raw, PLANTED, labels=False), raw, list(PLANTED.values()), AS_OF))


_REGISTRY["quality_issues"] = quality_issues


@_query("date", "revenue")
def level_shift(s):
    """Months before and since 1998."""
    return I.level_shift(P.by_period(P.whole_periods(s, P.MONTH), P.MONTH), F.col("period") >= F.lit(dt.date(1998, 1, 1)))


@_table_query("orders")
def median_gap(t):
    return P.median_gap(t.select(F.to_date("o_orderdate").alias("period")))


@_query("date", "customer_id", "revenue")
def customer_sample(s):
    return K.chart_sample(s)


@_table_query("customer")
def column_profile_full(t):
    from salesprism.plans.detection import profile_table

    return profile_table(t.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))


@_query("date", "product", "revenue", "profit")
def goal_projection(s):
    return M.goal_projection(s, _goals(s.sparkSession))


@_query("date", "product", "revenue", "profit")
def alerts(s):
    """Alerts of anomalies and of goals out of reach, once each, the gravest first."""
    found = M.anomaly_alerts(M.sales_anomalies(s)).unionByName(M.goal_alerts(M.goal_projection(s, _goals(s.sparkSession))))
    return M.fresh_alerts(found, s.sparkSession.createDataFrame([], "key string"))


def _spellings(t: DataFrame) -> DataFrame:
    """Order priorities in three spellings, by order key."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 4
    return t.select(F.when(k == 0, F.upper(p)).when(k == 1, F.translate(p, "-", "_")).when(k == 2, F.concat(F.lit(" "), F.lower(p))).otherwise(p).alias("label"))


@_table_query("orders")
def label_folding(t):
    return C.fold_labels(_spellings(t), "label")


def _amounts(t: DataFrame) -> DataFrame:
    """Prices as people type them."""
    v, k = F.col("p_retailprice"), F.col("p_partkey") % 6
    plain = v.cast("decimal(12,2)").cast("string")
    text = F.when(k == 0, F.concat(F.lit("N"), F.format_number(v, 2))).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(F.lit("₦ "), plain)).when(k == 3, F.lit("n/a")).when(k == 4, F.concat(plain, F.lit("-"))).otherwise(F.concat(F.lit("USD "), F.format_number(v, 2)))
    return t.select("p_partkey", text.alias("amount"))


@_table_query("part")
def numeric_parse(t):
    return _amounts(t).select("p_partkey", C.parsed_number(F.col("amount")).alias("value"))


@_table_query("orders")
def date_ambiguity(t):
    """Dates written day first with slashes: the separator's verdict and the hits of both readings."""
    d = t.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    d = d.withColumn("day", F.to_date(F.try_to_timestamp("d", F.lit("d/M/yyyy")))).withColumn("month", F.to_date(F.try_to_timestamp("d", F.lit("M/d/yyyy"))))
    return C.separator_verdicts(d, "d", "day", "month")


@_query("cost", "quantity", "revenue")
def cost_basis_cv(s):
    unit = F.try_divide("cost", "quantity")
    whole, per = F.try_divide(unit * F.col("quantity"), F.col("revenue")), F.try_divide(unit, F.col("revenue"))
    return s.agg((F.stddev_samp(whole) / F.avg(whole)).alias("per_unit_cv"), (F.stddev_samp(per) / F.avg(per)).alias("line_cv"))


def _texts(s: DataFrame, **digits: int) -> DataFrame:
    """Columns as a file would hold them."""
    return s.select(*[F.col(c).cast(f"decimal(24,{d})").cast("string").alias(c) for c, d in digits.items()])


@_query("revenue", "quantity", "unit_price")
def revenue_corroboration(s):
    from salesprism.plans.detection import corroboration

    return corroboration(_texts(s, revenue=2, quantity=2, unit_price=8), "revenue", "quantity", "unit_price")


@_query("cost", "quantity", "revenue")
def cost_basis(s):
    """The engine's choice for a column of costs a unit, and for one of costs a line."""
    from salesprism.plans.detection import cost_spreads

    t = s.withColumn("unit", F.try_divide("cost", "quantity"))
    return cost_spreads(_texts(t, unit=4, cost=2, quantity=2, revenue=2), {"unit": "unit", "line": "cost"}, "quantity", "revenue")


@_table_query("customer")
def column_profile(t):
    """Per column: filled rows, distinct values, mean length, share of numbers."""
    cols = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    long = t.select(F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "value"))
    v = F.col("value")
    return long.groupBy("column").agg(F.count("value").alias("filled"), F.countDistinct("value").alias("distinct"), F.avg(C.is_blank(v).cast("double")).alias("blank_rate"), F.avg(C.parsed_number(v).isNotNull().cast("double")).alias("numeric_rate"))


def _alerts(e: DataFrame) -> DataFrame:
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_type").alias("kind"), level.alias("level"), F.concat(F.lit("u"), F.col("user_id")).alias("subject"), F.to_date("ts").alias("period"), F.col("event_id").alias("seq"))


@_table_query("events")
def alert_dedupe(e):
    a = _alerts(e)
    sent = a.where("seq < 500").select(M.alert_key(F.col("kind"), F.col("subject"), F.col("period")).alias("key")).distinct()
    return M.fresh_alerts(a, sent)


@_query("category", "revenue", "profit")
def story_rank(s):
    """Categories as findings: importance is the margin's distance from the mean, losing ones are urgent."""
    m = D.margin_by_product(s, "category").withColumn("importance", F.round(F.abs(F.col("margin") - F.avg("margin").over(P.everything())), 6))
    m = m.withColumn("severity", F.when(F.col("margin") < 0.5, "URGENT").when(F.col("margin") < 0.55, "WATCH").otherwise("NEUTRAL"))
    from salesprism.plans.findings import story_score

    m = m.select(F.col("category").alias("id"), "severity", story_score(F.col("importance"), F.col("severity"), F.lit(False)).alias("score"))
    from pyspark.sql import Window

    return m.withColumn("position", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


@_table_query("conversations")
def directive_guard(t):
    return t.select("conv_id", "turn", X.directive_count(F.col("text")).alias("reasons"))


@_table_query("conversations")
def number_tokens(t):
    return t.select("conv_id", "turn", F.array_join(X.numbers_in(F.coalesce("text", F.lit(""))), "|").alias("numbers"))


@_table_query("conversations")
def keyword_routing(t):
    return X.route_scores(t.where("text is not null").withColumn("key", F.concat_ws("/", "conv_id", "turn")), "key", "text")


@_query("category", "revenue")
def first_sentences(s):
    t = s.groupBy("category").agg(P.money("revenue").alias("v"))
    return t.select("category", X.first_sentence(F.concat(F.lit("It sold 1.5 times. "), F.col("category"), F.lit(" came next."))).alias("sentence"))


# Without SQL: tail probabilities, seasonal and ARIMA models.


@_query("date", "revenue")
def trend_test(s):
    return I.trend_test(s)


@_query("date", "category", "revenue", "quantity")
def price_response_tests(s):
    return I.elasticity_tests(s, "category")


@_query("channel", "region", "group_segment", "revenue", "product")
def segmentation_tests(s):
    return I.segmentation_tests(s, DIMENSIONS)


@_query("date", "category", "revenue")
def product_relationship_tests(s):
    return I.correlation_tests(s, "category")


@_query("date", "category", "revenue")
def seasonal_strength(s):
    from salesprism.functions.seasonal import seasonal_parts

    return seasonal_parts(_series(s).unionByName(P.by_period(P.whole_periods(s, P.MONTH), P.MONTH).withColumn("subject", F.lit("all"))), 12).groupBy("subject").agg(F.first("strength").alias("strength"))


@_query("date", "category", "revenue")
def deseasonalised(s):
    from salesprism.functions.seasonal import seasonal_parts

    return seasonal_parts(_series(s), 12)


@_query("date", "product", "revenue")
def arima_forecast(s):
    from salesprism.functions.arima import forecasts

    return forecasts(P.whole_by_period_and(s, "product", P.MONTH).withColumnRenamed("product", "subject"), horizon=3, floor=0.0)


@_query("date", "product", "revenue")
def backtest_error(s):
    return arima_forecast(s).groupBy("subject").agg(F.first("model").alias("model"), F.first("backtest_error").alias("backtest_error"), F.first("direction").alias("direction"))


def _raw_sales(s: DataFrame) -> DataFrame:
    return s.select(F.col("date").cast("string").alias("Order Date"), F.col("product").alias("Item"), F.col("quantity").cast("string").alias("Qty"), F.col("revenue").cast("string").alias("Amount Paid"), F.col("order_id").alias("Order No"), F.col("customer_id").alias("Customer ID"), F.col("channel").alias("Sales Channel"))


RAW_SALES = ("date", "product", "quantity", "revenue", "order_id", "customer_id", "channel")


@_query(*RAW_SALES)
def content_scores(s):
    from salesprism.plans.detection import content_table

    return content_table(_raw_sales(s))


@_query(*RAW_SALES)
def column_roles(s):
    from salesprism.plans.detection import detect

    found = detect(_raw_sales(s))
    return s.sparkSession.createDataFrame([(k, v, float(found.scores.get(k, 0))) for k, v in sorted(found.roles.items())], "role string, column string, score double")


def _answers(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A finding for each customer, and an answer about each: some as they should be, others wrong in one way each."""
    t = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), P.money("o_totalprice").alias("spend"), F.max("o_totalprice").alias("largest"), P.money(F.col("o_totalprice") * F.when(F.year("o_orderdate") >= 1996, 1).otherwise(-1)).alias("change"))
    c, name = F.col("o_custkey"), F.concat(F.lit("House Q"), F.col("o_custkey"))
    facts = F.to_json(F.struct(name.alias("name"), F.col("orders"), F.col("change"), F.struct(F.array("spend", "largest").alias("sums")).alias("money")))
    found = t.select(
        F.concat(F.lit("customer_"), c).alias("id"), F.when(c % 2 == 0, "DECOMPOSITION").otherwise("TREND").alias("type"), F.concat(name, F.lit(" placed "), "orders", F.lit(" orders.")).alias("summary"),
        facts.alias("facts"), F.when(F.col("orders") >= 10, "clear").otherwise("worth a look").alias("strength"),
    )
    texts = (
        F.concat(name, F.lit(" placed "), "orders", F.lit(" orders worth "), F.round("spend").cast("long"), F.lit(".")), F.concat(name, F.lit(" possibly placed "), F.col("orders") + 1, F.lit(" orders.")),
        F.concat(F.lit("It seems House Q"), c + 1_000_000, F.lit(" leads.")), F.concat(F.lit("Orders of "), name, F.lit(" may have moved because prices did.")), F.when(F.col("change") > 0, "It fell, as it seems.").otherwise("It rose, as it seems."),
        F.lit("It may be that you should order more."), F.concat(name, F.lit(" may lead.")), F.lit("   "), F.when(c % 2 == 0, "There may be nothing about candles.").otherwise("Candles may do well."),
    )
    text = F.coalesce(*[F.when(c % len(texts) == k, x) for k, x in enumerate(texts)])
    cited = F.array(F.when(c % len(texts) == 6, "nobody").otherwise(F.concat(F.lit("customer_"), c)))
    return t.select(c.cast("string").alias("answer_id"), text.alias("text"), cited.alias("cited"), F.array(F.lit("candles")).alias("absent")), found


@_table_query("orders")
def answer_checks(orders):
    from salesprism.plans.guards import verdicts

    return verdicts(*_answers(orders))


@_query()
def findings(s):
    from salesprism.plans.findings import story

    return story(s)


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _REGISTRY}
