"""The quality gate: facts about a raw table in a few aggregations, and the issues that follow from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.functions.cleaning import is_blank, parsed_number, to_datetime, to_labels
from salesprism.operators.descriptive import quantiles
from salesprism.scratch import written

BLOCK, WARN, INFO = "BLOCK", "WARN", "INFO"


#: Columns that the gate reads beside those of the file.
DATE, PRODUCT, VALUE = "_gate_date", "_gate_product", "_gate_value"


def raw_view(tidy: DataFrame, roles: dict[str, str], labels: bool = True) -> DataFrame:
    """Every row of a file with its date, product and value as far as they can be read; roles: role -> column; without labels, no product."""
    view = to_datetime(tidy, roles["date"], DATE)
    if labels:
        view = to_labels(view, roles["product"], PRODUCT)
    number = lambda role: parsed_number(F.col(f"`{roles[role]}`"))
    if "revenue" in roles:
        return view.withColumn(VALUE, number("revenue"))
    return view.withColumn(VALUE, number("quantity") * number("unit_price"))


def duplicates(raw: DataFrame) -> DataFrame:
    t = raw.groupBy(*[F.col(f"`{c}`") for c in raw.columns]).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return t.withColumn("share", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)))


def null_rates(raw: DataFrame, columns: list[str], tokens: bool = False) -> DataFrame:
    """(column, rate) of nulls and blank texts, or of all cells that mean nothing, one pass."""
    blank = lambda c: is_blank(c) if tokens else c.isNull() | (F.trim(c.cast("string")) == "")
    one = raw.agg(*[F.avg(blank(F.col(f"`{c}`")).cast("double")).alias(f"r{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"r{i}"))])).alias("column", "rate"))


def month_counts(raw: DataFrame, date: str = "date") -> DataFrame:
    return raw.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(F.count("*").alias("rows"))


def month_gaps(raw: DataFrame, date: str = "date") -> DataFrame:
    """Inner months without rows."""
    return gaps_of(written(month_counts(raw, date), "months"))


def gaps_of(m: DataFrame) -> DataFrame:
    spine = m.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(m, "month", "left_anti")


def doubled_months(raw: DataFrame, date: str = "date", factor: float = 1.85) -> DataFrame:
    return doubled_of(written(month_counts(raw, date), "months"), factor)


def doubled_of(m: DataFrame, factor: float = 1.85) -> DataFrame:
    typical = m.agg(F.percentile("rows", F.lit(0.5)).alias("median"), F.count("*").alias("months"), F.sum("rows").alias("all_rows"))
    return m.crossJoin(typical).where((F.col("rows") > factor * F.col("median")) & (F.col("all_rows") >= 90) & (F.col("months") >= 4)).select("month", "rows", "median")


def value_shares(raw: DataFrame, value: str = "revenue") -> DataFrame:
    v = F.col(value)
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return raw.where(v.isNotNull()).agg(F.count("*").alias("n"), share(v < 0).alias("negative_share"), share(v == 0).alias("zero_share"))


def date_shares(raw: DataFrame, as_of: dt.date, date: str = "date") -> DataFrame:
    d = F.to_date(date)
    return raw.agg(F.count(date).alias("dated"), F.count_if(d > F.date_add(F.lit(as_of), 1)).alias("future"), F.count_if(d < F.lit(dt.date(1990, 1, 1))).alias("ancient"))


def snapshot(raw: DataFrame, date: str = "date", product: str = "product", value: str = "revenue") -> DataFrame:
    """One row: rows, median of the values that aren't zero, distinct products, first and last date."""
    t = raw.agg(F.count("*").alias("rows"), F.countDistinct(product).alias("products"), F.to_date(F.min(date)).alias("first_date"), F.to_date(F.max(date)).alias("last_date"))
    return t.crossJoin(quantiles(raw.where(F.col(value) != 0), value, median_value=0.5)).select("rows", "median_value", "products", "first_date", "last_date")


def against_snapshot(now: DataFrame, before: DataFrame) -> DataFrame:
    """Issue codes of one snapshot against the last good one."""
    b = before.select(*[F.col(c).alias(f"old_{c}") for c in before.columns])
    rows, value = F.try_divide("rows", "old_rows") - 1, F.try_divide("median_value", "old_median_value")
    code = F.array_compact(F.array(
        F.when(rows <= -0.5, "row_count_collapse").when(rows <= -0.25, "row_count_drop"),
        F.when((value > 3) | (value < 1 / 3), "distribution_shift").when((value > 1.6) | (value < 1 / 1.6), "value_shift"),
        F.when(F.col("last_date") < F.col("old_last_date"), "history_went_backwards"),
    ))
    return now.crossJoin(b).select(F.explode(code).alias("code"))


#: What a code against the last snapshot means.
SEVERITY = {"row_count_collapse": BLOCK, "distribution_shift": BLOCK, "history_went_backwards": BLOCK, "row_count_drop": WARN, "value_shift": WARN}


def gate_facts(view: DataFrame, own: DataFrame, blanks: list[str], as_of: dt.date, date: str = DATE, value: str = VALUE, tokens: bool = True) -> DataFrame:
    """One row with what the gate judges: a pass over the rows of `own` for duplicates, and one over those of view, which has its columns, that leaves a row for each day."""
    blank, v = (lambda c: is_blank(c) if tokens else c.isNull() | (F.trim(c.cast("string")) == "")), F.col(value)
    days = view.groupBy(F.to_date(date).alias("day")).agg(
        F.count("*").alias("all"), F.count(date).alias("dated"), F.count(v).alias("values"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), *[F.count_if(blank(F.col(f"`{c}`"))).alias(f"blank{k}") for k, c in enumerate(blanks)]
    )
    days = written(days, "days")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda part, whole: F.coalesce(F.try_divide(total(part), F.sum(whole)), F.lit(0.0))
    when = lambda c: F.sum(F.when(c, F.col("dated")).otherwise(0))
    rates = [share(f"blank{k}", "all") for k in range(len(blanks))]
    sums = days.agg(
        (F.greatest(*rates) if len(rates) > 1 else rates[0] if rates else F.lit(0.0)).alias("worst_blank"), total("dated").alias("dated"), F.coalesce(when(F.col("day") > F.date_add(F.lit(as_of), 1)), F.lit(0)).alias("future"), F.coalesce(when(F.col("day") < F.lit(dt.date(1990, 1, 1))), F.lit(0)).alias("ancient"),
        total("values").alias("n"), share("negative", "values").alias("negative_share"), share("zero", "values").alias("zero_share"),
    )
    months = days.where("day is not null").groupBy(F.trunc("day", "MM").alias("month")).agg(F.sum("dated").alias("rows"))
    span = months.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("dated_rows"), F.coalesce(F.months_between(F.max("month"), F.min("month")), F.lit(0.0)).alias("span"))
    gaps, doubled = gaps_of(months).agg(F.count("*").alias("gaps")), doubled_of(months).agg(F.count("*").alias("doubled"))
    # each side is one row
    return duplicates(own).crossJoin(sums).crossJoin(span).crossJoin(gaps).crossJoin(doubled)


def judged(facts: DataFrame) -> DataFrame:
    """(code, severity) of gate_facts()."""
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    level = lambda x, block, warn: F.when(x >= block, BLOCK).when(x >= warn, WARN)
    dated, enough = F.col("dated") > 0, (F.col("dated_rows") >= 60) & (F.col("span") >= 3)
    rules = (
        ("empty_file", F.when(F.col("rows") == 0, BLOCK)),
        ("duplicate_rows", F.when(F.col("duplicates") > 0, F.coalesce(level(F.col("share"), 0.1, 0.01), F.lit(INFO)))),
        ("null_spike", level(F.col("worst_blank"), 0.3, 0.1)),
        ("no_dates", F.when((F.col("rows") > 0) & ~dated, BLOCK)),
        ("future_dates", F.when(F.col("future") > 0, F.when(share(F.col("future"), F.col("dated")) > 0.05, BLOCK).otherwise(WARN))),
        ("ancient_dates", F.when(F.col("ancient") > 0, WARN)),
        ("date_gaps", F.when(enough & (F.col("gaps") > 0), F.when(F.col("gaps") > 1, BLOCK).otherwise(WARN))),
        ("duplicated_period", F.when(enough & (F.col("doubled") > 0), WARN)),
        ("no_values", F.when((F.col("rows") > 0) & (F.col("n") == 0), BLOCK)),
        ("mostly_negative", F.when(F.col("negative_share") > 0.25, BLOCK)),
        ("some_negative", F.when((F.col("negative_share") > 0) & (F.col("negative_share") <= 0.25), INFO)),
        ("mostly_zero", F.when(F.col("zero_share") > 0.5, WARN)),
    )
    found = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), severity.alias("severity")) for code, severity in rules]), lambda x: x["severity"].isNotNull())
    return facts.select(F.explode(found).alias("x")).select("x.code", "x.severity")


def issues(raw: DataFrame, as_of: dt.date, previous: DataFrame | None = None, roles: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(code, severity) of everything the gate finds in a table, read by its roles; without roles its columns are date, product and revenue."""
    view = raw_view(raw, roles, labels=previous is not None) if roles else raw.select("*", F.to_date("date").alias(DATE), F.col("product").alias(PRODUCT), F.col("revenue").alias(VALUE))
    blanks = [roles[r] for r in ("date", "product", "revenue") if r in roles] if roles else ["date", "product", "revenue"]
    out = [(r["code"], r["severity"]) for r in judged(gate_facts(view, raw, blanks, as_of)).collect()]
    if ("empty_file", BLOCK) in out:
        return [("empty_file", BLOCK)]
    if previous is not None:
        out += [(r["code"], SEVERITY[r["code"]]) for r in against_snapshot(snapshot(view, DATE, PRODUCT, VALUE), previous).collect()]
    return out


def holds(found: list[tuple[str, str]]) -> bool:
    return any(s == BLOCK for _, s in found)
