"""Messy cells to typed values, as column expressions; rates that decide about a whole column come from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.scratch import written

# Cells that mean nothing, currency signs and words, the window of spreadsheet date serials.
NULL_TOKENS = ("", "-", "--", "---", "n/a", "na", "nan", "nil", "none", "null", "#n/a", "#value!", "#div/0!", "#ref!", "tbd", "unknown", "?", ".")
SIGNS = "₦$£€¥"
CURRENCY_WORDS = "ngn|naira|usd|gbp|eur|kes|ghs|zar|n"
SERIAL_EPOCH, SERIAL_FIRST, SERIAL_LAST = "1899-12-30", 20000, 60000

DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")
EITHER = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd")


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NULL_TOKENS)


def to_text(c: Column) -> Column:
    return F.when(~is_blank(c), F.trim(c.cast("string")))


def number_token(c: Column) -> Column:
    """The cell as a plain number text: signs, words, spaces and separators off, (x) and x- negative."""
    t = F.trim(c.cast("string"))
    t = F.regexp_replace(t, r"%\s*$", "")
    t = F.regexp_replace(t, rf"[{SIGNS}]", "")
    t = F.regexp_replace(F.trim(t), rf"(?i)^({CURRENCY_WORDS})\s*(?=[0-9(.\-])", "")
    t = F.regexp_replace(t, r"[\s,'’]", "")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return F.regexp_replace(t, r"^([^-].*)-$", "-$1")


NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parsed_number(c: Column) -> Column:
    """The cell as a number; what is one as it stands, or has no digit, isn't taken apart."""
    text, t = F.trim(c.cast("string")), number_token(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike("[0-9]"), F.when(~is_blank(c) & t.rlike(NUMBER), t.try_cast("double")))


def to_numeric(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column parsed; if half of its cells carry a per cent sign the whole column is divided by 100."""
    share = df.agg(F.avg(F.when(~is_blank(named(column)), F.rtrim(named(column)).endswith("%").cast("double")))).first()[0] or 0.0
    return df.withColumn(out, parsed_number(named(column)) / (100.0 if share >= 0.5 else 1.0))


def _first_format(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def to_datetime(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column as dates: serials if nine in ten numbers lie in their window, else the better of day and month first.

    Where both readings of a cell exist, its separator decides: a first part above 12 anywhere means day first, a
    second part above 12 month first, else the reading that more often falls inside the range of the certain dates.
    """
    # each spelling is parsed once, however many rows have it
    spelled = written(df.groupBy(named(column).cast("string").alias("_raw")).agg(F.count("*").alias("_times")), "dates")
    cell, times = F.col("_raw"), F.col("_times")
    t, number, filled = F.trim(cell), parsed_number(cell), ~is_blank(cell)
    total = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    rates = spelled.agg(total(filled).alias("n"), total(number.isNotNull()).alias("numeric"), total(number.between(SERIAL_FIRST, SERIAL_LAST)).alias("serial")).first()
    if rates["n"] and rates["numeric"] >= 0.9 * rates["n"]:
        own = parsed_number(named(column))
        serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(own).cast("int"))
        return df.withColumn(out, F.when(own.between(SERIAL_FIRST, SERIAL_LAST), serial) if rates["serial"] >= 0.9 * rates["numeric"] else F.lit(None).cast("date"))
    day, month = F.coalesce(_first_format(t, EITHER), _first_format(t, DAY_FIRST)), F.coalesce(_first_format(t, EITHER), _first_format(t, MONTH_FIRST))
    spelled = spelled.where("_raw is not null").withColumn("_d", F.when(filled, day)).withColumn("_m", F.when(filled, month))
    verdicts = separator_verdicts(spelled, "_raw", "_d", "_m", "_times")
    sep = F.regexp_extract(t, r"^\d{1,2}([/.\-])\d{1,2}\1", 1)
    chosen = spelled.withColumn("_s", sep).join(F.broadcast(verdicts.select(F.col("separator").alias("_s"), "day_first")), "_s", "left")
    dates = chosen.select("_raw", F.when(F.coalesce("day_first", F.lit(True)), F.coalesce("_d", "_m")).otherwise(F.coalesce("_m", "_d")).alias(out))
    return df.withColumn("_cell", named(column).cast("string")).join(dates, F.col("_cell") == F.col("_raw"), "left").drop("_cell", "_raw")


def separator_verdicts(df: DataFrame, column: str, day: str, month: str, weight: str | None = None) -> DataFrame:
    """(separator, day_first) for the at most three separators of numeric dates; weight: a column with the rows that a cell stands for."""
    times = F.col(weight) if weight else F.lit(1)
    t = F.trim(named(column).cast("string"))
    pattern = r"^(\d{1,2})([/.\-])(\d{1,2})\2"
    parts = df.where(t.rlike(pattern)).select(F.regexp_extract(t, pattern, 2).alias("separator"), F.regexp_extract(t, pattern, 1).try_cast("int").alias("first"), F.regexp_extract(t, pattern, 3).try_cast("int").alias("second"), F.col(day).alias("d"), F.col(month).alias("m"), times.alias("times"))
    certain = df.select(times.alias("times"), F.when(F.col(day) == F.col(month), F.col(day)).when(F.col(day).isNull() | F.col(month).isNull(), F.coalesce(day, month)).alias("x")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("times"))), F.lit(0)).alias("certain")).select("low", "high", "certain")
    parts = parts.crossJoin(certain)
    t = parts.groupBy("separator").agg(F.max(F.col("first") > 12).alias("day_sure"), F.max(F.col("second") > 12).alias("month_sure"), F.coalesce(F.sum(F.when(F.col("d").between(F.col("low"), F.col("high")), F.col("times"))), F.lit(0)).alias("day_hits"), F.coalesce(F.sum(F.when(F.col("m").between(F.col("low"), F.col("high")), F.col("times"))), F.lit(0)).alias("month_hits"), F.max("certain").alias("certain"))
    return t.select("separator", F.when(F.col("day_sure"), True).when(F.col("month_sure"), False).otherwise((F.col("certain") < 3) | (F.col("day_hits") >= F.col("month_hits"))).alias("day_first"))


def label_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[_\-/]+", " "), r"\s+", " "))


def fold_labels(df: DataFrame, column: str) -> DataFrame:
    """(key, raw, n, label): each spelling with the most frequent one of its key, ties to the smaller text.

    Spellings are counted first, so the window ranks distinct spellings and not rows.
    """
    raw = to_text(named(column))
    t = df.select(raw.alias("raw")).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n")).withColumn("key", label_key(F.col("raw")))
    return t.withColumn("label", F.first("raw").over(Window.partitionBy("key").orderBy(F.col("n").desc(), "raw")))


def to_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    folds = fold_labels(df, column).select(F.col("raw").alias("_raw"), F.col("label").alias(out))
    return df.withColumn("_t", to_text(named(column))).join(folds, F.col("_t") == F.col("_raw"), "left").drop("_t", "_raw")


def normal_name(c: Column) -> Column:
    """A column name as lower-case words: the naira sign a word, other signs off, camel case split."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "₦", " naira "), r"[$£€¥]", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 up to a and from d on, 1 from b to c, linear between."""
    return F.when(x.isNull() | (x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c))
