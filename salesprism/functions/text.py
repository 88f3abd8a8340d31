"""Text predicates over findings and questions: advice, numbers, routes, glossary terms, first sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrasings that turn an observation into an instruction.
DIRECTIVES = (
    r"\byou should\b",
    r"\byou must\b",
    r"\byou need to\b",
    r"\bwe recommend\b",
    r"\bwe suggest\b",
    r"\bour advice\b",
    r"\bconsider (?:raising|lowering|dropping|removing|cutting)\b",
    r"\b(?:try|start|stop) (?:raising|lowering|selling|discounting)\b",
    r"\bworth (?:raising|cutting|dropping|removing)\b",
    r"\bshould be (?:raised|lowered|removed|dropped|cut)\b",
    r"\bneeds? a (?:backup|price|discount) \w+\b",
    r"\bbundle idea\b",
    r"\b(?:raise|lower|cut|drop|remove|discontinue) (?:the |your )?price\b",
)

# Words that lead to a route, and the findings that can answer it.
ROUTES = {
    "why_change": (("why", "cause", "reason", "driver", "what happened", "explain"), ("revenue_decomposition",)),
    "break_down_by_channel": (("channel", "online", "in store", "wholesale", "where"), ("decomposition_channel", "segmentation_channel")),
    "break_down_by_region": (("region", "location", "city", "state", "lagos", "abuja", "branch"), ("decomposition_region", "segmentation_region")),
    "price_or_volume": (("price", "volume", "units", "quantity", "cheaper", "expensive"), ("price_volume_split",)),
    "compare_last_year": (("last year", "year ago", "previous year", "seasonal", "same period"), ("seasonality", "revenue_trend")),
    "always_like_this": (("always", "history", "before", "used to", "trend", "over time"), ("revenue_trend",)),
    "most_profitable": (("profit", "margin", "make money", "makes money", "making money", "profitable", "earn", "cost"), ("margin_reality", "loss_making_product")),
    "concentration": (("depend", "concentration", "risk", "reliant", "biggest share"), ("concentration",)),
    "which_customers": (("customer", "who", "repeat", "new", "loyal", "churn", "lost"), ("repeat_vs_new", "rfm_segments", "cohort_retention")),
    "week_by_week": (("week", "weekly", "when did", "started", "day"), ("revenue_trend",)),
    "what_sells_together": (("together", "pair", "bundle", "cross sell", "correlat", "also buy"), ("basket_analysis", "product_relationships")),
    "whats_coming": (("forecast", "predict", "next month", "future", "heading", "expect"), ("revenue_forecast",)),
}


def directive_count(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for p in DIRECTIVES:
        out = out + low.rlike(p).cast("int")
    return out


def numbers_in(text: Column) -> Column:
    """Numbers of a text without separators, and without zeros at the end of a fraction."""
    raw = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*\.?[0-9]*)"), F.lit(1))
    plain = lambda t: F.regexp_replace(t, ",", "")
    trim = lambda t: F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)
    return F.transform(raw, lambda t: trim(plain(t)))


def route_scores(questions: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, route, confidence): the route with most keyword hits, longer ones first; nothing without a hit.

    The routes are an expression over twelve constants, not a join.
    """
    q = F.lower(text_column)
    scored = []
    for name, (words, _) in ROUTES.items():
        hits = sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))
        longest = F.greatest(F.lit(0), *[F.when(F.contains(q, F.lit(w)), len(w)).otherwise(0) for w in words])
        scored.append(F.struct((hits + longest / 100).alias("score"), F.lit(name).alias("route")))
    best = F.array_max(F.array(*scored))
    out = questions.select(F.col(id_column), best.alias("b")).where(F.col("b.score") > 0)
    return out.select(id_column, F.col("b.route").alias("route"), F.least(0.4 + 0.15 * F.col("b.score"), F.lit(0.75)).alias("confidence"))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark before a space; decimals don't end it."""
    return F.split(F.trim(text), r"(?<=[.!?])\s+")[0]


def _holds(word: Column):
    return lambda x: F.contains(F.lower(x), word)


def known_terms(text: Column, terms: list[str]) -> Column:
    """The terms in a text, longest first; a term inside a longer one found isn't repeated."""
    low = F.lower(text)
    out = F.array().cast("array<string>")
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        word = F.lit(t.lower())
        inside = F.exists(out, _holds(word))
        out = F.when(F.contains(low, word) & ~inside, F.concat(out, F.array(F.lit(t)))).otherwise(out)
    return out
