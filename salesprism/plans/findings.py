"""Findings: facts with guards turned into sentences with evidence, ranked into a story. Only small fact tables are collected."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.functions.stats import t_quantile
from salesprism.functions.text import DIRECTIVES
from salesprism.operators import customers as K
from salesprism.operators import descriptive as D
from salesprism.operators import inference as I
from salesprism.operators import monitoring as M
from salesprism.operators import periods as P
from salesprism.operators.pairs import item_vectors, pairs_tested
from salesprism.scratch import discard, written

# What a severity adds to importance; the chart of each type.
SEVERITY_WEIGHT = {"URGENT": 0.15, "WATCH": 0.08, "NEUTRAL": 0.0, "GOOD": 0.02}
CHARTS = {"TREND": "line", "NOISE": "line", "SEASONALITY": "seasonal", "TENSION": "scatter", "CONCENTRATION": "donut", "DECOMPOSITION": "waterfall", "RANKING": "bar", "ELASTICITY": "scatter", "LIFECYCLE": "bar", "DISTRIBUTION": "bar", "SEGMENTATION": "grouped_bar", "RELATIONSHIP": "matrix", "FORECAST": "band", "REPEAT_VS_NEW": "stacked", "CUSTOMER_SEGMENTS": "tiles", "COHORT_RETENTION": "heatmap", "BASKET": "bar", "GOAL_PACE": "gauge", "ANOMALY_DROP": "line", "ANOMALY_SPIKE": "line"}
SCHEMA = "id string, type string, chart string, summary string, facts string, severity string, importance double, tier string, method string, p_value double, adjusted_p double, sample_size long, strength string, confidence_low double, confidence_high double, score double, position long"


def story_score(importance: Column, severity: Column, doubtful: Column) -> Column:
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))]), severity), F.lit(0.0))
    return importance + weight - F.when(doubtful, 0.2).otherwise(0.0)


@dataclass
class Finding:
    id: str
    type: str
    summary: str
    severity: str
    importance: float
    facts: dict
    tier: str = "core"
    method: str = "arithmetic"
    p_value: float | None = None
    adjusted_p: float | None = None
    sample_size: int | None = None
    bounds: tuple[float | None, float | None] = field(default=(None, None))

    @property
    def chart(self) -> str:
        return "treemap" if self.type == "CONCENTRATION" and self.facts.get("item_count", 0) >= 6 else CHARTS[self.type]

    @property
    def strength(self) -> str:
        p = self.adjusted_p if self.adjusted_p is not None else self.p_value
        return "descriptive" if p is None else "strong" if p < 0.01 else "clear" if p < 0.05 else "worth a look" if p < 0.15 else "not distinguishable from chance"

    @property
    def score(self) -> float:
        p = self.adjusted_p if self.adjusted_p is not None else self.p_value
        return self.importance + SEVERITY_WEIGHT[self.severity] - (0.2 if p is not None and p >= 0.05 else 0.0)


def advice_in(text: str) -> list[str]:
    return [p for p in DIRECTIVES if re.search(p, text.lower())]


def move(change: float | None) -> str:
    return "didn't change" if not change else f"{'rose' if change > 0 else 'fell'} {abs(change):.0%}"


def compact(value: float) -> str:
    for size, unit in ((1e6, "m"), (1e3, "k")):
        if abs(value) >= size:
            return f"{value / size:.1f}".rstrip("0").rstrip(".") + unit
    return f"{value:.0f}"


def _rows(df: DataFrame) -> list:
    """All rows of a table of facts, no more than one an item."""
    return df.collect()


def _first(df: DataFrame, n: int, *order: Column | str) -> list:
    """The first n rows of df in that order, found by Spark over all of them."""
    return df.orderBy(*order).limit(n).collect()


@contextmanager
def _kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df, computed once for the several questions that are asked of it; each of them would else plan and run all its steps."""
    t = written(df, name)
    try:
        yield t
    finally:
        discard(t)


def trend_finding(s: DataFrame, frequency: str) -> list[Finding]:
    r = I.trend_test(s, frequency, deseasonalised=True).first()
    if not r or r["n"] < 6 or r["p"] is None:
        return []
    change, clear, material = r["fitted_change"], r["p"] < 0.05, abs(r["fitted_change"]) >= 0.1
    half = t_quantile(0.975, r["n"] - 2) * r["se"] if r["se"] else None
    own = {"facts": {"direction": "up" if change > 0 else "down", "change_pct": change, "periods": r["n"], "trend_per_period": r["slope"], "frequency": frequency, "material": material}, "method": "least squares on periods", "p_value": r["p"], "sample_size": r["n"], "bounds": (r["slope"] - half, r["slope"] + half) if half else (None, None)}
    if clear and material:
        return [Finding("revenue_trend", "TREND", f"Revenue {move(change)} over {r['n']} {frequency}s, more than chance explains.", "GOOD" if change > 0 else "URGENT", min(0.95, 0.6 + 0.6 * abs(change)), **own)]
    if not clear and r["p"] < 0.15 and material:
        return [Finding("revenue_trend", "NOISE", f"Revenue may have moved: it {move(change)}, which is not yet clear.", "WATCH", 0.45, **own)]
    return [Finding("revenue_trend", "NOISE", "Revenue shows no movement beyond its usual variation.", "NEUTRAL", 0.25 if clear else 0.3, **own)]


def seasonality_finding(s: DataFrame, _: str) -> list[Finding]:
    from salesprism.functions.seasonal import seasonal_parts

    months = P.by_period(P.whole_periods(s, P.MONTH), P.MONTH).withColumn("subject", F.lit("all"))
    r = seasonal_parts(months, 12).agg(F.first("strength").alias("strength"), F.count("*").alias("n")).first()
    if r["n"] < 24 or r["strength"] is None or r["strength"] < 0.35:
        return []
    index = sorted(_rows(D.month_index(s)), key=lambda x: x["lift"])
    low, high = index[0], index[-1]
    facts = {"strength": r["strength"], "peak_month": high["month"], "peak_lift": high["lift"], "trough_month": low["month"], "trough_dip": low["lift"], "monthly_index": {x["month"]: x["lift"] for x in index}}
    return [Finding("seasonality", "SEASONALITY", f"Month {high['month']} runs {high['lift']:.0%} above the average month, month {low['month']} {abs(low['lift']):.0%} below.", "NEUTRAL", 0.5, facts, method="STL", sample_size=r["n"])]


def margin_findings(s: DataFrame, _: str) -> list[Finding]:
    row = F.struct("product", "revenue", "profit", "margin", "profit_rank")
    worst = F.min_by(row, F.struct(F.col("margin").isNull(), "margin", "product"))
    r = D.margin_by_product(s).where("profit is not null").agg(F.count("*").alias("items"), P.money("revenue").alias("total"), F.min_by(row, "revenue_rank").alias("top"), F.min_by(row, "profit_rank").alias("earner"), worst.alias("worst")).first()
    if r["items"] < 2:
        return []
    items, total, top, earner, worst = r
    out = []
    if top["product"] != earner["product"]:
        out.append(Finding("margin_reality", "TENSION", f"{top['product']} sells most, {earner['product']} earns most.", "WATCH", 0.85, {"top_seller": top["product"], "top_earner": earner["product"], "profit_rank_of_top_seller": top["profit_rank"], "item_count": items}, "margin"))
    if worst["margin"] is not None and worst["margin"] < 0:
        out.append(Finding("loss_making_product", "TENSION", f"{worst['product']} loses money on each sale taken together.", "URGENT", 0.9, {"product": worst["product"], "margin": worst["margin"], "revenue_share": worst["revenue"] / total, "profit": worst["profit"], "item_count": items}, "margin"))
    return out


def concentration_finding(s: DataFrame, _: str) -> list[Finding]:
    measure = "profit" if not s.where("profit is not null").isEmpty() else "revenue"
    r = D.concentration(s, measure=measure).first()
    if r["item_count"] < 2 or r["top1_share"] < 0.35 and r["top2_share"] < 0.6:
        return []
    return [Finding("concentration", "CONCENTRATION", f"{r['leader']} brings {r['top1_share']:.0%} of {measure}, the first two {r['top2_share']:.0%}.", "WATCH", 0.88 if r["top1_share"] >= 0.5 else 0.75, {"metric": measure, **r.asDict()}, "margin" if measure == "profit" else "core")]


#: Contributions that a finding lists by name; the others are one entry.
NAMED_CONTRIBUTIONS = 7


def decomposition_finding(s: DataFrame, frequency: str) -> list[Finding]:
    """The change by item: the items that moved most, and one entry for all others, which makes the sum exact."""
    with _kept(D.decomposition(s, frequency=frequency), "parts") as parts:
        return _decomposed(parts)


def _decomposed(parts: DataFrame) -> list[Finding]:
    whole = parts.agg(F.count("*").alias("items"), F.sum("before").alias("base"), F.sum("change").alias("change"), F.max_by(F.struct("product", "change"), "change").alias("up"), F.min_by(F.struct("product", "change"), "change").alias("down")).first()
    base, change = whole["base"], whole["change"]
    if not base or abs(change) < 0.03 * abs(base):
        return []
    mover = whole["up"] if change > 0 else whole["down"]
    named = [{"label": r["product"], "change": r["change"], "share_of_change": r["share_of_change"]} for r in _first(parts, NAMED_CONTRIBUTIONS, F.abs("change").desc(), "product")]
    if whole["items"] > len(named):
        left = change - sum(c["change"] for c in named)
        named.append({"label": f"{whole['items'] - len(named)} others", "change": left, "share_of_change": left / change})
    facts = {"total_change": change, "change_pct": change / abs(base), "baseline": base, "largest_mover": mover["product"], "largest_mover_change": mover["change"], "item_count": whole["items"], "contributions": named}
    return [Finding("revenue_decomposition", "DECOMPOSITION", f"Revenue per period {move(change / abs(base))}; {mover['product']} moved most.", "GOOD" if change > 0 else "WATCH", 0.8, facts, method="exact contributions")]


def dimension_findings(s: DataFrame, frequency: str) -> list[Finding]:
    dims, out = [d for d in s.columns if d in ("channel", "region", "category", "payment_method") or d.startswith("group_")], []
    if not dims:
        return out
    rows = _rows(D.dimension_decomposition(s, dims, frequency).where("usable"))
    for d in dims:
        own = [r for r in rows if r["dimension"] == d]
        base, change = sum(r["before"] for r in own), sum(r["change"] for r in own)
        if not own or not base or abs(change) < 0.05 * abs(base):
            continue
        driver = max(own, key=lambda r: r["share_of_change"] or 0)
        if (driver["share_of_change"] or 0) < 0.6:
            continue
        facts = {"dimension": d, "driver": driver["level"], "driver_share_of_change": driver["share_of_change"], "total_change": change, "steady_levels": [r["level"] for r in own if r["is_steady"] and r["level"] != driver["level"]], "item_count": len(own)}
        out.append(Finding(f"decomposition_{d}", "DECOMPOSITION", f"{driver['level']} carries {driver['share_of_change']:.0%} of the change.", "GOOD" if change > 0 else "URGENT", 0.82, facts, "segment", "exact contributions"))
    return out


def price_volume_finding(s: DataFrame, frequency: str) -> list[Finding]:
    r = D.price_volume_split(s, frequency).first()
    if not r or r["price_before"] is None or r["price_after"] is None:
        return []
    base = r["quantity_before"] * r["price_before"]
    if not base or abs(r["total_change"]) < 0.03 * abs(base):
        return []
    v, p = abs(round(r["volume_effect"] / base, 2)), abs(round(r["price_effect"] / base, 2))
    main = "balanced" if v == p else "volume" if v > p else "price"
    return [Finding("price_volume_split", "DECOMPOSITION", {"balanced": "Units and price moved revenue alike.", "volume": "The change came from units sold, not from price.", "price": "The change came from price, not from units sold."}[main], "GOOD" if r["total_change"] > 0 else "WATCH", 0.72, {**r.asDict(), "dominant": main}, method="exact contributions")]


def ranking_finding(s: DataFrame, _: str) -> list[Finding]:
    with _kept(D.product_ranking(s), "ranking") as ranking:
        rows, whole = _first(ranking, 20, "rank"), ranking.agg(F.count("*").alias("items"), P.money("value").alias("total")).first()
    if whole["items"] < 2 or (whole["total"] or 0) <= 0:
        return []
    return [Finding("product_ranking", "RANKING", f"{rows[0]['product']} leads with {rows[0]['share']:.0%} of revenue.", "NEUTRAL", 0.2, {"leader": rows[0]["product"], "leader_revenue": rows[0]["value"], "item_count": whole["items"], "ranking": [[r["product"], r["value"], r["share"]] for r in rows]})]


def classes_finding(s: DataFrame, _: str) -> list[Finding]:
    share_of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("share"))), F.lit(0.0))
    r = D.pareto_classes(s).agg(F.count("*").alias("products"), F.count_if("is_vital").alias("vital_count"), share_of("is_vital").alias("vital_share"), F.count_if("is_tail").alias("tail_count"), share_of("is_tail").alias("tail_share")).first()
    if r["products"] < 4:
        return []
    few = r["vital_count"] / r["products"] <= 0.25
    return [Finding("concentration_classes", "CONCENTRATION", f"{r['vital_count']} of {r['products']} products bring four fifths of revenue.", "WATCH" if few else "NEUTRAL", 0.62 if few else 0.4, {**r.asDict(), "item_count": r["products"]})]


def price_findings(s: DataFrame, frequency: str) -> list[Finding]:
    rows = _first(I.elasticity_tests(s, frequency=frequency).where("responds"), 2, F.abs("slope").desc(), "product")
    return [Finding(f"price_response_{r['product']}", "ELASTICITY", f"A 1% higher price went with {abs(r['slope']):.1f}% {'fewer' if r['slope'] < 0 else 'more'} units of {r['product']}.", "WATCH" if r["slope"] <= -1 else "NEUTRAL", 0.72 if r["slope"] <= -1 else 0.55, {"product": r["product"], "elasticity": r["slope"], "price_variation": r["price_variation"], "periods": r["n"], "revenue_follows_price": r["slope"] > -1}, method="log-log slope", p_value=r["p"], adjusted_p=r["adjusted"], sample_size=r["n"]) for r in rows]


def lifecycle_findings(s: DataFrame, frequency: str) -> list[Finding]:
    with _kept(D.lifecycle(s, frequency=frequency), "statuses") as statuses:
        return _moved(statuses)


def _moved(statuses: DataFrame) -> list[Finding]:
    out = []
    if len(statuses.select("product").limit(2).collect()) < 2:
        return []
    counts = {r["status"]: r["n"] for r in _rows(statuses.where("status <> 'trading'").groupBy("status").agg(F.count("*").alias("n")))}
    for status, kind, severity, weight in (("stopped", "products_stopped", "WATCH", 0.68), ("arrived", "products_arrived", "GOOD", 0.45)):
        if n := counts.get(status):
            own = _first(statuses.where(F.col("status") == status), 10, (F.col("earlier_value") + F.col("recent_value")).desc(), "product")
            out.append(Finding(kind, "LIFECYCLE", f"{n} products {'no longer sell' if status == 'stopped' else 'are new'}: {', '.join(r['product'] for r in own[:3])}.", severity, weight, {"count": n, status: [[r["product"], r["earlier_value"], r["recent_value"], str(r["last_seen"])] for r in own]}))
    return out


def spread_finding(s: DataFrame, _: str) -> list[Finding]:
    unit = "order" if "order_id" in s.columns else "sale"
    sizes = D.order_values(s) if unit == "order" else s.where("revenue > 0").select(F.col("revenue").alias("value"))
    with _kept(sizes.select("value"), "sizes") as values:
        r = D.order_spread(values).first()
    if not r or r["orders"] < 20 or r["mean_to_median"] < 1.25 and r["top_decile_share"] < 0.35:
        return []
    return [Finding("order_spread", "DISTRIBUTION", f"The largest tenth of {unit}s brings {r['top_decile_share']:.0%} of revenue; the middle {unit} is {compact(r['median'])}.", "NEUTRAL", 0.5, {"unit": unit, **r.asDict()})]


def segmentation_findings(s: DataFrame, _: str) -> list[Finding]:
    dims = [d for d in s.columns if d in ("channel", "region", "category", "payment_method") or d.startswith("group_")]
    out = []
    for r in _rows(I.segmentation_tests(s, dims)) if dims else []:
        if r["p"] is None or r["adjusted"] >= 0.15 or r["adjusted"] < 0.05 and r["confounded"]:
            continue
        sure = r["adjusted"] < 0.05
        out.append(Finding(f"segmentation_{r['dimension']}", "SEGMENTATION", f"Sales differ by {r['dimension']}: {r['effect']:.0%} between highest and lowest mean.", "WATCH" if sure else "NEUTRAL", 0.7 if sure else 0.4, {"dimension": r["dimension"], "levels": r["levels"], "gap_pct": r["effect"], "confirmed": sure}, "segment", "analysis of variance", r["p"], r["adjusted"], r["rows"]))
    return out


def relationship_finding(s: DataFrame, frequency: str) -> list[Finding]:
    tests = I.correlation_tests(s, frequency=frequency, bound=0.05)
    own = _first(tests.where("related"), 10, F.abs("r").desc(), "a", "b")
    if not own:
        return []
    b = own[0]
    return [Finding("product_relationships", "RELATIONSHIP", f"{b['a']} and {b['b']} move {'together' if b['r'] > 0 else 'against each other'}.", "NEUTRAL", 0.55, {"pairs": [[r["a"], r["b"], r["r"], r["adjusted"]] for r in own], "pairs_tested": pairs_tested(item_vectors(s, frequency=frequency))}, method="Pearson correlation", p_value=b["p"], adjusted_p=b["adjusted"], sample_size=b["n"])]


def forecast_findings(s: DataFrame, frequency: str) -> list[Finding]:
    """The business on revenue from 0 up, and material products on profit without a floor where it is known: a profit that goes below 0 is urgent."""
    from salesprism.functions.arima import forecasts

    whole = P.whole_periods(s, frequency)
    ranked = [r["product"] for r in _rows(D.product_ranking(s).where("share >= 0.05 and rank <= 6"))]
    measure = "profit" if not s.where("profit is not null").isEmpty() else "revenue"
    total = P.by_period(whole, frequency).withColumn("subject", F.lit(""))
    cells = P.by_period_and(whole.where(F.col("product").isin(ranked)), "product", frequency, measure).withColumnRenamed("product", "subject")
    revenue = forecasts(total if measure == "profit" else total.unionByName(cells), floor=0.0, frequency=frequency)
    ahead = revenue if measure == "revenue" else revenue.unionByName(forecasts(cells, frequency=frequency))
    steps: dict[str, list] = {}
    for r in sorted(_rows(ahead.where("trusted")), key=lambda r: (r["subject"], r["step"])):
        steps.setdefault(r["subject"], []).append(r)
    out = []
    for subject, own in steps.items():
        r, means = own[-1], [x["mean"] for x in own]
        crossing = next((i for i, m in enumerate(means, 1) if m < 0), None) if subject and measure == "profit" and r["last_actual"] >= 0 else None
        if subject and crossing is None and r["direction"] == "flat":
            continue
        metric = measure if subject else "revenue"
        facts = {"metric": metric, "direction": r["direction"], "projected": r["mean"], "low80": r["lower80"], "high80": r["upper80"], "low95": r["lower95"], "high95": r["upper95"], "model": r["model"], "backtest_error": r["backtest_error"], "horizon_periods": len(own), "frequency": frequency, "last_actual": r["last_actual"]}
        facts["change_pct"] = (r["mean"] - r["last_actual"]) / abs(r["last_actual"]) if r["last_actual"] else None
        if subject:
            facts |= {"product": subject, "crosses_break_even": crossing is not None, "crosses_in_periods": crossing}
        if crossing:
            low, high = own[crossing - 1]["lower80"], own[crossing - 1]["upper80"]
            text = f"At its current trend {subject} falls below break-even in about {crossing} {frequency}{'s' if crossing > 1 else ''}; the range still runs from {compact(low)} to {compact(high)}."
            severity, weight = "URGENT", 0.86
        else:
            text = f"{f'{subject} ({metric})' if subject else 'Revenue'} is heading {r['direction']}: about {compact(r['mean'])} in {len(own)} {frequency}s."
            severity, weight = {"down": "WATCH", "up": "GOOD", "flat": "NEUTRAL"}[r["direction"]], 0.6 if subject else 0.4 if r["direction"] == "flat" else 0.68
        out.append(Finding(f"forecast_{subject}" if subject else "revenue_forecast", "FORECAST", text, severity, weight, facts, "margin" if metric == "profit" else "core", method="ARIMA chosen by AICc", sample_size=r["n"], bounds=(r["lower80"], r["upper80"])))
    return out


#: Customers below which nothing is said about them, or about their cohorts.
LEAST_CUSTOMERS, LEAST_IN_COHORTS = 10, 30


def _customers(s: DataFrame) -> int:
    return s.select("customer_id").where("customer_id is not null").distinct().count()


def repeat_finding(s: DataFrame, frequency: str) -> list[Finding]:
    if _customers(s) < LEAST_CUSTOMERS:
        return []
    rows = {r["side"]: r for r in _rows(K.repeat_vs_new(s, frequency))}
    if len(rows) < 2 or any(r["change_pct"] is None for r in rows.values()) or abs(rows["new"]["change_pct"] - rows["repeat"]["change_pct"]) < 0.15:
        return []
    driver = max(rows.values(), key=lambda r: abs(r["after"] - r["before"]))
    return [Finding("repeat_vs_new", "REPEAT_VS_NEW", f"Revenue from new customers {move(rows['new']['change_pct'])}, from returning ones it {move(rows['repeat']['change_pct'])}.", "WATCH" if driver["after"] < driver["before"] else "NEUTRAL", 0.74, {"driver": driver["side"], "new_change_pct": rows["new"]["change_pct"], "repeat_change_pct": rows["repeat"]["change_pct"]}, "customer")]


def rfm_finding(s: DataFrame, _: str) -> list[Finding]:
    with _kept(K.rfm(s), "rfm") as customers:
        rows, sample = {r["segment"]: r for r in _rows(K.segments_of(customers))}, _rows(K.sample_of(customers))
    n = sum(r["customers"] for r in rows.values())
    if n < 20:
        return []
    risk = rows["at_risk"]["customers"] if "at_risk" in rows else 0
    lead = risk >= max(3, 0.05 * n)
    return [Finding("rfm_segments", "CUSTOMER_SEGMENTS", f"{risk} of {n} customers used to buy often and have gone quiet." if lead else f"{n} customers fall into {len(rows)} groups.", "WATCH" if lead else "NEUTRAL", 0.8 if lead else 0.6, {"total_customers": n, "at_risk": risk, "segments": {k: r["customers"] for k, r in rows.items()}, "sample": [[r["recency"], r["frequency"], r["monetary"], r["segment"]] for r in sample]}, "customer")]


def cohort_finding(s: DataFrame, _: str) -> list[Finding]:
    if _customers(s) < LEAST_IN_COHORTS:
        return []
    curve = sorted(_rows(K.retention_curve(s)), key=lambda r: r["age"])
    if len(curve) < 2 or K.cohort_sizes(s).where("size >= 8").count() < 3:
        return []
    return [Finding("cohort_retention", "COHORT_RETENTION", f"{curve[0]['rate']:.0%} of new customers return in the month after their first purchase.", "NEUTRAL", 0.62, {"month_one_retention": curve[0]["rate"], "curve": [[r["age"], r["rate"]] for r in curve], "furthest_age": curve[-1]["age"], "furthest_retention": curve[-1]["rate"]}, "customer")]


def basket_finding(s: DataFrame, _: str) -> list[Finding]:
    with _kept(I.basket_tests(s), "baskets") as tests:
        whole = tests.agg(F.count("*").alias("pairs"), F.max("n_baskets").alias("baskets")).first()
        if not whole["pairs"] or whole["baskets"] < 30:
            return []
        own = _first(tests.where("confirmed"), 8, F.col("lift").desc(), "a", "b")
    return [Finding("basket_analysis", "BASKET", f"{own[0]['a']} and {own[0]['b']} are bought together {own[0]['lift']:.1f} times as often as chance would have it.", "NEUTRAL", 0.58, {"pairs": [[r["a"], r["b"], r["together"], r["lift"], r["support"], r["adjusted"]] for r in own], "pairs_tested": whole["pairs"], "baskets": whole["baskets"]}, method="Fisher's exact test", p_value=own[0]["p"], adjusted_p=own[0]["adjusted"])] if own else []


def anomaly_findings(s: DataFrame, frequency: str) -> list[Finding]:
    out = []
    for r in _rows(M.sales_anomalies(s, frequency)):
        drop, change = r["kind"] == "ANOMALY_DROP", r["value"] / r["median"] - 1
        facts = {"subject": r["subject"] or "all", "period": str(r["period"]), "value": r["value"], "usual": r["median"], "change_pct": change, "robust_z": r["z"], "run": r["run"]}
        out.append(Finding(f"anomaly_{r['subject']}" if r["subject"] else "revenue_anomaly", r["kind"], f"{r['subject'] or 'Revenue'} was {abs(change):.0%} {'below' if change < 0 else 'above'} its usual {frequency} in the {frequency} of {r['period']}.", "URGENT" if drop else "GOOD", 0.6 if r["subject"] else 0.75, facts, method="robust z", p_value=r["p"], adjusted_p=r["adjusted"] if r["subject"] else None))
    return out


#: Analyses side by side: each plans on the driver, where the stages of the last minute keep their threads.
AT_ONCE = 2
CUSTOMER = {repeat_finding, rfm_finding, cohort_finding}
#: What compares one part of the time with another says nothing below so many whole periods.
LEAST_PERIODS = dict.fromkeys((decomposition_finding, dimension_findings, price_volume_finding, lifecycle_findings, repeat_finding), 4)
ANALYSES = (trend_finding, anomaly_findings, seasonality_finding, margin_findings, concentration_finding, decomposition_finding, dimension_findings, price_volume_finding, ranking_finding, classes_finding, price_findings, lifecycle_findings, spread_finding, segmentation_findings, relationship_finding, forecast_findings, repeat_finding, rfm_finding, cohort_finding, basket_finding)


def goal_findings(s: DataFrame, goals: DataFrame, frequency: str = P.MONTH) -> list[Finding]:
    """One finding a goal: where it stands, where it lands with its band, and which products fell while it is short."""
    out = []
    for r in _rows(M.goal_projection(s, goals, frequency)):
        facts = {k: str(v) if k in ("start", "end", "as_of") else v for k, v in r.asDict().items()} | {"gap": None, "gap_drivers": []}
        if r["projected"] is not None and r["projected"] < r["target"]:
            facts["gap"] = r["target"] - r["projected"]
            fell = _rows(M.goal_gap_drivers(s, r["start"], r["end"], measure=r["metric"]))
            facts["gap_drivers"] = [[x["product"], x["change"]] for x in fell]
        share = f"{r['projected'] / r['target']:.0%}" if r["projected"] is not None and r["target"] else ""
        if r["state"] == "not_started":
            severity, weight, text = "NEUTRAL", 0.2, f"The goal {r['id']} begins after the last sale ({r['as_of']}); nothing is measured yet."
        elif r["projected"] is None or r["state"] == "in_progress" and r["projected"] <= 0:
            severity, weight, text = "NEUTRAL", 0.3, f"The goal {r['id']} stands at {r['reached_share']:.0%} with {r['elapsed']:.0%} of its time gone, too little to say where it lands."
        elif r["state"] == "finished":
            severity, weight, text = "GOOD" if r["on_track"] else "WATCH", 0.7, f"The goal {r['id']} finished at {share} of its target."
        elif r["on_track"]:
            severity, weight, text = "GOOD", 0.72, f"The goal {r['id']} is on course: at this pace it lands at {share} of its target."
        elif r["could_still_hit"]:
            severity, weight, text = "WATCH", 0.8, f"The goal {r['id']} is behind: at this pace it lands at {share} of its target, which the range still reaches."
        else:
            severity, weight, text = "URGENT", 0.86, f"The goal {r['id']} is out of reach at this pace: it lands at {share} of its target."
        if facts["gap"] and facts["gap_drivers"]:
            text += f" {facts['gap_drivers'][0][0]} fell most."
        out.append(Finding(f"goal_{r['id']}", "GOAL_PACE", text, severity, weight, facts, "margin" if r["metric"] == "profit" else "core", f"pace against target by {r['method']}", bounds=(r["projected_low"], r["projected_high"])))
    return out


def collect_findings(s: DataFrame, goals: DataFrame | None = None, strict: bool = False) -> tuple[list[Finding], dict[str, str]]:
    """(findings ranked, errors by analysis); the table is kept while the analyses read it."""
    s = s.persist()
    try:
        first, last = P.bounds(s)
        if first is None:
            return [], {}
        frequency, found, errors = P.natural_frequency(first, last), [], {}
        periods = P.whole_periods(s, frequency).select(P.period_of(frequency)).distinct().count()
        usable = [a for a in ANALYSES if (a not in CUSTOMER or "customer_id" in s.columns) and periods >= LEAST_PERIODS.get(a, 0)]
        # each analysis waits for small jobs of its own; the scheduler shares executors among them
        with ThreadPoolExecutor(AT_ONCE) as pool:
            results = [(a, pool.submit(a, s, frequency)) for a in usable]
        for analysis, result in results:
            if e := result.exception():
                if strict:
                    raise e
                errors[analysis.__name__] = str(e)[:500]
            else:
                found += result.result()
        found += goal_findings(s, goals, frequency) if goals is not None else []
        errors |= {f.id: "reads as advice" for f in found if advice_in(f.summary)}
        return sorted((f for f in found if not advice_in(f.summary)), key=lambda f: (-f.score, f.id)), errors
    finally:
        s.unpersist()


def story(s: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    found, _ = collect_findings(s, goals, strict=True)
    plain = lambda x: None if x is None else float(x)
    rows = [(f.id, f.type, f.chart, f.summary, json.dumps(f.facts, default=str, sort_keys=True), f.severity, float(f.importance), f.tier, f.method, plain(f.p_value), plain(f.adjusted_p), f.sample_size, f.strength, plain(f.bounds[0]), plain(f.bounds[1]), float(f.score), i) for i, f in enumerate(found, 1)]
    return s.sparkSession.createDataFrame(rows, SCHEMA)



