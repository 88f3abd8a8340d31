"""What leaves the engine: alerts, the digest as text and HTML, charts and key figures, answers and their guards."""

from __future__ import annotations

import hashlib
import html
import json
import re

from pyspark.sql import DataFrame, SparkSession

from salesprism.operators import monitoring as M
from salesprism.plans.findings import Finding, compact

MOST_LINES, MOST_ALERTS, MOST_BARS, MOST_SLICES, MOST_FIGURES, LONGEST_TEXT = 3, 4, 7, 8, 6, 60


def finding_alerts(found: list[Finding], period: str) -> list[dict]:
    """Urgent findings that didn't fail their test, and anomalies under the period they fell in."""
    out = []
    for f in found:
        p = f.adjusted_p if f.adjusted_p is not None else f.p_value
        odd = f.type.startswith("ANOMALY_")
        if (f.severity == "URGENT" and f.type != "GOAL_PACE" or odd) and (p is None or p < 0.05):
            at = f.facts["period"] if odd else period
            out.append({"kind": f.type, "level": "high" if f.severity == "URGENT" else "low", "subject": f.id, "period": at, "text": re.split(r"(?<=[.!?])\s+", f.summary)[0], "key": alert_key(f.type, f.id, at)})
    return out


def assemble_alerts(spark: SparkSession, issues: list[tuple[str, str]], found: list[Finding], period: str, held: bool, sent: DataFrame | None = None, cap: int = 6) -> list[dict]:
    """The alerts of a run that weren't sent: of a held file those of its quality alone, else urgent findings, anomalies and goals out of reach too."""
    rows = [("QUALITY", level, code, period, code.replace("_", " ")) for code, level in M.quality_alerts(issues)]
    if not held:
        rows += [(a["kind"], a["level"], a["subject"], a["period"], a["text"]) for a in finding_alerts(found, period)]
        rows += [(f.type, "high", f.id, f.facts["end"], f.summary) for f in found if f.type == "GOAL_PACE" and f.facts.get("needs_alert")]
    alerts = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], M.ALERT)
    sent = sent.select("key") if sent is not None else spark.createDataFrame([], "key string")
    return [r.asDict() for r in M.fresh_alerts(alerts, sent, cap).collect()]


def alert_key(kind: str, subject: str, period: str) -> str:
    return hashlib.sha256("|".join((kind, subject, period)).encode()).hexdigest()[:16]


def digest(found: list[Finding], alerts: list[dict]) -> dict:
    """Three lines that matter, goals last, one good one; findings an alert restates are left out."""
    told = {a["subject"] for a in alerts}
    lines = [f for f in found if f.severity in ("URGENT", "WATCH") and f.type not in ("RANKING", "NOISE") and f.id not in told]
    lines = sorted(lines, key=lambda f: (f.type == "GOAL_PACE", -f.score, f.id))[:MOST_LINES]
    good = next((f for f in found if f.severity == "GOOD"), None)
    return {"alerts": alerts[:MOST_ALERTS], "lines": [f.summary for f in lines], "good": good.summary if good else None}


def as_text(d: dict) -> str:
    return "\n".join([*[f"! {a['text']}" for a in d["alerts"]], *[f"- {x}" for x in d["lines"]], *([f"+ {d['good']}"] if d["good"] else [])]) or "Nothing stands out."


def as_html(d: dict) -> str:
    item = lambda cls, text: f'<li class="{cls}">{html.escape(text)}</li>'
    rows = [item("alert", a["text"]) for a in d["alerts"]] + [item("line", x) for x in d["lines"]] + ([item("good", d["good"])] if d["good"] else [])
    return f"<ul>{''.join(rows) or item('line', 'Nothing stands out.')}</ul>"


def with_rest(labels: list[str], values: list[float], most: int) -> tuple[list[str], list[float]]:
    """The largest slices in order, and one for all others, so that a pie stays whole; what is 0 or below has no slice."""
    order = sorted(((v, k) for k, v in zip(labels, values, strict=True) if v and v > 0), key=lambda x: (-x[0], x[1]))
    if len(order) <= most:
        return [k for _, k in order], [v for v, _ in order]
    kept, others = order[: most - 1], order[most - 1 :]
    return [*(k for _, k in kept), f"{len(others)} others"], [*(v for v, _ in kept), sum(v for v, _ in others)]


def figure_text(name: str, value) -> str:
    """A fact as a reader wants it: shares and changes as per cent, amounts in short, days and names as they are."""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float) and any(part in ("pct", "share", "rate", "retention") for part in name.split("_")):
        return f"{value:.0%}"
    return compact(value) if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)[:LONGEST_TEXT]


def key_figures(f: Finding) -> list[tuple[str, str]]:
    """The first figures of a finding with their names; what is a list or unknown is no figure."""
    single = [(k, v) for k, v in f.facts.items() if v is not None and not isinstance(v, (list, tuple, dict))]
    return [(k.replace("_", " ").capitalize(), figure_text(k, v)) for k, v in single[:MOST_FIGURES]]


def chart_series(f: Finding) -> dict:
    """Labels and values of a finding's chart: contributions by size, rankings, classes, curves; else its key figures as text."""
    if "contributions" in f.facts:
        rows = sorted((c for c in f.facts["contributions"] if c["change"]), key=lambda c: -abs(c["change"]))[: MOST_BARS + 1]
        return {"kind": "bar", "labels": [c["label"] for c in rows], "values": [c["change"] for c in rows]}
    for key, kind in (("ranking", "bar"), ("curve", "line"), ("pairs", "bar"), ("stopped", "bar"), ("arrived", "bar")):
        if key in f.facts:
            rows = f.facts[key] if kind == "line" else f.facts[key][: MOST_BARS + 1]
            return {"kind": kind, "labels": [str(r[0]) for r in rows], "values": [next((x for x in r[1:] if isinstance(x, (int, float))), None) for r in rows]}
    if "segments" in f.facts:
        labels, values = with_rest([str(k) for k in f.facts["segments"]], list(f.facts["segments"].values()), MOST_SLICES)
        return {"kind": "pie", "labels": labels, "values": values}
    if "monthly_index" in f.facts:
        return {"kind": "line", "labels": [str(k) for k in f.facts["monthly_index"]], "values": list(f.facts["monthly_index"].values())}
    figures = key_figures(f)
    return {"kind": "table", "labels": [k for k, _ in figures], "values": [v for _, v in figures]}


def export_json(found: list[Finding]) -> str:
    return json.dumps([{"id": f.id, "type": f.type, "chart": f.chart, "summary": f.summary, "severity": f.severity, "strength": f.strength, "series": chart_series(f)} for f in found], default=str, indent=1)


def export_html(found: list[Finding]) -> str:
    parts = []
    for f in found:
        s = chart_series(f)
        rows = "".join(f"<tr><td>{html.escape(str(a))}</td><td>{html.escape(str(b))}</td></tr>" for a, b in zip(s["labels"], s["values"], strict=True))
        parts.append(f"<section><h2>{html.escape(f.summary)}</h2><p>{f.severity}, {f.strength}</p><table>{rows}</table></section>")
    return f"<!doctype html><html><body>{''.join(parts)}</body></html>"
