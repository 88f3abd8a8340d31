"""A file to a story: load, detect, gate, build, analyse, alert; a held file gives its issues and their alerts only.

`python -m salesprism.plans.engine FILE` prints the report of a file.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from salesprism.operators import monitoring as M
from salesprism.operators import quality as Q
from salesprism.plans.answers import explain
from salesprism.plans.detection import Detection, detect
from salesprism.plans.digest import as_text, assemble_alerts, digest
from salesprism.plans.findings import Finding, collect_findings
from salesprism.plans.sales import build_sales
from salesprism.sources.catalog import Catalog
from salesprism.sources.loading import load

SNAPSHOT = "rows long, median_value double, products long, first_date date, last_date date"


@dataclass
class Analysis:
    detection: Detection
    issues: list[tuple[str, str]]
    findings: list[Finding] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    alerts: list[dict] = field(default_factory=list)
    snapshot: DataFrame | None = None

    @property
    def held(self) -> bool:
        return Q.holds(self.issues)


def analyse(tidy: DataFrame, overrides: dict[str, str] | None = None, previous: DataFrame | None = None, goals: DataFrame | None = None, as_of: dt.date | None = None, sent: DataFrame | None = None) -> Analysis:
    """The gate judges every row of the file before any of them is dropped; sent: keys of alerts that went out already."""
    found = detect(tidy, overrides)
    if found.missing:
        raise ValueError(f"no column for {', '.join(found.missing)}")
    spark, day = tidy.sparkSession, as_of or dt.date.today()
    out = Analysis(found, Q.issues(tidy, day, previous, found.roles))
    if not out.held:
        # the snapshot is one row
        out.snapshot = spark.createDataFrame(Q.snapshot(Q.raw_view(tidy, found.roles), Q.DATE, Q.PRODUCT, Q.VALUE).collect(), SNAPSHOT)
        sales = build_sales(tidy, found.roles | {f"group_by_{i}": c for i, c in enumerate(found.dimensions)}, found.cost_basis).persist()
        try:
            out.findings, out.errors = collect_findings(sales, goals)
        finally:
            sales.unpersist()
    out.alerts = assemble_alerts(spark, out.issues, out.findings, day.strftime("%Y-%m"), out.held, sent)
    return out


def analyse_file(spark: SparkSession, path: str, **options) -> Analysis:
    return analyse(load(spark, path)[0], **options)


def refresh(spark: SparkSession, catalog: Catalog, dataset_id: str, path: str, as_of: dt.date | None = None) -> Analysis:
    """A data set's file analysed against what the catalogue knows of it; mapping, story, snapshot and new alerts are written back.

    A held file leaves the last story and snapshot as they are.
    """
    tidy = load(spark, path)[0]
    mark = detect(tidy).fingerprint
    mapping = catalog.get("mappings", mark)
    overrides = json.loads(mapping["roles"]) if mapping else None
    before = catalog.read("snapshots").where(f"fingerprint = '{mark}'").drop("fingerprint")
    goals = catalog.read("goals").where(f"dataset_id = '{dataset_id}'").drop("dataset_id")
    sent = catalog.read("alerts").where(f"dataset_id = '{dataset_id}'")
    out = analyse(tidy, overrides, None if before.isEmpty() else before, None if goals.isEmpty() else goals, as_of, sent)
    if not out.held:
        found = json.dumps([asdict(f) | {"strength": f.strength, "score": f.score} for f in out.findings], default=str)
        catalog.put("stories", spark.createDataFrame([(dataset_id, found)], "dataset_id string, findings string"))
        catalog.put("snapshots", out.snapshot.selectExpr(f"'{mark}' AS fingerprint", "*"))
        catalog.put("mappings", spark.createDataFrame([(mark, json.dumps({c: r for r, c in out.detection.roles.items()}))], "fingerprint string, roles string"))
    if out.alerts:
        rows = [(a["key"], dataset_id, a["kind"], a["level"], a["subject"], a["period"], False) for a in out.alerts]
        catalog.put_new("alerts", spark.createDataFrame(rows, "key string, dataset_id string, kind string, level string, subject string, period string, acknowledged boolean"))
    return out


def add_goal(spark: SparkSession, catalog: Catalog, goal_id: str, dataset_id: str, metric: str, target: float, start: dt.date, end: dt.date) -> list[str]:
    """Why the goal isn't taken; nothing if it was."""
    wrong = M.check_goal(metric, target, start, end)
    if not wrong:
        catalog.put("goals", spark.createDataFrame([(goal_id, dataset_id, metric, float(target), start, end)], "id string, dataset_id string, metric string, target double, start date, end date"))
    return wrong


def tick(spark: SparkSession, catalog: Catalog, analysed: Callable[[Analysis], None] = lambda a: None, as_of: dt.date | None = None) -> dict[str, str]:
    """Every data set of the catalogue analysed once: its id and `done`, `held` or why it failed. For a scheduler to call."""
    out = {}
    for r in catalog.read("datasets").orderBy("dataset_id").collect():
        try:
            result = refresh(spark, catalog, r["dataset_id"], r["path"], as_of)
            analysed(result)
            out[r["dataset_id"]] = "held" if result.held else "done"
        except Exception as e:  # one file that can't be read mustn't keep the others from their turn
            out[r["dataset_id"]] = str(e)[:200]
    return out


def health(spark: SparkSession, catalog: Catalog) -> dict[str, object]:
    """Whether Spark computes and the catalogue can be read, and how long that takes."""
    began = time.monotonic()
    return {"spark": spark.range(1).count() == 1, "datasets": catalog.read("datasets").count(), "seconds": round(time.monotonic() - began, 3)}


def report(a: Analysis) -> str:
    """The analysis as text: roles, issues, alerts and findings with their strength and meaning."""
    lines = ["Columns"] + [f"  {role}: {column} ({a.detection.scores.get(role, 0):.2f})" for role, column in sorted(a.detection.roles.items())]
    lines += [f"  ? {p}" for p in a.detection.prompts]
    lines += ["Quality"] + ([f"  {severity} {code}" for code, severity in a.issues] or ["  nothing found"])
    if a.held:
        return "\n".join([*lines, "The file is held; the last story stands."])
    lines += ["Digest", as_text(digest(a.findings, [x for x in a.alerts if x["kind"] != "QUALITY"])), "Findings"]
    for f in a.findings:
        lines += [f"  [{f.severity}, {f.strength}] {f.summary}", f"      {explain(f)}"]
    return "\n".join([*lines, *[f"  failed: {k}: {v}" for k, v in a.errors.items()]])


def main(paths: list[str]) -> int:
    from salesprism.session import session

    spark, held = session(), False
    for path in paths:
        found = analyse_file(spark, path)
        held |= found.held
        print(report(found))
    return int(held)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
