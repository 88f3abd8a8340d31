"""Line removal against a brute-force form: nulls, repeated ids and rows, ties, hot and rare keys, levels of runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from salesprism.llm import linededup
from salesprism.llm.linededup import Runs, drop_shared_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_length=40, least_documents=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, places string, h1 int, batch int")
    return sorted((tuple(r) for r in drop_shared_lines(table, **options).collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"{'Ä' if k % 3 else 'A'}{k} " + "x" * rng.randint(36, 60) for k in range(30)]
    rows = []
    for i in range(120):
        lines = [rng.choice([p, p.upper() if p[0] == "A" else p, f"\t{p}\r", p + "\x0b "]) for p in rng.choices(pool, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 6))]
        lines += [f"line {rng.random()} of one document only, long enough to count" for _ in range(rng.randint(0, 2))] + ["", "short"][: rng.randint(0, 2)]
        rng.shuffle(lines)
        rows.append((i if rng.random() < 0.95 else rng.choice([None, 7]), "\n".join(lines)))
    return [*rows, (3, None), (None, ""), *rows[:5], (500, "\n".join([pool[0]] * 3))]


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 5, "fan_out": 3}])
def test_equals_brute_force(spark, options):
    rows = rows_of(1)
    got = found(spark, rows, **options)
    assert got == brute(rows)
    assert any(r[2] > 0 for r in got) and any(r[0] is None for r in got)


def test_rare_keys_and_shuffled_places(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(linededup, "BROADCAST_PLACES", 0)
    rows = rows_of(2)
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_only_nulls(spark):
    assert found(spark, []) == []
    line = "the same line of forty characters or more in each"
    assert found(spark, [(None, line)] * 6) == brute([(None, line)] * 6)


def test_a_line_of_a_third_of_a_very_long_text(spark):
    line = "a line that stands in many documents of this table"
    rows = [(i, f"{line}\n{i}" if i % 3 == 0 else str(i)) for i in range(60)] + [(7, "\n".join([line, "y" * 50, "z"] * 20_000))]
    assert found(spark, rows) == brute(rows)


def test_runs_hold_each_key_once_as_first(spark):
    runs, seen, counts, last = Runs(spark, 4, 2), set(), {}, {}
    rng = random.Random(3)
    for batch in range(7):
        own = {(rng.randint(0, 40), 0): rng.randint(1, 9) for _ in range(15)}
        runs.add(spark.createDataFrame([(*k, n, 100 - batch) for k, n in own.items()], "h1 long, h2 long, n long, last long"))
        for k, n in own.items():
            counts[k] = counts.get(k, 0) + n
            last.setdefault(k, 100 - batch)
        seen |= set(own)
        firsts = [tuple(r) for t in runs.tables() for r in t.where("first").select("h1", "h2").collect()]
        assert len(firsts) == len(set(firsts)) and set(firsts) == seen
        assert all(len(level) < 2 for level in runs.levels)
    assert {(r["h1"], r["h2"]): (r["n"], r["last"]) for r in runs.merged().collect()} == {k: (n, last[k]) for k, n in counts.items()}
    runs.drop()
    assert not runs.tables()


def test_batches_and_merges_shuffle_no_run(spark):
    runs = Runs(spark, 4, 3)
    try:
        for _ in range(2):
            runs.add(spark.range(50).select("id", F.lit(0).cast("long").alias("h2"), F.lit(1).cast("long").alias("n"), "id").toDF("h1", "h2", "n", "last"))
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "FullOuter" in plan and "Exchange" not in plan
    finally:
        runs.drop()
