"""Rates against a bisection, copies against their rounding, ties, and plans too large to travel."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from salesprism.llm import components as CC
from salesprism.llm import mixing as M


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 3) for i, t, s in rows], "doc_id long, text string, source string, copies string, size int")


def slope(sizes, target, most):
    low, high = -50.0, 50.0
    for _ in range(200):
        a = (low + high) / 2
        total = sum(n * min(most, math.exp(min(50.0, a * n))) for n in sizes)
        low, high = (a, high) if total < target else (low, a)
    return (low + high) / 2


def test_rates_and_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(None if i % 9 == 0 else i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 40, 41])), rng.choice("aab") if i % 7 else None) for i in range(900)]
    rows += [(5000, "same same same", "a")] * 300 + [(5001, "", "a")] * 20
    got = M.mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r["mix_source"]].append(r)
    for own in by_source.values():
        target, sizes = own[0]["target"], [r["size"] for r in own if r["size"]]
        full = target >= 2 * sum(sizes) - 1e-9
        a = None if full else slope(sizes, target, 2)
        cells = Counter(sizes)
        for r in own:
            rate = 0.0 if not r["size"] else 2.0 if full else min(2.0, math.exp(min(50.0, a * r["size"])))
            assert math.isclose(r["rate"], rate, rel_tol=1e-5), (r, rate)
            assert r["taken"] == r["copies"] * r["size"] and (r["copies"] <= 2)
        # cumulated rates along falling sizes, shifted and cut
        best = None
        for k in range(M.SHIFTS):
            until, plan = 0.0, {}
            for n in sorted(cells, reverse=True):
                before, until = until, until + cells[n] * (2.0 if full else min(2.0, math.exp(min(50.0, a * n))))
                plan[n] = math.floor(until + (k + 0.5) / M.SHIFTS) - math.floor(before + (k + 0.5) / M.SHIFTS)
            error = abs(sum(n * c for n, c in plan.items()) - target)
            best = min(best or (error + 1,), (error, k)) if best is None or error < best[0] else best
        assert abs(sum(r["taken"] for r in own) - target) <= best[0] + 1e-6
        for n in cells:
            copies = [r["copies"] for r in own if r["size"] == n]
            assert max(copies) - min(copies) <= 1
    # what doesn't travel gives the same, but for which of equal rows gets one more
    monkeypatch.setattr(M, "BROADCAST_ROWS", -1)
    again = M.mix_sources(table(spark, rows).repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["mix_source"]), r["copies"], round(r["rate"], 9))
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_rows_that_the_mix_takes_keep_their_columns(spark):
    rows = [(i % 50, f"{'w ' * (i % 13)}", "s") for i in range(400)] + [(None, None, None)]
    t = table(spark, rows)
    out = M.take_mix(t)
    assert out.columns == [*t.columns, "mix_copies", "mix_size", "mix_taken"]
    got = [tuple(r) for r in out.collect()]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(r[-1] for r in got) - 1.5 * total) <= 24 and all(r[-3] in (1, 2) and r[-1] == r[-3] * r[-2] > 0 for r in got)
    assert M.take_mix(t.where("false")).count() == 0


def test_components_of_graphs_that_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(CC, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in CC.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in root}
