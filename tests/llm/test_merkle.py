"""Manifest and proofs against a plain recursive tree: sizes around powers, many trees, nulls, ties, arities and heights."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from salesprism.llm.merkle import Partial, build_manifest, folded, level_sizes, paths_of



def forgery():
    return {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row
    n = None if n is None else n + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes, arity):
    """(root, siblings of each node level by level)"""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            first = a // arity * arity
            siblings[k].append((a - first, [d for j, d in enumerate(nodes[first : first + arity], first) if j != a]))
            at[k] = a // arity
        nodes = [h("".join(nodes[j : j + arity])) for j in range(0, len(nodes), arity)]
    return nodes[0], siblings


def brute(rows, forged, arity=2):
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {name: climb([leaf(r) for r in trees[name]], arity) for name in names}
    root, tops = climb([own[name][0] for name in names], arity)
    out = []
    for name, top in zip(names, tops, strict=True):
        for r, siblings in zip(trees[name], own[name][1], strict=True):
            path = siblings + top
            fold = folded(leaf(r, 1) if forged(r[0]) else leaf(r), path)
            out.append((r[0], leaf(r), own[name][0], root, h("".join(d for _, o in path for d in o)), fold, fold == root))
    return sorted(out, key=repr)


def found(spark, rows, condition, **options):
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string, index int")
    return sorted((tuple(r) for r in build_manifest(table, condition, forgery(), **options).collect()), key=repr)


def rows_of(n, langs, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["é" * rng.randint(0, 5), "a\nb", "", None]), rng.choice(langs), rng.choice(["s", "", None]), rng.choice([None, 0, 9, 99, 2**63 - 1])) for i in rng.sample(range(-n, 2 * n), n)]


@pytest.mark.parametrize(("n", "langs", "options"), [(1, ["a"], {}), (2, [None], {}), (37, ["a", "Z", "é", None, ""], {"height": 1}), (150, ["a", "a", "a", "b"], {"height": 2}), (90, ["a", "b"], {"arity": 3, "height": 2}), (40, [str(k) for k in range(40)], {"height": 2})])
def test_equals_brute_force(spark, n, langs, options):
    rows = rows_of(n, langs, n)
    rows += [rows[0], (None, "t", langs[0], None, 3), (rows[0][0], "other text", rows[0][2], None, 3)] if n > 2 else []
    got = found(spark, rows, F.coalesce(F.col("doc_id"), F.lit(1)) % 2 == 0, **options)
    assert got == brute(rows, lambda i: i is not None and i % 2 == 0, options.get("arity", 2))


def test_forging_shows_and_nulls_stay(spark):
    rows = [(i, "t", "a", "s", None if i % 2 else 4) for i in range(20)]
    for r in found(spark, rows, F.lit(True)):
        assert r[6] == bool(r[0] % 2)


def test_empty_table(spark):
    assert found(spark, [], F.lit(True)) == []


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("size", [1, 2, 3, 26, 27, 28, 100])
def test_partial_parents_resolve_in_any_order_and_merge(arity, size):
    rng = random.Random(size)
    digests = [h(str(k)) for k in range(size)]
    parts = [Partial(size, 0, 20, arity) for _ in range(4)]
    order = rng.sample(range(size), size)
    for k in order:
        p = rng.choice(parts)
        p.arrives(0, k, digests[k], arity)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.joins(p, arity)
    top = len(level_sizes(size, arity)) - 1
    assert not whole.waiting and whole.nodes[top, 0] == climb(digests, arity)[0]
    levels = [[whole.nodes[at, k] for k in range(n)] for at, n in enumerate(level_sizes(size, arity))]
    assert [folded(d, p) for d, p in zip(digests, paths_of(levels, arity), strict=True)] == [levels[-1][0]] * size
