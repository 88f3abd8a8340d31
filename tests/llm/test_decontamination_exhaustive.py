"""The search against all windows of all documents, items without ids of their own, items too long for repetitions."""

from __future__ import annotations

import random

from salesprism.llm import decontamination as D


def least_edits(pattern, text):
    """Fewest word edits between pattern and any stretch of text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_pairs_equal_an_exhaustive_search(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    items = [(i, [word() for _ in range(rng.choice([4, 9, 10, 16, 25, 40]))]) for i in range(40)]
    texts = []
    for _ in range(120):
        own = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            _, w = rng.choice(items)
            w = list(w)
            for _ in range(rng.randint(0, D.edits_allowed(len(w)) + 2)):
                at = rng.randrange(max(1, len(w)))
                w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            own += w
        texts.append(own + [word() for _ in range(rng.randint(0, 40))])
    expected = {(d, i): k for d, t in enumerate(texts) for i, w in items if (k := least_edits(w, t)) <= D.edits_allowed(len(w))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.find_contamination(docs, bench).collect()}
    assert len(expected) > 50 and found.keys() <= expected.keys() and all(found[x] >= expected[x] for x in found)
    assert len(found) >= 0.97 * len(expected) and sum(found[x] == expected[x] for x in found) >= 0.97 * len(found)
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in found}


def test_items_that_share_an_id_or_have_none_keep_their_pairs(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(1, f"x {a} y {b} z"), (1, f"x {a} y {b} z"), (None, b), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (None, b), (7, a), (7, b), (7, b), (8, None)], "code long, words string")
    out = D.find_contamination(docs, bench, item_id="code", item_text="words").collect()
    rows = sorted(((r["doc_id"], r["code"], r["item_words"]) for r in out), key=str)
    both = [(1, None, 7), (1, None, 8), (1, 7, 7), (1, 7, 7), (1, 7, 8)]
    assert rows == sorted([*both, *both, (None, None, 7), (None, 7, 7), (None, 7, 7)], key=str)
    text = spark.createDataFrame([("", a), ("k", b), (None, a)], "item_id string, text string")
    assert D.find_contamination(docs.limit(1), text).count() == 3


def test_very_long_items_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, [word() for _ in range(1000 + 40 * i)]) for i in range(6)]
    assert D.class_repetitions([1000]) is None
    texts = []
    for _, w in items * 3:
        w = list(w)
        for _ in range(D.edits_allowed(len(w))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [word()] if kind != 2 else []
        texts.append(" ".join([word() for _ in range(200)] + w + [word() for _ in range(200)]))
    hits = D.Matcher([(i, " ".join(w)) for i, w in items]).search([*texts, " ".join(word() for _ in range(3000))])
    assert all([x[0] for x in own] == [n % 6] for n, own in enumerate(hits[:-1])) and not hits[-1]
    # short items by pieces alone: the same as by windows and dynamic programming
    monkeypatch.setattr(D, "class_repetitions", lambda *a, **b: None)
    short = [(i, [word() for _ in range(rng.choice([1, 4, 5, 9, 14, 23]))]) for i in range(30)]
    docs = [[word() for _ in range(30)] + w[: len(w) - rng.randint(0, 2)] + [word() for _ in range(30)] for _, w in short]
    found = D.Matcher([(i, " ".join(w)) for i, w in short]).search([" ".join(d) for d in docs])
    expected = [{(i, k) for i, w in short if (k := least_edits(w, d)) <= D.edits_allowed(len(w))} for d in docs]
    assert [{(x[0], x[1]) for x in own} for own in found] == expected


def test_simulations_run_as_tasks_and_long_items_need_none(spark, monkeypatch):
    classes = D.length_classes({1, 3, 5, 9, 10, 24, 25, 60, 64, 1000, 1100, 10_000})
    expected = [D.class_repetitions(own) for own in classes]
    assert D.simulated_repetitions(spark, classes) == expected
    assert [t is None for t in expected] == [own[-1] > D.LONGEST_WALK for own in classes]
    assert D.simulated_repetitions(spark, []) == []
    # beyond the bound nothing is simulated, on the driver or elsewhere
    monkeypatch.setattr(D, "repetitions_for", lambda *a, **b: 1 / 0)
    assert D.class_repetitions([10_000]) is None and D.simulated_repetitions(spark, [[1000, 1100], [10_000]]) == [None, None]
    # one number of edits that takes too many settles the class
    asked = []
    monkeypatch.setattr(D, "repetitions_for", lambda m, k, *a, **b: asked.append(k))
    assert D.class_repetitions(list(range(100, 115))) is None and asked == [22]
