"""Recall of copies that use up all the edits they are allowed."""

from __future__ import annotations

import random

import pytest

from salesprism.llm import decontamination as D


@pytest.mark.parametrize("lengths", [(9, 10), (14, 15, 16), (18, 19, 20), (48, 50, 55)])
def test_copies_at_the_edit_limit_are_found_at_every_length(lengths):
    rng = random.Random(5)
    copies = 1500 // len(lengths)
    items = [(m * copies + n, [f"b{m}x{n}x{i}" for i in range(m)]) for m in lengths for n in range(copies)]
    matcher = D.Matcher([(i, " ".join(w)) for i, w in items])
    texts = []
    for _, words in items:
        w = list(words)
        for _ in range(D.edits_allowed(len(words))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [f"e{rng.randrange(10**9)}"] if kind != 2 else []
        texts.append(" ".join([f"f{rng.randrange(10**9)}" for _ in range(5)] + w + [f"f{rng.randrange(10**9)}" for _ in range(5)]))
    found = [any(x[0] == i for x in hits) for (i, _), hits in zip(items, matcher.search(texts), strict=True)]
    for m in lengths:
        own = [f for (_, w), f in zip(items, found, strict=True) if len(w) == m]
        assert sum(own) >= 0.96 * len(own), (m, sum(own) / len(own))
