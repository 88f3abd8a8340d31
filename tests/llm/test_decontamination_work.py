"""The search does no more than it needs, and its short cuts give what the plain way gives."""

from __future__ import annotations

import random
import sys

import numpy as np

from salesprism.llm import decontamination as D


def test_only_texts_with_enough_words_of_an_item_are_aligned(monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, [word() for _ in range(18)]) for i in range(60)]
    texts = [[word() for _ in range(200)] + items[n % 60][1] + [word() for _ in range(200)] for n in range(60)]
    aligned = []
    plain = D.best_match
    monkeypatch.setattr(D, "best_match", lambda pattern, text: aligned.append((pattern, text)) or plain(pattern, text))
    matcher = D.Matcher([(i, " ".join(w)) for i, w in items])
    # few words make all windows candidates, so that many pairs meet by chance
    hits = matcher.search([" ".join(t) for t in texts])
    assert all(any(x[:2] == (n % 60, 0) for x in own) for n, own in enumerate(hits))
    forward = [(p, t) for p, t in aligned if p in [w for _, w in items]]
    assert forward and all(sum(x in set(p) for x in t) >= len(p) - D.edits_allowed(len(p)) for p, t in forward)


def test_words_are_those_of_the_pattern():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert all((c.isalnum(), c.isspace()) in ((True, False), (False, False), (False, True)) for c in every)
    texts = ["", " ", "_a_B__c", "İstanbul ΟΔΟΣ, naïvé x\x1cy\x85z　q​w", "a" * 50]
    # a character at a time, then all of them at once: more than FEW_MARKS of them
    texts += ["aB".join(every[i : i + 40]) for i in range(0, len(every), 40)] + ["a".join(every[:70_000])]
    for t in texts:
        assert D.words_of(t) == D.WORD.findall(t.lower()), t[:80]


def test_keys_are_those_of_a_walk_word_by_word():
    rng = np.random.default_rng(4)
    for shortest, lengths, wide in [(1, [1], 1), (2, [2], 2), (9, [9, 10], 10), (9, [9], 4), (30, [30, 32, 34], 34)]:
        walks = D.Walks(shortest, 7)
        windows = rng.integers(0, 1 << 63, (50, wide), dtype=np.uint64)
        windows[::3, wide // 2 :] = D.PAD
        keys = walks.keys(windows, lengths)
        for m in lengths:
            for r in range(7):
                for w, row in enumerate(windows.tolist()):
                    at, key = 0, 0
                    for step in range(int(walks.sampled[r].max()) + 1):
                        symbol = row[at] if at < wide else int(D.PAD)
                        for _ in range(int((walks.sampled[r] == step).sum())):
                            key = (key ^ (symbol if at < m else int(D.PAD))) * 0x9FB21C651E98DF25 % 2**64
                            key ^= key >> 29
                        at += symbol * int(walks.factors[r, step]) % 2**64 >> 63
                    assert keys[m][r, w] == key


def test_windows_at_the_end_of_a_text_read_nothing_of_the_next(monkeypatch):
    monkeypatch.setattr(D, "SLICE_ROWS", 3)
    monkeypatch.setattr(D, "WINDOWS", 5)
    words = [f"v{i}" for i in range(20)]
    matcher = D.Matcher([(0, " ".join(words))])
    halves = [" ".join(words[:10]), " ".join(words[10:])]
    whole = f"New {' '.join(words)} end"
    hits = matcher.search([*halves, "", whole, *halves, whole, "", " ".join(words[:16])])
    assert [[x[:2] + x[3:] for x in own] for own in hits] == [[], [], [], [(0, 0, 1, 21)], [], [], [(0, 0, 1, 21)], [], [(0, 4, 0, 16)]]
