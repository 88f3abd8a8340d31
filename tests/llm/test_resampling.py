"""Resampling against a brute-force form: hot and rare features, n-grams, nulls, ties, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from salesprism.llm import resampling
from salesprism.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(words, grams):
    return [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, grams=1, buckets=10_000, least_words=20, per_cent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features_of(words_of(t), grams) for _, t in rows]
    s, t = Counter(bucket(f) for x in own for f in x), Counter(bucket(f) for x in target for f in features_of(words_of(x), grams))
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1.0) * (s.total() + buckets) / ((s[bucket(f)] + 1.0) * (t.total() + buckets))))
    out = []
    for (i, text), features in zip(rows, own, strict=True):
        weight = sum(map(gain, features)) // len(features) if features else 0
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(words_of(text))])
    enough = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(enough[: per_cent * len(enough) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(spark, rows, target, **options):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, feature string, gain int, rank int")
    aims = spark.createDataFrame([(t, "y") for t in target], "text string, item_id string")
    return sorted((tuple(r) for r in resample(table, aims, **options).collect()), key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Öl", "x1", "naïve", "日本"] + [f"w{k}" for k in range(300)]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\x00", "'", "\n"]) for w in rng.choices(vocabulary, [1 / (k + 1) for k in range(306)], k=n))
    rows = [(i, text(rng.choice([0, 5, 19, 20, 21, 80]))) for i in range(150)]
    rows += [(3, None), (None, text(30)), (None, text(30)), (8, rows[8][1]), (8, rows[8][1]), (200, text(60_000)), (201, "w" * 100_000)]
    return rows, [text(40) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"grams": 3, "buckets": 50}, {"per_cent": 100, "least_words": 0}])
def test_equals_brute_force(spark, options):
    rows, target = case(1)
    got = found(spark, rows, target, **options)
    assert got == brute(rows, target, **options)
    assert any(r[4] for r in got)


@pytest.mark.parametrize("hot", [0, 7])
def test_rare_features_are_joined(spark, monkeypatch, hot):
    monkeypatch.setattr(resampling, "HOT_FEATURES", hot)
    monkeypatch.setattr(resampling, "SLICE_BYTES", 500)
    rows, target = case(2)
    assert found(spark, rows, target) == brute(rows, target)


def test_hot_features_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HOT_BYTES", 40)
    rows, target = case(3)
    assert found(spark, rows, target) == brute(rows, target)


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    rows = [(1, "a b"), (2, None)]
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [(1, None)], ["a b"]) == brute([(1, None)], ["a b"])
