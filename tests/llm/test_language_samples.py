"""Samples and sizes of the language operator against a plain reading of their definition."""

from __future__ import annotations

import random

import zstandard
from pyspark.sql import functions as F

from salesprism.llm import languages as L


def test_samples_are_the_rows_with_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECES", 20)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(30)), "x" if i % 3 else "y") for i in range(900)]
    rows += [(5, "the same row over and over", "x")] * 400 + [(6, "few", "z"), (None, "null id", "z"), (7, None, "x"), (8, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(L.train_languages(docs, F.lit(True)))
    hashed = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id", "text", F.lit("languages")).alias("h")).distinct().collect()
    for lang in ("x", "y", "z"):
        own = sorted((r["h"], r["text"]) for r in hashed if r["lang"] == lang)[:20]
        pieces = [t.lower()[max(0, int(len(t) / 2 - L.PIECE / 2) - 1) if len(t) > L.PIECE else 0 :][: L.PIECE] for _, t in own]
        assert got[lang].decode() == L.letters_only("\n".join(reversed(pieces)))
    assert set(got) == {"x", "y", "z"} and list(dict(L.train_languages(docs, F.lit(True)))) == ["x", "y", "z"]


def test_sizes_are_those_of_chunks_encoded_one_by_one():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    dictionaries = [(x, " ".join(word(letters) for _ in range(2000)).encode()) for x, letters in (("a", "abcde"), ("b", "vwxyz"))]
    own = L.Identifier(dictionaries)
    for text in ["", "A", " ".join(word("abcde") for _ in range(3000)), " ".join(word("vwxyz") for _ in range(40)), "abc " * 9000]:
        data = L.letters_only(text).encode()
        plain = []
        for _, dictionary in dictionaries:
            total = 0
            for at in range(0, len(data), L.CHUNK):
                c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                total += len(c.compress(data[at : at + L.CHUNK]))
            plain.append(total)
        assert all(abs(a - b) <= 0.02 * b + 4 for a, b in zip(own.sizes(text), plain, strict=True))
        if sum(map(len, text.split())) > 50:
            assert own.identify(text)[0] == ("a" if plain[0] < plain[1] else "b")
