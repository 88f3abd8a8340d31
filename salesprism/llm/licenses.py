"""License scan: phrases by position, notices by an exact set-similarity join of text blocks with templates.

A template of n words is compared with every block of 2n words that starts at a multiple of n, so a notice lies
whole in at least one block. A block matches when it holds at least `threshold` of the template's distinct words.
The join is exact. Texts are read once, into the places of the words that any template has. Template words are
ordered by their frequency in all documents, rarest first, and the words of each template's prefix meet the documents'
words in a join (prefix filter); a pair of block and template goes on if the block has enough template words at all
(length filter) and if what follows the first shared word suffices (positional filter); what is left is counted.
Templates are constants of this module (a few hundred words), so their prefixes travel to the documents.

Only DataFrame functions are used. Defined results: a null text is empty; a text without words has zero counts,
null positions, empty labels and score 0; rows are independent, so repeated rows repeat their result; other columns
of the input are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import small, text_or_empty, written

# Phrases and public license notices, with the labels they stand for.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8
#: Template words of a document that are compared with the templates at once.
SLICE = 256


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def needed(words: list[str], threshold: float) -> int:
    """The least number of a template's distinct words that meets the threshold."""
    return math.ceil(round(threshold * len(set(words)), 9))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else kept. lower() is faster and differs in ASCII letters only for two characters."""
    return F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _places(phrase: str) -> Column:
    parts, words = phrase.split(), F.col("words")
    last = F.size(words) - len(parts)

    def stands(i):
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out &= F.get(words, i + k) == p
        return out

    return F.when(F.array_contains(words, parts[-1]) & (last >= 0), F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def matching_blocks(found: DataFrame, templates: list[list[str]], wanted: list[str], threshold: float) -> DataFrame:
    """(uid, template, share): the best share of each template that some block of a document holds, if it meets the threshold.

    found: uid and hits, an array of (at, word), the place in the text and the number in `wanted` of each template word.
    """
    spark = found.sparkSession
    # as many rows as the templates have words
    seen = dict.fromkeys(range(len(wanted)), 0) | {r["word"]: r["n"] for r in found.select(F.explode("hits.word").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(seen, key=lambda w: (seen[w], wanted[w])))}
    number, rows = {w: i for i, w in enumerate(wanted)}, []
    for i, words in enumerate(templates):
        own = sorted({number[w] for w in words}, key=rank.get)
        least = needed(words, threshold)
        rows += [(w, i, len(words), own, least) for w in own[: len(own) - least + 1]]
    prefixes = spark.createDataFrame(rows, "word int, template int, n_words int, own array<int>, least int")
    # slices of a document's hits: a block around one of the SLICE in the middle has no more hits on either side than words
    span = 2 * max(map(len, templates))
    slices = F.transform(F.sequence(F.lit(0), F.expr(f"(size(hits) - 1) div {SLICE}")), lambda i: F.struct(F.slice("hits", F.greatest(F.lit(1), i * SLICE - span + 1), F.lit(SLICE + 2 * span)).alias("hits"), F.slice("hits", i * SLICE + 1, F.lit(SLICE)).alias("own")))
    sliced = found.where(F.size("hits") > 0).select("uid", F.explode(slices).alias("part")).select("uid", "part.hits", F.explode("part.own").alias("hit"))
    pairs = sliced.select("uid", "hits", "hit.at", "hit.word").join(F.broadcast(prefixes), "word")
    # a place lies in the blocks that start at the multiple of n before it and at the one before that
    start = F.expr("at - at % n_words")
    pairs = pairs.select("uid", "template", "n_words", "own", "least", "hits", F.explode(F.array_distinct(F.array(start, F.greatest(F.lit(0), start - F.col("n_words"))))).alias("start"))
    inside = F.filter("hits", lambda h: (h["at"] >= F.col("start")) & (h["at"] < F.col("start") + 2 * F.col("n_words")))
    pairs = pairs.withColumn("block", F.array_distinct(F.transform(inside, lambda h: h["word"]))).where(F.size("block") >= F.col("least"))
    # places in the template's order: what comes after the first shared one must suffice
    first = F.array_min(F.transform("block", lambda w: F.nullif(F.array_position("own", w), F.lit(0))))
    pairs = pairs.withColumn("first", first).where(F.size("own") - F.col("first") + 1 >= F.col("least"))
    shared = F.size(F.array_intersect("block", "own"))
    pairs = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("least"))
    return pairs.groupBy("uid", "template").agg(F.max(F.col("shared") / F.size("own")).alias("share"))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: word count, phrase places, labels of phrases and of phrases and notices, score."""
    templates = [template_words(t) for _, t in TEMPLATES]
    wanted = sorted({w for t in templates for w in t})
    words = docs.select(F.col(id_column).alias("id"), words_of(text_or_empty(text_column)).alias("words"))
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(wanted), i)))
    found = words.select("id", "words", places.alias("places"), *[_places(p).alias(f"at_{label}") for label, p in PHRASES.items()])
    hits = F.transform("places", lambda i: F.struct(i.alias("at"), F.array_position(_literals(wanted), F.get("words", i)).cast("int").alias("word")))
    hits = F.transform(hits, lambda h: F.struct(h["at"].alias("at"), (h["word"] - 1).alias("word")))
    found = written(found.select(F.monotonically_increasing_id().alias("uid"), "id", F.size("words").cast("long").alias("n_words"), *[f"at_{x}" for x in PHRASES], hits.alias("hits")), "license-words")
    shares = matching_blocks(found, templates, wanted, threshold).groupBy("uid").agg(F.max("share").alias("best"), F.collect_set("template").alias("noticed"))
    labels = _literals([label for label, _ in TEMPLATES])
    # few documents hold a notice
    found = found.drop("hits").join(small(written(shares, "license-notices")), "uid", "left")
    places = F.concat(*[F.col(f"at_{x}") for x in PHRASES])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in sorted(PHRASES)]))
    noticed = F.transform(F.coalesce("noticed", F.array().cast("array<int>")), lambda t: F.get(labels, t))
    return found.select(
        F.col("id").alias(id_column),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, noticed)), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_sql(threshold: float = THRESHOLD) -> str:
    """The same result by comparing every block with every template."""
    lists = ", ".join(f"list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))}) AS at_{label}" for label, phrase in PHRASES.items())
    shares = []
    for i, (_, text) in enumerate(TEMPLATES):
        words = template_words(text)
        distinct, n = sorted(set(words)), len(words)
        tokens = "[" + ", ".join(f"'{x}'" for x in distinct) + "]"
        shares.append(f"coalesce(list_max(list_transform(range(0, greatest(len(w), 1), {n}), lambda s: CASE WHEN len(list_intersect(w[s + 1:s + {2 * n}], {tokens})) >= {needed(words, threshold)} THEN len(list_intersect(w[s + 1:s + {2 * n}], {tokens})) / {len(distinct)}.0 ELSE 0.0 END)), 0.0)::DOUBLE AS share_{i}")
    labels = ", ".join([f"CASE WHEN len(at_{x}) > 0 THEN '{x}' END" for x in PHRASES] + [f"CASE WHEN share_{i} > 0 THEN '{label}' END" for i, (label, _) in enumerate(TEMPLATES)])
    base = ", ".join(f"CASE WHEN len(at_{x}) > 0 THEN '{x}' END" for x in PHRASES)
    join = lambda items: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ','), '')"
    places = " || ".join(f"at_{x}" for x in PHRASES)
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
found AS (SELECT doc_id, len(w)::BIGINT AS n_words, {lists}, {", ".join(shares)} FROM words)
SELECT doc_id, n_words, len({places})::BIGINT AS n_base, list_min({places})::BIGINT AS first_word, list_max({places})::BIGINT AS last_word,
       {join(base)} AS base_labels, {join(labels)} AS labels,
       CASE WHEN len({places}) > 0 THEN 1.0 ELSE greatest({", ".join(f"share_{i}" for i in range(len(TEMPLATES)))}) END::DOUBLE AS score
FROM found"""
