"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard dictionary of raw text, put together from a bounded sample: PIECES documents a language,
those with the smallest hashes of id and text, PIECE characters from the middle of each. Counts say below which hash
about SPARE times as many rows of a language lie; only those are ranked, repeated rows as one. A text is cut into chunks of CHUNK bytes, all of
them are encoded with every dictionary, and the smallest sum names the language. The margin is the share by which the
runner-up is larger; predictions with a narrow margin are marked as rejected but keep their value.

Defined results: a null text and a text without letters are `und` with score 0, as is everything if no language could
be learned; equal sizes go to the language with more documents, then to the smaller name; repeated rows repeat their
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import map_slices

PIECES, PIECE, SPARE = 400, 320, 4
CHUNK = 4096
LEVEL = 3
NARROW = 0.01
#: The margin from which on a prediction counts as certain.
CERTAIN = 0.1
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Words in lower case with single spaces: marks, digits and case say little about the language."""
    return OTHER.sub(" ", text.lower())


def train_languages(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), more frequent languages first."""
    rows = docs.where(usable & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.lower(text_column).alias("text"), F.xxhash64(F.col(id_column), F.col(text_column), F.lit("languages")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    start = F.greatest(F.lit(1), (F.length("text") / 2 - PIECE / 2).cast("int"))
    chosen, open_langs, spare = [], set(counts), SPARE
    while open_langs:
        # hashes are spread evenly over all 64-bit numbers
        below = {x: min((spare * PIECES << 64) // counts[x], (1 << 64) - 1) - (1 << 63) for x in open_langs}
        limit = F.element_at(F.create_map(*[v for x, most in below.items() for v in (F.lit(x), F.lit(most))]), F.col("lang"))
        few = rows.where(F.col("lang").isin(sorted(open_langs)) & (F.col("h") <= limit)).select("lang", "h", F.substring("text", start, F.lit(PIECE)).alias("piece")).distinct()
        ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("r") <= PIECES).collect()
        found = {x: [r for r in ranked if r["lang"] == x] for x in open_langs}
        done = {x for x in open_langs if len(found[x]) == PIECES or spare * PIECES >= counts[x]}
        chosen += [r for x in done for r in found[x]]
        open_langs, spare = open_langs - done, spare * 16
    texts: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: -r["r"]):
        texts.setdefault(r["lang"], []).append(r["piece"])
    return [(x, letters_only("\n".join(texts[x])).encode()) for x in sorted(texts, key=lambda x: (-counts[x], x))]


class Identifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [x for x, _ in dictionaries]
        self.compressors = []
        for _, data in dictionaries:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters_only(text).encode()
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if text is None or not self.names or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / second
        return self.names[best], min(1.0, margin / CERTAIN), margin


def identify_languages(docs: DataFrame, dictionaries: list[tuple[str, bytes]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: lang_pred, score, margin and rejected."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # PIECES * PIECE characters a language
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    cache: dict = {}

    def identify(rows):
        if "own" not in cache:
            cache["own"] = Identifier(sent.value)
        found = [cache["own"].identify(t) for t in rows["text"]]
        return {"id": rows["id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "margin": [x[2] for x in found], "rejected": [x[2] < NARROW for x in found]}

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean"
    return map_slices(narrow, identify, schema).withColumnRenamed("id", id_column)
