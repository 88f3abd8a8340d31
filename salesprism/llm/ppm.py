"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion.

The trie holds contexts of up to ORDER bytes with the symbols that followed them in the training texts; symbols are
bytes, 0xFF ends a text and 0xFE stands before it (neither occurs in UTF-8). A symbol is coded in its longest known
context: there it has count / (total + distinct); otherwise the coder escapes with distinct / (total + distinct) to the
next shorter context, from which the symbols of the longer one are excluded, and at last to a uniform order -1. The
probabilities of all texts sum to one; a document's code length is the sum over all of its bytes.

Counts of words and grams (a symbol with the three bytes before it) come from all documents, apart for those that train:
each task folds its texts, Spark adds up. The trie stays distributed: its levels are tables of grams and contexts, and
joins give the code length of every gram that any document has, coded or escaped. The two longest levels are dealt out
by key, where one context has 256 rows at most; the shorter ones have 65,536 rows at most and travel.

Documents are then read once more. The HOT_WORDS and HOT_GRAMS most frequent words and grams, numbers fixed in advance,
are looked up in place; only what is rarer is dealt out by word or gram and joined with its figure, so nothing with a
large share of all rows travels, and neither driver nor task holds the trie. Tasks take texts in slices of SLICE_BYTES and
the bytes of a slice, or of one very long text, in pieces of PIECE, so what they hold follows neither rows nor lengths.

Defined results: a null text is empty; an empty text has one token, its end; without training documents the base
probability is 1 and bytes are uniform; a null id counts as training; repeated rows repeat their result; other columns
of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesprism.llm.common import byte_slices, discard, most_frequent, text_or_empty, written

ORDER = 3
PAD, END = 0xFE, 0xFF
HOT_WORDS, HOT_GRAMS = 100_000, 2_000_000
HELD_WORDS, HELD_BYTES, HELD_GRAMS = 300_000, 4_000_000, 2_000_000
#: Bytes of texts and of their grams that a task turns into Python objects and arrays at once.
SLICE_BYTES, PIECE = 2_000_000, 1_000_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def token_pieces(text: str) -> Iterator[list[bytes]]:
    """Words in lower case A-Z, without the end, in lists of about PIECE bytes; none is cut."""
    data, start = text.encode("utf-8", "surrogatepass").lower(), 0
    while start < len(data):
        after = SPACE.search(data, start + PIECE)
        end = after.start() if after else len(data)
        yield data[start:end].split()
        start = end


def tokens(text: str) -> list[bytes]:
    """All of them."""
    return [w for own in token_pieces(text) for w in own]


def grams(data: np.ndarray) -> np.ndarray:
    """The symbol and the three before it as one number, for every place but the first three."""
    d = data.astype(np.uint32)
    return d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]


def gram_pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, index of the text of each) in pieces of at most PIECE grams; a piece begins with the three bytes before it."""
    parts = [b"\xfe\xfe\xfe" + t.encode("utf-8", "surrogatepass") + b"\xff" for t in texts]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    for start in range(0, len(data) - 3, PIECE):
        own = grams(data[start : start + PIECE + 3])
        real = np.flatnonzero((own & np.uint32(0xFF)) != PAD)
        yield own[real], np.searchsorted(ends, real + (start + 3), "right")


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n, trained) of docs (text, training): occurrences in all texts and in those that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("trained", pa.int64())])
        counts = {True: Counter(), False: Counter()}

        def flush():
            for training, own in counts.items():
                for a in range(0, len(items := list(own.items())), 50_000):
                    n = pa.array([n for _, n in items[a : a + 50_000]], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in items[a : a + 50_000]], pa.binary()), n, n if training else pa.array(np.zeros(len(n), np.int64))], schema=schema)
                own.clear()

        for rows in byte_slices(batches, "text", SLICE_BYTES):
            for t, training in zip(rows.column("text"), rows.column("training").to_pylist(), strict=True):
                for own in token_pieces(t.as_py()):
                    counts[training].update(own)
                    if sum(map(len, counts.values())) >= HELD_WORDS:
                        yield from flush()
        yield from flush()

    return docs.select("text", "training").mapInArrow(run, "word binary, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram long, n, trained) of docs (text, training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("trained", pa.int64())])
        # a key is a gram and whether its text trains
        keys, counts, waiting, held = np.empty(0, np.uint64), np.empty(0), [], 0

        def folded(keys, counts, waiting):
            own, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both))

        def batch(keys, counts):
            n = counts.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.array(n), pa.array(n * (keys & np.uint64(1)).astype(np.int64))], schema=schema)

        for rows in byte_slices(batches, "text", SLICE_BYTES):
            training = np.array(rows.column("training").to_pylist(), bool)
            for own, owner in gram_pieces(rows.column("text").to_pylist()):
                waiting.append(own.astype(np.uint64) << np.uint64(1) | training[owner])
                held += len(own)
                if held >= HELD_BYTES:
                    keys, counts = folded(keys, counts, waiting)
                    waiting, held = [], 0
                    if len(keys) >= HELD_GRAMS:
                        yield batch(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        yield batch(*folded(keys, counts, waiting))

    return docs.select("text", "training").mapInArrow(run, "gram long, n long, trained long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _low(column: str, length: int) -> Column:
    """The last `length` bytes of a gram or context."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def code_lengths(counted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(gram, n, log_p) and the tables it was made from: the log10 probability of the symbol after its three bytes, for every gram of the written counts.

    What a context of k bytes leaves of the next shorter one, the rest of its total and of its distinct symbols, belongs
    to the context; a gram that the longest context doesn't have goes down the levels with that.
    """
    # leaves and contexts of level k: k bytes of context, and the symbol
    level = counted.where("trained > 0").select(F.col("gram").alias("leaf"), F.col("trained").alias("count"))
    leaves, contexts = {ORDER: written(level, "ppm-leaves-3")}, {}
    for k in range(ORDER - 1, -1, -1):
        leaves[k] = written(leaves[k + 1].groupBy(_low("leaf", k + 1).alias("leaf")).agg(F.sum("count").alias("count")), f"ppm-leaves-{k}")
    for k in range(ORDER + 1):
        own = leaves[k].withColumn("context", F.shiftright("leaf", 8))
        if k:
            shorter = leaves[k - 1].select(F.col("leaf").alias("short_leaf"), F.col("count").alias("short_count"))
            own = own.join(F.broadcast(shorter) if k < ORDER else shorter, _low("leaf", k) == F.col("short_leaf"))
        else:
            own = own.withColumn("short_count", F.lit(0).cast("long"))
        t = own.groupBy("context").agg(F.sum("count").alias("total"), F.count("*").alias("distinct"), F.sum("short_count").alias("taken"))
        if k:
            parent = contexts[k - 1].select(F.col("context").alias("parent"), F.col("total").alias("parent_total"), F.col("distinct").alias("parent_distinct"))
            t = t.join(F.broadcast(parent), _low("context", k - 1) == F.col("parent"))
            t = t.select("context", "total", "distinct", (F.col("parent_total") - F.col("taken")).alias("rest"), (F.col("parent_distinct") - F.col("distinct")).alias("left"))
        else:
            t = t.select("context", "total", "distinct", F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("left"))
        contexts[k] = written(t, f"ppm-contexts-{k}")

    t = counted.select("gram", "n", "trained")
    for k in range(ORDER, -1, -1):
        own = contexts[k].withColumnsRenamed({"context": f"c{k}", "total": f"t{k}", "distinct": f"d{k}", "rest": f"r{k}", "left": f"l{k}"})
        t = t.join(F.broadcast(own) if k < ORDER else own, F.shiftright(_low("gram", k + 1), 8) == F.col(f"c{k}"), "left")
        if k < ORDER:
            found = leaves[k].select(F.col("leaf").alias(f"leaf{k}"), F.col("count").alias(f"n{k}"))
            t = t.join(F.broadcast(found) if k < ORDER - 1 else found, _low("gram", k + 1) == F.col(f"leaf{k}"), "left")
    t = t.withColumn(f"n{ORDER}", F.when(F.col("trained") > 0, F.col("trained")))
    log, seen, rest, left = F.lit(0.0), F.lit(False), F.lit(0), F.lit(0)
    closed = F.lit(False)
    for k in range(ORDER, -1, -1):
        known, count = F.col(f"c{k}").isNotNull(), F.col(f"n{k}")
        total = F.when(seen, rest + left).otherwise(F.col(f"t{k}") + F.col(f"d{k}"))
        novel = F.when(seen, left).otherwise(F.col(f"d{k}"))
        hit, escapes = known & count.isNotNull(), known & (novel > 0)
        part = F.when(closed, 0.0).when(hit, F.log10(count) - F.log10(total)).when(escapes, F.log10(novel) - F.log10(total)).otherwise(0.0)
        t = t.withColumns({f"part{k}": part, f"closed{k}": closed | hit})
        log, closed = log + F.col(f"part{k}"), F.col(f"closed{k}")
        seen, rest, left = known, F.coalesce(f"r{k}", F.lit(0)), F.coalesce(f"l{k}", F.lit(0))
    symbols = leaves[0].count()
    return written(t.select("gram", "n", F.when(closed, log).otherwise(log - math.log10(max(1, 256 - symbols))).alias("log_p")), "ppm-lengths"), [*leaves.values(), *contexts.values()]


SCORED = "uid long, id {id}, n_tokens long, n_known long, base double, score double, word binary, gram long, n long"


def score_documents(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: n_tokens, n_known, train_tokens, base_score and score; training: a condition on docs."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    words = written(count_words(narrow), "ppm-words")
    counted = written(count_grams(narrow), "ppm-grams")
    ends = narrow.where("training").count()
    total = words.agg(F.sum("trained").alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
    n_train, n_distinct = (total["n"] or 0) + ends, total["v"] + bool(ends)
    base_log = math.log10(n_train + n_distinct + 1)
    lengths, levels = code_lengths(counted)
    discard(counted, *levels)
    table = most_frequent(words, HOT_WORDS).select("word", "trained").toArrow()
    known_words = dict(zip(table["word"].to_pylist(), zip(np.log10(table["trained"].to_numpy() + 1.0).tolist(), (table["trained"].to_numpy() > 0).tolist(), strict=True), strict=True))
    table = most_frequent(lengths, HOT_GRAMS).select("gram", "log_p").toArrow()
    order = np.argsort(table["gram"].to_numpy())
    known_grams = (table["gram"].to_numpy()[order].astype(np.uint32), table["log_p"].to_numpy()[order])
    sent = spark.sparkContext.broadcast((known_words, *known_grams))
    del known_words, known_grams, table, order
    end_log, end_known = math.log10(ends + 1), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        hot, keys, logs_of = sent.value
        uid, get = TaskContext.get().partitionId() << 36, hot.get
        def batch(**columns):
            size = max(map(len, columns.values()))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

        for rows in byte_slices(batches, "text", SLICE_BYTES):
            texts, n = rows.column("text").to_pylist(), rows.num_rows
            scores = np.zeros(n)
            for own, owner in gram_pieces(texts):
                place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                here = keys[place] == own if len(keys) else np.zeros(len(own), bool)
                scores += np.bincount(owner[here], logs_of[place[here]], n)
                rare, times = np.unique(owner[~here].astype(np.uint64) << np.uint64(32) | own[~here], return_counts=True)
                yield batch(uid=(rare >> np.uint64(32)).astype(np.int64) + uid, gram=(rare & np.uint64(0xFFFFFFFF)).astype(np.int64), n=times)
            known, base, count, word_at, word, word_times = [], [], [], [], [], []
            for k, t in enumerate(texts):
                size, logs, seen = 1, end_log, end_known
                for own in token_pieces(t):
                    size, rest = size + len(own), []
                    for w in own:
                        v = get(w)
                        if v is None:
                            rest.append(w)
                        else:
                            logs += v[0]
                            seen += v[1]
                    for w, c in Counter(rest).items():
                        word_at.append(uid + k)
                        word.append(w)
                        word_times.append(c)
                    if len(word) >= HELD_WORDS:
                        yield batch(uid=word_at, word=word, n=word_times)
                        word_at, word, word_times = [], [], []
                known.append(seen)
                count.append(size)
                base.append(logs - size * base_log)
            yield batch(uid=word_at, word=word, n=word_times)
            yield batch(uid=range(uid, uid + n), id=rows.column("id").to_pylist(), n_tokens=count, n_known=known, base=base, score=scores)
            uid += n

    target = StructType.fromDDL(SCORED.format(id=narrow.schema["id"].dataType.simpleString()))
    scored = written(narrow.select("id", "text").mapInArrow(run, target), "ppm-scored")
    rare_words = scored.where("word is not null").select("uid", "word", F.col("n").alias("times"))
    other_words = words.where("trained > 0").select("word", "trained")
    word_sums = rare_words.join(other_words, "word").groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("trained") + 1)).alias("more_base"))
    rare_grams = scored.where("gram is not null").select("uid", "gram", F.col("n").alias("times"))
    gram_sums = rare_grams.join(lengths.select("gram", "log_p"), "gram").groupBy("uid").agg(F.sum(F.col("times") * F.col("log_p")).alias("more_score"))
    sums = word_sums.withColumn("more_score", F.lit(0.0)).unionByName(gram_sums.withColumns({"more_known": F.lit(0), "more_base": F.lit(0.0)}))
    sums = sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score")])
    out = scored.where("n_tokens is not null").select("uid", "id", "n_tokens", "n_known", "base", "score").join(sums, "uid", "left")
    return out.select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
