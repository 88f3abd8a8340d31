"""Importance resampling of documents towards a target distribution, with hashed n-gram features.

A feature is a run of 1 to `grams` consecutive words; every occurrence counts. Tasks count the features of each
document once, in a table with one row per document. From that table Spark counts every feature over all documents and
over the target; this dictionary has each distinct feature once, and only there is a feature hashed into its bucket.
Buckets add the dictionary up; a bucket's gain is floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) with s of S
features of the documents, t of T of the target and B buckets. Gains go back to the dictionary, and the dictionary to
the documents' feature counts. The weight of a document is the floored mean gain of its features; Gumbel noise from a
hash of its id is added, and of those with at least `least_words` words the `per_cent` per cent with the highest scores
are drawn, without replacement.

Bounds: the HOT_FEATURES most frequent features, by a bound on counts, travel to the documents (at most HOT_BYTES, else
fewer); a rarer feature is joined by its string, so no key with a large share of all rows is dealt out. Buckets have
`buckets` rows. Ranks come from range partitions of (score, id).

Defined results: a null text has no words; without features the weight is 0; a null id is hashed as an empty one and
comes after all others among equal scores; repeated rows are documents of their own and get ranks of their own; an empty target
leaves T = 0; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesprism.llm.common import byte_slices, discard, most_frequent, ranked, written

BUCKETS, GRAMS, LEAST_WORDS, PER_CENT, SEED = 10_000, 1, 20, 10, 2024
SLICE_BYTES = 4_000_000
HOT_FEATURES, HOT_BYTES = 100_000, 16_000_000
#: Words are runs of letters, digits and all that isn't ASCII; A-Z in lower case, all other bytes are blanks.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_counts(text: bytes, grams: int) -> tuple[int, Counter]:
    """(number of words, occurrences of each feature) of a text in UTF-8."""
    words = text.translate(TO_WORDS).split()
    counts = Counter(words)
    for n in range(2, grams + 1):
        counts.update(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return len(words), counts


def document_features(docs: DataFrame, grams: int) -> DataFrame:
    """docs (id, text) as (uid, id, n_words, n_features, features, counts), one row per row."""
    target = StructType.fromDDL(f"uid long, id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, features array<string>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for own in byte_slices(batches, "text", SLICE_BYTES):
            n_words, n_features, offsets, features, counts = [], [], [0], [], []
            for text in own.column("text").to_pylist():
                n, found = feature_counts(text or b"", grams)
                features += found.keys()
                counts += found.values()
                n_words.append(n)
                n_features.append(found.total())
                offsets.append(len(features))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(features, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(n_words)), pa.int64()), own.column("id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], names=target.names)
            uid += len(n_words)

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, target)


def _occurrences(features: DataFrame) -> DataFrame:
    """(uid, feature, times), one row per document and feature."""
    return features.select("uid", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("counts").alias("times"))))


def feature_dictionary(features: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, n, in_target, bucket): each distinct feature with its occurrences in documents and target, hashed once."""
    own = _occurrences(features).select("feature", F.col("times").alias("n"), F.lit(0).cast("long").alias("in_target"))
    other = _occurrences(target).select("feature", F.lit(0).cast("long").alias("n"), F.col("times").alias("in_target"))
    counted = own.unionByName(other).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("in_target").alias("in_target"))
    return written(counted.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets), "features-dictionary")


def bucket_gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that has a feature; the sums of the buckets are those of the dictionary."""
    sums = dictionary.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("in_target").alias("t"))
    whole = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c, more: (F.col(c) + more).cast("double")
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return sums.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _hot(dictionary: DataFrame) -> DataFrame:
    """The most frequent features, so many that their strings have HOT_BYTES together at most."""
    most = HOT_FEATURES
    while most:
        hot = most_frequent(dictionary, most)
        if (hot.agg(F.sum(F.octet_length("feature"))).first()[0] or 0) <= HOT_BYTES:
            return hot
        most //= 2
    return dictionary.where(F.lit(False))


def gain_sums(features: DataFrame, dictionary: DataFrame, gains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, total), the summed gains of each document that has features, and the scratch table that it reads."""
    gained = written(dictionary.where("n > 0").join(F.broadcast(gains), "bucket").select("feature", "n", "gain"), "features-gains")
    hot, rows = _hot(gained).select("feature", "gain"), _occurrences(features)
    total = F.sum(F.col("times") * F.col("gain")).alias("total")
    sums = rows.join(F.broadcast(hot), "feature").groupBy("uid").agg(total)
    if hot.count() < gained.count():
        # what is joined by string is rarer than the hot features
        rare = rows.join(F.broadcast(hot.select("feature")), "feature", "left_anti").join(gained.select("feature", "gain"), "feature")
        sums = sums.unionByName(rare.groupBy("uid").agg(total)).groupBy("uid").agg(F.sum("total").alias("total"))
    return sums, gained


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded down; b above 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """One row per input row: n_features, weight, score, and rank among the drawn, null for the others; target: rows with a text."""
    features = written(document_features(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), grams), "features-documents")
    aims = document_features(target.select(F.lit(0).alias("id"), F.col(text_column).alias("text")), grams)
    dictionary = feature_dictionary(features, aims, buckets)
    sums, gained = gain_sums(features, dictionary, bucket_gains(dictionary, buckets))
    weight = F.coalesce(floor_div(F.col("total"), F.col("n_features")), F.lit(0).cast("long"))
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(unit)))
    scored = features.select("uid", "id", "n_words", "n_features").join(sums, "uid", "left").withColumn("weight", weight)
    scored = written(scored.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "features-scored")
    discard(features, dictionary, gained)
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * per_cent // 100
    # equal in all that the result shows, or told apart
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed, _ = ranked(scored.where(enough), *order, number="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
