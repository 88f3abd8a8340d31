"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys of `least_length` characters or
more are hashed to 128 bits. Documents come in batches, largest ids first, as new crawls would come one after another.
A run is a table of keys, dealt into buckets by hash and sorted in them, with the number of documents that hold a key
and the largest id among them. A new batch meets every run in a merge join: keys that no run holds (anti-join) are new,
their largest id is the holder that keeps its lines, whatever comes later; keys that a run holds add only to its count.
Both become the batch's own run. When `fan_out` runs stand on a level they're merged, bucket by bucket, into one of the
next, so a batch meets few runs and a key is rewritten once a level. In the end the runs are merged, and keys of
`least_documents` or more documents lose their lines everywhere but in their holder.

Runs have the same buckets, so that merging two shuffles nothing, and a batch shuffles its own keys alone. The keys
of a batch are folded by document before they're dealt out, and by task after that, so a line that a third of all
documents holds is one row a task. Of the keys that lose lines the most frequent, by a bound on counts, travel to the
lines; the others are dealt out by hash.

Only DataFrame functions are used. Defined results: a null or empty text is one empty line; documents are told apart by
their id, so rows with equal ids count as one document, each losing its own lines; null ids are one document, below all
others; of repeated lines in the document that keeps them none goes; a text that loses all its lines is empty; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import BROADCAST_ROWS, discard, most_frequent, scratch_path, text_or_empty, written

LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
BATCHES, FAN_OUT = 6, 2
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Places of dropped lines, some 4 bytes each, up to which they travel to the texts.
BROADCAST_PLACES = 2_000_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; lower() does that, and faster, where all is ASCII."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def same_text(text: Column) -> Column:
    """Tells apart rows with equal ids and other texts."""
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))


class Runs:
    """Levelled sorted runs of (h1, h2, n, last, first): documents that hold a key, the largest id, and whether the key came up here.

    Every key has one row with `first` in all runs together. Runs are bucketed tables in the shared scratch folder.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = FAN_OUT):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", scratch_path(self.spark, name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        at = self.spark.table(name).inputFiles()
        self.spark.sql(f"DROP TABLE {name}")
        if at:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(at[0]).getParent()
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """The keys (h1, h2, n, last), each once, as a run of their own: those that no run holds with `first`, the others without."""
        name, held = self._write(keys.withColumn("first", F.lit(True))), [t.where("first").select(*KEY) for t in self.tables()]
        if held:
            batch, own = name, self.spark.table(name).drop("first")
            new = reduce(lambda left, run: left.join(run, KEY, "left_anti"), held, own)
            rows = [new.withColumn("first", F.lit(True))]
            rows += [own.join(run, KEY, "left_semi").withColumn("first", F.lit(False)) for run in held]
            name = self._write(reduce(DataFrame.unionByName, rows))
            self._drop(batch)
        self._place(0, name)

    def _place(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_out:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merge([self.spark.table(n) for n in full]))
            for n in full:
                self._drop(n)
            self._place(level + 1, merged)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """The runs in one, by merge joins of two; a key's counts add up, its holder is that of the row where it came up."""

        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            joined = left.join(right.withColumnsRenamed({"n": "n2", "last": "last2", "first": "first2"}), KEY, "full_outer")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            first, first2 = F.coalesce("first", F.lit(False)), F.coalesce("first2", F.lit(False))
            return joined.select(*KEY, n.cast("long").alias("n"), F.when(first, F.col("last")).when(first2, F.col("last2")).alias("last"), (first | first2).alias("first"))

        return reduce(both, runs)

    def merged(self) -> DataFrame:
        """(h1, h2, n, last) of all keys."""
        return self._merge(self.tables()).drop("first")

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def batch_of(docs: DataFrame, id_column: str, batches: int) -> Column:
    """Number of the batch of a row: ranges of ids of about equal size, largest ids first, null ids in the last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id_column, shares, 1000).alias("cuts")).first()["cuts"] if shares else []
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number += F.when(F.col(id_column) < cut, 1).otherwise(0)
    return F.when(F.col(id_column).isNull(), batches - 1).otherwise(number)


def hashed_lines(docs: DataFrame, id_column: str, text_column: str, least_length: int, batches: int) -> DataFrame:
    """(id, version, place, h1, h2, batch) of the lines whose key is long enough; place counts from 0."""
    text = text_or_empty(text_column)
    lines = docs.select(F.col(id_column).alias("id"), same_text(text).alias("version"), batch_of(docs, id_column, batches).alias("batch"), F.posexplode(split_lines(text)).alias("place", "line"))
    keyed = lines.select("id", "version", "batch", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_length)
    return keyed.select("id", "version", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "batch")


def shared_lines(lines: DataFrame, batches: int, least_documents: int, fan_out: int = FAN_OUT) -> DataFrame:
    """The written (h1, h2, n, last) of keys in enough documents, from runs that the batches of the written lines are added to."""
    spark = lines.sparkSession
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)
    for batch in range(batches):
        held = lines.where(F.col("batch") == batch).select("id", *KEY).distinct()
        runs.add(held.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("last")))
    out = written(runs.merged().where(F.col("n") >= least_documents), "lines-shared")
    runs.drop()
    return out


def dropped_places(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, version, places): the places of the lines that each text loses."""
    hot = most_frequent(shared, BROADCAST_ROWS)
    narrow = lines.select("id", "version", "place", *KEY)
    found = narrow.join(F.broadcast(hot), KEY)
    if hot.count() < shared.count():
        # what is dealt out by hash is rarer than the hot keys
        found = found.unionByName(narrow.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(shared, KEY))
    lost = found.where(~F.col("id").eqNullSafe(F.col("last")))
    return lost.groupBy("id", "version").agg(F.collect_set("place").alias("places"))


def drop_shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per input row: its id, n_lines, n_dropped and the text that is left."""
    hashed = hashed_lines(docs, id_column, text_column, least_length, batches)
    lines = written(hashed, "lines-hashed", by="batch")
    shared = shared_lines(lines, batches, least_documents, fan_out)
    places = written(dropped_places(lines, shared).withColumnsRenamed({"id": "lost_id", "version": "lost_version"}), "lines-places")
    discard(lines, shared)
    few = (places.agg(F.sum(F.size("places") + 10)).first()[0] or 0) <= BROADCAST_PLACES
    text = text_or_empty(text_column)
    # lines are cut below the join, where no function over them can cut them once more
    cut = docs.select(F.col(id_column).alias("id"), same_text(text).alias("version"), split_lines(text).alias("lines"))
    joined = cut.join(F.broadcast(places) if few else places, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("version") == F.col("lost_version")), "left")
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("places")), lambda i: F.get("lines", i))
    kept_text = F.array_join(F.when(F.col("places").isNull(), F.col("lines")).otherwise(kept), "\n")
    return joined.select(F.col("id").alias(id_column), n.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept_text.alias("kept_text"))
