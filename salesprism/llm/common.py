"""Helpers shared by the corpus operators: scratch tables, Arrow row maps, hash folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.scratch import discard, scratch_path, written

#: Rows turned into Python objects at once, so that a batch of very long texts stays small.
SLICE_ROWS = 256
#: Rows of keys and numbers, some 30 MB, up to which a table travels to all executors instead of a shuffle of texts.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, marked for broadcast if it is counted to be small; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(table: DataFrame, *order: Column, number: str = "place") -> tuple[DataFrame, DataFrame]:
    """table with the number, from 1, of each row in that order over all of it, and the scratch table that it reads.

    A partition is a range of the order; the sizes of the ranges, a row for each partition, are added up. Rows that
    are equal in the order get the numbers of their range in any order. table is read twice.
    """
    ranges = written(table.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = ranges.join(F.broadcast(sizes.select("range", ahead.alias("ahead"))), "range").withColumn(number, F.col("ahead") + inside)
    return out.drop("range", "ahead"), ranges


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the written table with the largest n, at most so many: those above a bound that counts of n's size classes give."""
    size = F.floor(F.log2("n") * 16)
    # some hundred size classes
    classes = sorted(((r["size"], r["rows"], r["least"]) for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()), reverse=True)
    bound, taken = None, 0
    for _, rows, least in classes:
        if taken + rows > most:
            break
        bound, taken = least, taken + rows
    return counted.where(F.col("n") >= bound) if taken else counted.where(F.lit(False))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has no remainder and gets -1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus, F.lit(-1))


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pydict()


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in `column` have `size` bytes together at most; a longer text is a slice of its own."""
    for batch in batches:
        lengths, start, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
        for k, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """df.mapInArrow with fn called on bounded slices; fn may return any number of rows."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for own in row_slices(batches, rows):
            out = fn(own)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def where_text(df: DataFrame, column: str, keep: Callable[[list[str]], list[bool]], rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of df that keep() says yes to, from texts of bounded slices; a null text is empty. Rows pass as Arrow holds them, only the texts of a slice become Python objects."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                own = batch.slice(start, rows)
                yield own.filter(pa.array(keep([t or "" for t in own.column(column).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def with_text(df: DataFrame, column: str, change: Callable[[str], str], rows: int = SLICE_ROWS) -> DataFrame:
    """df with the texts of a column changed one by one, as where_text() reads them; a null stays null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, rows):
                own = batch.slice(start, rows)
                texts = [None if t is None else change(t) for t in own.column(at).to_pylist()]
                yield own.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
