"""Delimited text whose quoted cells may hold line breaks, read by many tasks a file.

Spark deals a file out in blocks of lines. A line starts either a record or inside a quoted cell; what it leaves the
next one with is a function of that, and so is what a block leaves the next block with. One pass reports each block's
function, and how many records begin in it, under both assumptions. Functions of two states are the identity, the
exchange or a constant, so running windows over the blocks settle every block's state: the last constant before it and
the exchanges since. With its state and the number of records before it a block is then read alone. Records that go
over the edge of a block come out as pieces, one a block, and are put together by their number.

Bounds: a row for each block travels (a block has spark.sql.files.maxPartitionBytes); a record is held whole by one
task. Cells are cut as Python's csv module cuts them; a cell that its file never closes ends without the last line break.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
LONGEST_CELL = 1 << 30


def leaves_open(line: str, inside: bool, separator: str) -> bool:
    """Whether a line ends inside a quoted cell, if it starts there or not."""
    if QUOTE not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(QUOTE, at) + 1
            if not at:
                return True
            if at < n and line[at] == QUOTE:  # two are a quote in the cell
                at += 1
                continue
            inside = False
        elif at < n and line[at] == QUOTE:
            inside, at = True, at + 1
            continue
        # what stands before the next separator belongs to the cell, quotes as well
        at = line.find(separator, at) + 1
        if not at:
            return False


def cut_records(records: list[str], separator: str) -> list[list[str]]:
    csv.field_size_limit(LONGEST_CELL)
    return [next(csv.reader([r], delimiter=separator), []) for r in records]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[str]]]:
    """(first row of a slice without its line, lines) of slices of one block each, in order."""
    for batch in batches:
        keys = batch.select([n for n in batch.schema.names if n != "value"])
        changes = [pc.not_equal(keys.column(n)[1:], keys.column(n)[:-1]) for n in ("file", "block")] if batch.num_rows > 1 else []
        starts = [0, *(np.flatnonzero(pc.or_(*changes).to_numpy(zero_copy_only=False)) + 1).tolist()] if changes else [0]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if b > a:
                yield keys.slice(a, 1).to_pylist()[0], batch.column("value").slice(a, b - a).to_pylist()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block) of text in blocks; lines end with \\n, or with \\r where the first one holds that."""
    first = spark.read.text(path, lineSep="\n").limit(1).collect()
    separator = "\r" if first and "\r" in first[0][0].rstrip("\r") else "\n"
    lines = spark.read.text(path, lineSep=separator)
    return lines.select(F.when(F.col("value").startswith("\ufeff"), F.substring("value", 2, LONGEST_CELL)).otherwise(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def survey(lines: DataFrame, separator: str) -> DataFrame:
    """A row for each block: whether it ends open and how many records begin in it, if it starts at a record or inside a cell; its widest line; whether a record goes over lines."""
    schema = "file string, block long, out_open boolean, out_records long, in_open boolean, in_records long, width int, broken boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST_CELL)
        found: dict[tuple, list] = {}
        for key, own in _blocks(batches):
            state = found.setdefault((key["file"], key["block"]), [False, 0, True, 0, 1, False])
            for line in own:
                for k, was_open in ((0, state[0]), (2, state[2])):
                    state[k + 1] += not was_open
                    state[k] = leaves_open(line, was_open, separator)
                state[5] |= leaves_open(line, False, separator)
                state[4] = max(state[4], len(next(csv.reader([line], delimiter=separator), [])) if QUOTE in line else line.count(separator) + 1)
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
    return lines.mapInArrow(run, schema)


def settled(blocks: DataFrame) -> DataFrame:
    """blocks with `inside`, whether it starts inside a cell, and `before`, how many records begin in the blocks ahead of it, files in order of their names."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.when(F.col("out_open") == F.col("in_open"), F.col("out_open"))
    exchange = F.col("out_open") & ~F.col("in_open")
    swaps = F.coalesce(F.sum(exchange.cast("int")).over(before), F.lit(0))
    t = blocks.withColumn("swaps", swaps).withColumn("constant", constant)
    known = F.last(F.when(F.col("constant").isNotNull(), F.struct("constant", "swaps")), ignorenulls=True).over(before)
    t = t.withColumn("known", known)
    odd = (F.col("swaps") - F.coalesce(F.col("known.swaps"), F.lit(0))) % 2 == 1
    t = t.withColumn("inside", F.coalesce(F.col("known.constant"), F.lit(False)) != odd)
    t = t.withColumn("records", F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records")))
    whole = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("file", "block", "inside", F.coalesce(F.sum("records").over(whole), F.lit(0)).alias("before"))


PARSED = "row_id long, cells array<string>, file string, block long, piece string"


def records(lines: DataFrame, blocks: DataFrame, separator: str) -> DataFrame:
    """(row_id, cells) of all records of the lines, numbered from 0 in the order of files and lines."""
    at = settled(blocks).withColumnsRenamed({"file": "own_file", "block": "own_block"})
    placed = lines.join(F.broadcast(at), (F.col("file") == F.col("own_file")) & (F.col("block") == F.col("own_block"))).select("value", "file", "block", "inside", "before")
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        here, inside, held, number = None, False, [], 0
        for key, own in _blocks(batches):
            out = []
            if here != (key["file"], key["block"]):
                if held:
                    out.append((number, None, *here, "\n".join(held)))
                # a block that starts inside a cell begins with the rest of the last record before it
                here, inside, held, number, begun = (key["file"], key["block"]), key["inside"], [], key["before"] - key["inside"], not key["inside"]
            whole = []
            for line in own:
                held.append(line)
                inside = leaves_open(line, inside, separator)
                if not inside:
                    if begun:
                        whole.append((number, "\n".join(held)))
                    else:
                        out.append((number, None, *here, "\n".join(held)))
                    held, begun, number = [], True, number + 1
            out += [(n, cells, None, None, None) for (n, _), cells in zip(whole, cut_records([r for _, r in whole], separator), strict=True)]
            yield batch(out)
        if held:
            yield batch([(number, None, *here, "\n".join(held))])

    parsed = placed.mapInArrow(run, PARSED)
    pieces = parsed.where("piece is not null").groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "\n").alias("record"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(cut_records(b.column("record").to_pylist(), separator), pa.list_(pa.string()))], names=["row_id", "cells"])

    return parsed.where("piece is null").select("row_id", "cells").unionByName(pieces.mapInArrow(joined, "row_id long, cells array<string>"))
