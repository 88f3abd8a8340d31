"""Delimited text with line breaks in cells, in many small blocks, against Python's csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from salesprism.sources import delimited
from salesprism.sources.loading import load, read_delimited


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", n))
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(text, separator=","):
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=separator))


def read(spark, path, separator=","):
    lines = delimited.read_lines(spark, str(path))
    out = delimited.records(lines, delimited.survey(lines, separator), separator).collect()
    assert sorted(r["row_id"] for r in out) == list(range(len(out)))
    return [list(r["cells"]) for r in sorted(out, key=lambda r: r["row_id"])], lines.rdd.getNumPartitions()


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_plain_reader(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    separator, end = rng.choice([",", ";", "\t"]), rng.choice(["\n", "\r\n"])
    cell = lambda: rng.choice(["", "a", 'say "hi"', f"two{end}lines", end, '"', f"{separator}x", "é" * rng.randint(1, 30), f"long{end * 9}" * rng.choice([1, 20])])
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=separator, lineterminator=end).writerows([[cell() for _ in range(rng.randint(1, 5))] for _ in range(300)])
    text = out.getvalue()
    if seed % 2:  # quotes that open nothing, and a cell that never ends
        text += f'5" pipe{separator}a"b{end}"closed"tail"{separator}"x"{end}"never{separator}closed{end}more'
    (tmp_path / "f.csv").write_bytes(text.encode())
    small_blocks(rng.choice([64, 500, 3000]))
    got, tasks = read(spark, tmp_path / "f.csv", separator)
    assert tasks > 3 and got == plain(text, separator)


def test_one_cell_over_many_blocks_and_several_files(spark, tmp_path, small_blocks):
    a, b = 'h,i\n1,"' + "x\n" * 400 + '"\n2,y\n', '3,"open\n\nx'
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text(a)
    (tmp_path / "d" / "b.csv").write_text(b)
    small_blocks(100)
    got, tasks = read(spark, tmp_path / "d")
    # the files' last state isn't carried into the next one
    assert tasks > 5 and got == plain(a) + plain(b)


@pytest.mark.parametrize("line", ['a,"b', 'b",c', '"a""b",c', '"a"x"y,"z', "plain", '""', '"', 'a"b,"c""', '","', '",'])
@pytest.mark.parametrize("inside", [False, True])
def test_a_line_leaves_open_what_the_reader_leaves_open(line, inside):
    more = list(csv.reader([('"' if inside else "") + line + "\n", "END\n"]))
    assert delimited.leaves_open(line, inside, ",") == (len(more) == 1)


def test_tables_with_breaks_in_cells_are_tidy(spark, tmp_path, small_blocks):
    rows = "".join(f'{i},"item {i}\nsecond line",{i}.5\n' for i in range(200))
    (tmp_path / "t.csv").write_text("﻿day,what,amount\n" + rows)
    small_blocks(400)
    table, report = load(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["day", "what", "amount"] and report.rows_out == 200
    assert table.agg(F.sum("amount"), F.count_if(F.col("what").contains("\n"))).first()[:] == (20000.0, 200)
    (tmp_path / "empty.csv").write_text("")
    assert read_delimited(spark, str(tmp_path / "empty.csv")).count() == 0
