"""Files to tidy tables: delimited text and workbooks, header search, totals and blanks removed, sheets joined.

Delimited text is read and repaired by Spark. Workbooks (25 MB at most) come through a Python data source with one
partition for each sheet. Only the first rows of a grid are collected, to find the header.
"""

from __future__ import annotations

import csv
import io
import operator
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from salesprism.functions.cleaning import NULL_TOKENS, is_blank
from salesprism.sources import xls
from salesprism.sources.delimited import read_lines, records, survey

# Words that mark a summary row, how far down the header is searched.
TOTALS = ("total", "totals", "subtotal", "sub total", "sub-total", "grand total", "grandtotal", "sum", "summary", "average", "avg", "mean", "balance", "closing balance", "count", "overall")
HEADER_ROWS = 12
MOST_BYTES = 25 * 1024 * 1024
SHEET = "_sheet"


@dataclass
class LoadReport:
    rows_in: int = 0
    rows_out: int = 0
    sheets: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    header_row: int = 0
    dropped_columns: list[str] = field(default_factory=list)


def header_score(row: list[str | None]) -> float:
    """How much a row looks like a header: filled, texts, short, distinct."""
    if not row:
        return 0.0
    there = [c.strip() for c in row if c is not None and c.strip().lower() not in NULL_TOKENS]
    if not there:
        return 0.0
    texts = [c for c in there if not re.fullmatch(r"[₦$£€¥\s]*[-+(]?[\d.,/:\-\s]+[)%]?", c)]
    return 0.35 * len(there) / len(row) + 0.30 * len(texts) / len(there) + 0.15 * sum(len(c) <= 40 for c in there) / len(there) + 0.20 * len({c.lower() for c in there}) / len(there)


def find_header(rows: list[list[str | None]]) -> int:
    """The first best row of the first dozen; a row counts half if the next one looks more like a header."""
    scores = [header_score(r) for r in rows]
    best = [s * (0.5 if i + 1 < len(scores) and scores[i + 1] > s else 1.0) for i, s in enumerate(scores[:HEADER_ROWS])]
    return max(range(len(best)), key=lambda i: (best[i], -i)) if best else 0


def merged_header(top: list[str | None], below: list[str | None]) -> list[str] | None:
    """Names of a header over two rows, the upper one carried to the right; None if one row is all."""
    if all(c and c.strip() for c in top) or header_score(below) < 0.45 or any(c and re.fullmatch(r"[\d.,/:\-]+", c.strip()) for c in below):
        return None
    out, last = [], ""
    for a, b in zip(top, below, strict=False):
        last = a.strip() if a and a.strip() else last
        out.append(" ".join(x for x in (last, (b or "").strip()) if x))
    return out


def unique_names(names: list[str | None]) -> list[str]:
    out, seen = [], {}
    for i, n in enumerate(names):
        n = (n or "").strip()
        n = f"column_{i + 1}" if not n or n.lower().startswith("unnamed") else n
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        out.append(n if seen[k] == 1 else f"{n}_{seen[k]}")
    return out


def is_total(cell: Column, longer: int | None = None) -> Column:
    """A marker, alone or followed by nothing but marks, digits or words of time; with `longer`, or what begins with a total word and is at most so many characters longer."""
    low = F.lower(F.trim(cell))
    if longer is not None:
        bare = F.rtrim(low, F.lit(":"))
        begins = [F.startswith(bare, F.lit(w)) & (F.char_length(bare) <= len(w) + longer) for w in ("total", "subtotal", "sub total", "sub-total", "grand total")]
        return F.coalesce(reduce(operator.or_, [bare.isin(*TOTALS), *begins]), F.lit(False))
    return F.coalesce(low.rlike(rf"^({'|'.join(sorted(map(re.escape, TOTALS), key=len, reverse=True))})[\s:.\-\d]*((for|of)?\s*(the\s+)?(day|week|month|quarter|year|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\d:.\-]*)?$"), F.lit(False))


def tidy(grid: DataFrame, report: LoadReport | None = None, longer_totals: int | None = None) -> tuple[DataFrame, LoadReport]:
    """A grid (row_id, cells array<string>) as a table of texts with names; rows with a total or with 999 of 1,000 cells blank are left out.

    longer_totals: see is_total(); 12 takes "Total Care Soap" for a total.
    """
    report = report or LoadReport()
    filled = grid.where(F.exists("cells", lambda c: ~is_blank(c)))
    width = filled.agg(F.max(F.size("cells"))).first()[0] or 0
    if not width:
        return grid.sparkSession.createDataFrame([], "column_1 string"), report
    head = [(r["row_id"], (list(r["cells"]) + [None] * width)[:width]) for r in filled.orderBy("row_id").limit(HEADER_ROWS + 1).collect()]
    at = find_header([r for _, r in head])
    names, last = head[at][1], head[at][0]
    if at + 1 < len(head) and (both := merged_header(names, head[at + 1][1])):
        names, last = both, head[at + 1][0]
    names = unique_names(names)
    body = filled.where(F.col("row_id") > last).select("row_id", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)])
    cells = F.array(*[f"c{i}" for i in range(width)])
    filled_cells = F.size(F.filter(cells, lambda c: ~is_blank(c)))
    kept = body.where(~F.exists(cells, lambda c: is_total(c, longer_totals)) & (filled_cells > 0.001 * width))
    counts = kept.agg(F.count("*").alias("n"), *[F.count_if(~is_blank(F.col(f"c{i}"))).alias(f"n{i}") for i in range(width)]).first()
    used = [i for i in range(width) if counts[f"n{i}"]]
    report.rows_in, report.rows_out, report.header_row = body.count(), counts["n"], at
    report.dropped_columns = [names[i] for i in range(width) if i not in used]
    return kept.select(*[F.col(f"c{i}").alias(names[i]) for i in used]), report


def sniff_separator(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, cells) of delimited text; row numbers follow the order of lines. Empty cells are null."""
    lines = read_lines(spark, path)
    sep = "\t" if path.lower().endswith(".tsv") else sniff_separator("\n".join(r[0] for r in lines.select("value").limit(20).collect()))
    blocks = survey(lines, sep)
    found = blocks.agg(F.max("width").alias("n"), F.max("broken").alias("broken")).first()
    if found["broken"]:
        return records(lines, blocks, sep).select("row_id", F.transform("cells", lambda c: F.nullif(c, F.lit(""))).alias("cells"))
    # a record for each line: Spark's own reader cuts the cells
    width = max(found["n"] or 1, 1)
    schema = ", ".join(f"c{i} string" for i in range(width + 8))
    table = spark.read.csv(path, schema=schema, sep=sep, header=False, mode="PERMISSIVE", escape='"')
    return table.select(F.monotonically_increasing_id().alias("row_id"), F.slice(F.array(*table.columns), 1, width).alias("cells"))


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
RID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_files(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of a workbook's sheets."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", NS)
    return [(s.get("name"), "xl/" + targets[s.get(RID)].lstrip("/").removeprefix("xl/")) for s in sheets]


def sheet_names(data: bytes) -> list[str]:
    if xls.is_xls(data):
        return [n for n, _ in xls.sheets(data)]
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        return [n for n, _ in sheet_files(book)]


def sheet_rows(data: bytes, name: str) -> Iterator[tuple[int, list[str | None]]]:
    if xls.is_xls(data):
        yield from xls.sheet_rows(data, name)
        return
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = ["".join(t.text or "" for t in x.iterfind(".//m:t", NS)) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        for number, row in enumerate(ElementTree.fromstring(book.read(dict(sheet_files(book))[name])).iterfind("m:sheetData/m:row", NS)):
            cells: list[str | None] = []
            for c in row.iterfind("m:c", NS):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v, kind = c.find("m:v", NS), c.get("t")
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", NS)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                cells += [None] * (at - len(cells)) + [text]
            yield number, cells


class _Sheet(InputPartition):
    def __init__(self, data: bytes, name: str):
        self.data, self.name = data, name


class WorkbookReader(DataSourceReader):
    def __init__(self, data: bytes):
        self.data = data

    def partitions(self):
        return [_Sheet(self.data, n) for n in sheet_names(self.data)]

    def read(self, partition):
        for number, cells in sheet_rows(partition.data, partition.name):
            yield (partition.name, number, cells)


class Workbook(DataSource):
    """format("workbook") with the file's bytes in hex as option data: a partition for each sheet."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return "sheet string, row_id long, cells array<string>"

    def reader(self, schema):
        return WorkbookReader(bytes.fromhex(self.options["data"]))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, LoadReport]:
    """The sheets that share their columns with most rows, one table with the sheet's name; others are reported."""
    blob = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").first()
    if blob is None:
        raise ValueError(f"no workbook of at most {MOST_BYTES} bytes at {path}")
    spark.dataSource.register(Workbook)
    grid = spark.read.format("workbook").option("data", bytes(blob[0]).hex()).load()
    names = [n for n in sheet_names(bytes(blob[0])) if sheet in (None, n)]
    tables = [(n, *tidy(grid.where(F.col("sheet") == n).select("row_id", "cells"))) for n in names]
    groups: dict[tuple, list] = {}
    for n, df, rep in tables:
        if rep.rows_out:
            groups.setdefault(tuple(sorted(c.lower() for c in df.columns)), []).append((n, df, rep))
    if not groups:
        raise ValueError("the workbook has no rows")
    best = max(groups.values(), key=lambda g: sum(r.rows_out for _, _, r in g))
    out = None
    for n, df, _ in best:
        own = df.withColumn(SHEET, F.lit(n)) if len(best) > 1 else df
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    used = [n for n, _, _ in best]
    report = LoadReport(sum(r.rows_in for _, _, r in best), sum(r.rows_out for _, _, r in best), used, [n for n in names if n not in used], best[0][2].header_row)
    return out, report


def load(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, LoadReport]:
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("xlsx", "xlsm", "xls"):
        return read_workbook(spark, path, sheet)
    if suffix in ("csv", "tsv", "txt"):
        return tidy(read_delimited(spark, path))
    if suffix == "parquet":
        df = spark.read.parquet(path)
        return df, LoadReport(rows_out=df.count())
    raise ValueError(f"can't read files of type {suffix}")
