"""Workbooks in the older binary format come back cell by cell."""

from __future__ import annotations

import random

import pytest

from salesprism.sources import loading as LD
from salesprism.sources import xls
from tests.xls_files import compound, workbook_bytes


def text_of(v):
    v = v[0] if isinstance(v, tuple) else v
    return None if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else v if isinstance(v, str) else xls.number_text(float(v))


def values(rng, n):
    texts = ["plain", "naïve", "日本語", "", "a" * 300, "é" * 120, "Ω" * 200]
    kinds = [lambda: rng.choice(texts) + str(rng.randint(0, 50)), lambda: rng.randint(-(2**28), 2**28 - 1), lambda: rng.randint(-99999, 99999) / 100, lambda: rng.random() * 1e9, lambda: rng.random() < 0.5, lambda: None, lambda: (rng.choice([1.5, -2.0, True, "formula Ω"]),), lambda: 0]
    return [[rng.choice(kinds)() for _ in range(rng.randint(1, 9))] for _ in range(n)]


@pytest.mark.parametrize(("seed", "room", "small"), [(1, 8224, False), (2, 64, False), (3, 97, True), (4, 1000, True)])
def test_cells_come_back(seed, room, small):
    rng = random.Random(seed)
    book = {"First": values(rng, 30 if small else 400), "Zweites – Blatt": values(rng, 5), "empty": []}
    data = compound(workbook_bytes(book, room, unshared=("plain7", "日本語9")), small)
    assert xls.is_xls(data) and [n for n, _ in xls.sheets(data)] == list(book)
    for name, rows in book.items():
        expected = {(r, c): text_of(v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None}
        assert {(r, c): v for r, c, v in xls.sheet_cells(data, name)} == expected
        assert all(len(cells) == 1 + max(c for r2, c in expected if r2 == r) for r, cells in xls.sheet_rows(data, name))


def test_broken_files_end():
    data = compound(workbook_bytes({"a": [["x"]]}), False)
    with pytest.raises(ValueError):
        xls.workbook_stream(data[:512] + bytes(512) + data[1024:])
    with pytest.raises(ValueError):
        xls.workbook_stream(data.replace("Workbook".encode("utf-16-le"), "Workcook".encode("utf-16-le")))


def test_sheets_of_a_workbook_are_one_table(spark, tmp_path):
    head = ["Day", "Item", "Amount"]
    book = {m: [head, *[[f"2024-0{k}-{d:02d}", f"item {d % 3}", d * 1.5] for d in range(1, 20)], ["Total", None, 99.0]] for k, m in enumerate(("Jan", "Feb"), 1)}
    (tmp_path / "shop.xls").write_bytes(compound(workbook_bytes(book), False))
    table, report = LD.load(spark, f"{tmp_path}/shop.xls")
    assert report.sheets == ["Jan", "Feb"] and report.rows_out == 38 and table.columns == [*head, LD.SHEET]
    assert table.selectExpr("sum(cast(Amount as double)) s").first()["s"] == 2 * sum(d * 1.5 for d in range(1, 20))
