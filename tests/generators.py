"""Seeded sales tables with planted facts."""

from __future__ import annotations

import datetime as dt

import numpy as np

PRICES = {"Linen Candle": 9000.0, "Soap Bar": 2500.0, "Gift Box": 15000.0, "Matches Tin": 1200.0, "Body Oil": 7000.0}
SCHEMA = "date date, product string, quantity double, unit_price double, revenue double, cost double, profit double, order_id string, customer_id string, channel string"


def business(spark, decline: bool, seed: int = 1, days: int = 540):
    """Daily sales from 2024-01-01; with `decline`, the online channel loses half from the seventh month on."""
    rng, rows = np.random.default_rng(seed), []
    names = list(PRICES)
    for d in range(days):
        date = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        for _ in range(rng.poisson(6)):
            channel = ["online", "store"][int(rng.random() < 0.4)]
            if decline and channel == "online" and d >= 181 and rng.random() < 0.6:
                continue
            p = names[int(rng.integers(5))]
            q = float(rng.integers(1, 5))
            price = PRICES[p] * (1 + 0.02 * rng.standard_normal())
            revenue, cost = round(q * price, 2), round(q * PRICES[p] * (1.18 if p == "Gift Box" else 0.5), 2)
            rows.append((date, p, q, price, revenue, cost, round(revenue - cost, 2), f"SO{len(rows):05d}", f"C{int(rng.integers(400)):04d}", channel))
    return spark.createDataFrame(rows, SCHEMA)


def workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """A small .xlsx of inline strings and numbers."""
    import zipfile
    from xml.sax.saxutils import escape

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r}"
        return "" if v is None else f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} sheetId={chr(34)}{i}{chr(34)} r:id={chr(34)}r{i}{chr(34)}/>" for i, n in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id={chr(34)}r{i}{chr(34)} Target={chr(34)}worksheets/sheet{i}.xml{chr(34)}/>" for i in range(1, len(sheets) + 1))}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
