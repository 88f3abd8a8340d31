"""Cells of workbooks in the older binary format: a compound file of sectors, in it a stream of BIFF8 records.

Layout after the published descriptions of compound files and of the record format. Only values are read: shared
strings, which may go on over several records, numbers of all kinds, truth values, and what formulas last came to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Signatures, sizes and record numbers of the format.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
HEADER_SECTORS, ENTRY, NO_SECTOR = 109, 128, 0xFFFFFFFA
BOF, EOF, CONTINUE, BOUNDSHEET, SST, STRING = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x207
LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x205


def is_xls(data: bytes) -> bool:
    return data[:8] == SIGNATURE


def _chain(first: int, table: list[int]) -> Iterator[int]:
    at, seen = first, 0
    while at < NO_SECTOR:
        if at >= len(table) or seen > len(table):
            raise ValueError("a chain of sectors doesn't end")
        yield at
        at, seen = table[at], seen + 1


def workbook_stream(data: bytes) -> bytes:
    """The stream with the records."""
    size, small = 1 << struct.unpack_from("<H", data, 0x1E)[0], 1 << struct.unpack_from("<H", data, 0x20)[0]
    directory, cutoff, first_small = struct.unpack_from("<I", data, 0x30)[0], struct.unpack_from("<I", data, 0x38)[0], struct.unpack_from("<I", data, 0x3C)[0]
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    # sectors that hold the table of sectors: some in the header, more in a chain of their own
    tables, more = numbers(data[0x4C : 0x4C + 4 * HEADER_SECTORS]), struct.unpack_from("<I", data, 0x44)[0]
    while more < NO_SECTOR:
        own = numbers(sector(more))
        tables, more = tables + own[:-1], own[-1]
    table = [x for k in tables if k < NO_SECTOR for x in numbers(sector(k))]
    read = lambda first: b"".join(sector(k) for k in _chain(first, table))
    entries = read(directory)
    found = {}
    for at in range(0, len(entries) - ENTRY + 1, ENTRY):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        if kind:
            found[entries[at : at + max(0, length - 2)].decode("utf-16-le")] = (kind, *struct.unpack_from("<II", entries, at + 116))
    name = next((n for n in ("Workbook", "Book") if n in found), None)
    if name is None:
        raise ValueError("the file holds no workbook")
    _, first, length = found[name]
    if length >= cutoff:
        return read(first)[:length]
    # short streams lie in small sectors inside the root's stream
    root = read(next(f for k, f, _ in found.values() if k == 5))
    return b"".join(root[k * small : (k + 1) * small] for k in _chain(first, numbers(read(first_small))))[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, its data and that of the records that continue it) up to the end of the part that begins at `at`."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + length], at + 4 + length
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
        if kind == EOF:
            break
    if held:
        yield held


def _plain_string(body: bytes, at: int, length: int) -> str:
    wide = body[at] & 1
    return body[at + 1 : at + 1 + length * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The shared strings; where one goes over a record's end, the next record says anew how wide its characters are."""
    count = struct.unpack_from("<I", parts[0], 4)[0]
    part, at, out = 0, 8, []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            piece = parts[part][at : at + n - len(got)]
            got, at = got + piece, at + len(piece)
        return got

    for _ in range(count):
        length, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while length:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            n = min(length, (len(parts[part]) - at) // (2 if wide else 1))
            text += parts[part][at : at + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1")
            at, length = at + n * (2 if wide else 1), length - n
        take(4 * runs + extra)
        out.append(text)
    return out


def sheets(data: bytes) -> list[tuple[str, int]]:
    """(name, where it begins in the stream) of the sheets with cells."""
    out = []
    for kind, parts in records(workbook_stream(data)):
        if kind == BOUNDSHEET and parts[0][5] == 0:
            out.append((_plain_string(parts[0], 7, parts[0][6]), struct.unpack_from("<I", parts[0])[0]))
    return out


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _short_number(raw: int) -> float:
    """A number in 30 bits: a whole one or the upper part of a double, perhaps in hundredths."""
    x = float(raw - (1 << 32) >> 2 if raw & 0x80000000 else raw >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return x / 100 if raw & 1 else x


def sheet_cells(data: bytes, name: str) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the filled cells of a sheet."""
    stream = workbook_stream(data)
    strings = next((shared_strings(parts) for kind, parts in records(stream) if kind == SST), [])
    waiting: tuple[int, int] | None = None
    for kind, parts in records(stream, dict(sheets(data))[name]):
        body = parts[0]
        if kind == STRING and waiting:
            yield *waiting, _plain_string(b"".join(parts), 2, struct.unpack_from("<H", body)[0])
        waiting = None if kind == STRING else waiting
        if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            continue
        row, column = struct.unpack_from("<HH", body)
        if kind == LABELSST:
            yield row, column, strings[struct.unpack_from("<I", body, 6)[0]]
        elif kind == LABEL:
            yield row, column, _plain_string(body, 8, struct.unpack_from("<H", body, 6)[0])
        elif kind == NUMBER:
            yield row, column, number_text(struct.unpack_from("<d", body, 6)[0])
        elif kind == RK:
            yield row, column, number_text(_short_number(struct.unpack_from("<I", body, 6)[0]))
        elif kind == MULRK:
            for k in range((len(body) - 6) // 6):
                yield row, column + k, number_text(_short_number(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        elif kind == BOOLERR and not body[7]:
            yield row, column, "TRUE" if body[6] else "FALSE"
        elif kind == FORMULA:
            if body[12:14] != b"\xff\xff":
                yield row, column, number_text(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = (row, column)
            elif body[6] == 1:
                yield row, column, "TRUE" if body[8] else "FALSE"


def sheet_rows(data: bytes, name: str) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of the rows of a sheet that have cells."""
    rows: dict[int, dict[int, str]] = {}
    for row, column, text in sheet_cells(data, name):
        rows.setdefault(row, {})[column] = text
    for row in sorted(rows):
        yield row, [rows[row].get(c) for c in range(max(rows[row]) + 1)]
