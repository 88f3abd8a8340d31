"""Writes small workbooks in the older binary format, for tests."""

from __future__ import annotations

import struct

FREE, END, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def shared(strings, room):
    """The table of shared strings in records of at most `room` bytes; a string that goes on says anew how wide it is."""
    parts, body = [], struct.pack("<II", len(strings), len(strings))
    for text, rich in strings:
        wide = any(ord(c) > 255 for c in text)
        raw, size = text.encode("utf-16-le" if wide else "latin-1"), 2 if wide else 1
        head = struct.pack("<HB", len(text), wide | (8 if rich else 0)) + (struct.pack("<H", 2) if rich else b"")
        if len(body) + len(head) > room:
            parts, body = [*parts, body], b""
        body += head
        while True:
            n = max(0, (room - len(body)) // size * size)
            body, raw = body + raw[:n], raw[n:]
            if not raw:
                break
            parts, body = [*parts, body], bytes([wide])
        tail = bytes(8) if rich else b""
        while tail:
            n = room - len(body)
            body, tail = body + tail[:n], tail[n:]
            if tail:
                parts, body = [*parts, body], b""
    parts.append(body)
    return b"".join(record(0xFC if k == 0 else 0x3C, p) for k, p in enumerate(parts))


def short_number(x):
    """x in 30 bits, if it fits there."""
    if x == int(x) and abs(x) < 1 << 28:
        return struct.pack("<I", (int(x) << 2 & 0xFFFFFFFF) | 2)
    if round(x * 100) / 100 == x and abs(x) < 1 << 20:
        return struct.pack("<I", (round(x * 100) << 2 & 0xFFFFFFFF) | 3)
    return None


def sheet_records(rows, index):
    out = record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))
    for r, row in enumerate(rows):
        at, run = lambda c: struct.pack("<HHH", r, c, 0), []  # noqa: B023, E731
        for c, v in [*enumerate(row), (len(row), None)]:
            raw = short_number(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            if raw is not None:
                run.append((c, raw))
                continue
            if len(run) == 1:
                out += record(0x27E, at(run[0][0]) + run[0][1])
            elif run:
                out += record(0xBD, struct.pack("<HH", r, run[0][0]) + b"".join(struct.pack("<H", 0) + x for _, x in run) + struct.pack("<H", run[-1][0]))
            run = []
            if isinstance(v, tuple):  # a formula's value
                v = v[0]
                result = struct.pack("<d", v) if isinstance(v, float) else b"\x01\x00" + bytes([v]) + b"\0\0\0\xff\xff" if isinstance(v, bool) else b"\0\0\0\0\0\0\xff\xff"
                out += record(0x06, at(c) + result + bytes(8))
                if isinstance(v, str):
                    out += record(0x207, struct.pack("<HB", len(v), 1) + v.encode("utf-16-le"))
            elif isinstance(v, bool):
                out += record(0x205, at(c) + bytes([v, 0]))
            elif isinstance(v, str):
                out += record(0xFD, at(c) + struct.pack("<I", index[v])) if v in index else record(0x204, at(c) + struct.pack("<HB", len(v), 1) + v.encode("utf-16-le"))
            elif v is not None:
                out += record(0x203, at(c) + struct.pack("<d", v))
    return out + record(0x0A, b"")


def workbook_bytes(sheets, room=8224, unshared=()):
    texts = list(dict.fromkeys(v for rows in sheets.values() for row in rows for v in row if isinstance(v, str) and v not in unshared))
    index = {t: k for k, t in enumerate(texts)}
    head, table = record(0x809, struct.pack("<HHHHII", 0x600, 0x5, 0, 0, 0, 0)), shared([(t, k % 3 == 1) for k, t in enumerate(texts)], room)
    bodies = [sheet_records(rows, index) for rows in sheets.values()]
    bounds = lambda starts: b"".join(record(0x85, struct.pack("<IBBBB", s, 0, 0, len(n), 1) + n.encode("utf-16-le")) for n, s in zip(sheets, starts, strict=True))
    before = len(head) + len(bounds([0] * len(sheets))) + len(table) + 4
    starts = [before + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    return head + bounds(starts) + table + record(0x0A, b"") + b"".join(bodies)


def compound(stream, small):
    """A compound file with the stream in small sectors of the root's stream, or in sectors of its own, dealt out backwards."""
    pad = lambda raw, n: raw + bytes(-len(raw) % n)
    content = pad(stream, 64 if small else 512)
    pieces = [pad(content, 512)[k : k + 512] for k in range(0, len(pad(content, 512)), 512)]
    n, minis = len(pieces), len(content) // 64 if small else 0
    mini = pad(struct.pack(f"<{minis}I", *[k + 1 for k in range(minis - 1)], END), 512) if small else b""
    mini_sectors = len(mini) // 512
    tables = 1
    while tables * 128 < tables + 1 + mini_sectors + n:
        tables += 1
    # first the tables, then the directory, the table of small sectors, and the content from its last sector to its first
    directory, first_mini, base = tables, tables + 1, tables + 1 + mini_sectors
    fat = [TABLE] * tables + [END] + [first_mini + k + 1 for k in range(mini_sectors - 1)] + [END] * bool(mini_sectors) + [END] + [base + k for k in range(n - 1)]
    fat += [FREE] * (tables * 128 - len(fat))
    last = base + n - 1

    def entry(name, kind, first, length):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", FREE, FREE, FREE) + bytes(36) + struct.pack("<III", first, length, 0)

    entries = entry("Root Entry", 5, last if small else END, len(content) if small else 0) + entry("Workbook", 2, 0 if small else last, len(stream)) + bytes(256)
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", tables, directory, 0, 1 << 20 if small else 0, first_mini if small else END, mini_sectors, END, 0)
    assert tables <= 109
    header += struct.pack("<109I", *range(tables), *[FREE] * (109 - tables))
    return header + struct.pack(f"<{len(fat)}I", *fat) + entries + mini + b"".join(reversed(pieces))
