"""Secret scan: patterns name candidates, decoding and parsing confirm keys and signed tokens.

Base spans are plain matches: assignments of credentials, access ids, long hex runs. On top, base64 and hex
candidates are decoded and only reported when their bytes parse as a key (DER with nested lengths that add up,
OpenSSH's length-prefixed strings, a PEM block around one of these, encrypted by its headers or not) or, for signed
tokens, when the header is JSON with an algorithm.

Candidates are streams: lines of base64 or hex with nothing but space, quotes or line ends, plain or written out as
\\n, between them, or bytes in hex with colons. A stream is decoded once at each of its alignments (four, or two for
hex); a key may begin at any character that the head of one can stand at, and its own lengths say where it ends. What
decodes to text is searched in turn, DEPTH levels deep, so a key encoded twice or a PEM block in base64 is found. The
work grows with the length of a text, whatever is in it. A key inside a PEM block is reported as that block.

Defined results: a null text is empty; empty texts have no spans; rows are independent, so repeated rows give
repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import map_slices, text_or_empty, with_text

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]
_ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Every hex, base64 and token candidate lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{32,}")
#: No assignment without one of these, in lower case.
NAMES = ("passw", "secret", "token", "api")
#: Streams: a line, what follows the last whole line, and the characters that one line may be apart from the next.
STANDARD64 = (re.compile(r"[A-Za-z0-9+/]{32,}"), re.compile(r"[\s\"',\\]{1,64}([A-Za-z0-9+/]{1,31})(?![A-Za-z0-9+/])"))
URL64 = (re.compile(r"[A-Za-z0-9_-]{32,}"), re.compile(r"[\s\"',\\]{1,64}([A-Za-z0-9_-]{1,31})(?![A-Za-z0-9_-])"))
ANYHEX = (re.compile(r"[0-9a-fA-F]{32,}"), re.compile(r"[\s\"',\\]{1,64}([0-9a-fA-F]{1,31})(?![0-9a-fA-F])"))
GAP = re.compile(r"[\s\"',\\]{1,64}")
COLONS, BYTE = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{2}(?::\s{0,64}[0-9a-fA-F]{2}){31,}"), re.compile("[0-9a-fA-F]{2}")
#: Where a DER sequence whose first part is a number or a sequence, or an OpenSSH key, can begin.
HEAD64 = re.compile("M(?=[A-H][AEIMQUYcgkosw048][Cw]|I[E-L])|b(?=3BlbnNzaC1rZXktdjEA)")
HEAD_HEX = re.compile("3(?=0(?:8[1-4]|[2-7][0-9a-fA-F]))|6(?=[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631)")
#: Levels of encoding within encoding.
DEPTH = 3
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})(?=\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)((?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?))")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:(?:\s|\\[nr])*Proc-Type:\x20*4,\x20*ENCRYPTED(?:\s|\\[nr])+DEK-Info:\x20*[A-Z0-9-]{3,40},[0-9A-Fa-f]{16,64})?(?:[A-Za-z0-9+/=\s]|\\[nr])*)-----END \1-----")
#: Where the header of a signed token can begin: a brace, then space or a quote.
HEADER = re.compile("e(?=y[ABIJ]|w[k-z0-3])")
#: Headers inside a PEM block that say how its body is encrypted, and the bytes of a block of such ciphers.
ENCRYPTED = re.compile(r"\s*Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*([A-Z0-9-]+),\s*([0-9A-Fa-f]{16,64})\s+(.*)", re.S)
CIPHER_BLOCK = {"DES": 8, "AES": 16, "CAM": 16, "SEE": 16, "ARI": 16}
OPENSSH_MAGIC = b"openssh-key-v1\0"


def _decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at `at`, None if its length doesn't fit into the parent."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill start:end exactly; a key has at most ten."""
    out = []
    while start < end:
        if len(out) > 10 or not (x := _tlv(data, start, end)):
            return None
        out.append(x)
        start = x[2]
    return out


def der_end(data: bytes, at: int = 0) -> int | None:
    """The end of a PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA private key at `at`, all nested lengths included."""
    top = _tlv(data, at, len(data))
    if not top or top[0] != 0x30 or not (parts := _children(data, top[1], top[2])):
        return None
    tags, good = [p[0] for p in parts], False
    number = int.from_bytes(data[parts[0][1] : min(parts[0][2], parts[0][1] + 9)], "big") if tags[0] == 2 and parts[0][2] > parts[0][1] else -1
    if tags in ([2] * 9, [2] * 6) and number == 0:
        good = all(e > s for _, s, e in parts)
    elif tags[:3] == [2, 0x30, 4] and number in (0, 1):
        inner = _children(data, parts[1][1], parts[1][2])
        good = bool(inner) and inner[0][0] == 6 and parts[2][2] > parts[2][1]
    elif tags[:2] == [2, 4] and number == 1 and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2:
        good = 16 <= parts[1][2] - parts[1][1] <= 80 and all(_children(data, s, e) for _, s, e in parts[2:])
    elif tags == [0x30, 4]:
        inner = _children(data, parts[0][1], parts[0][2])
        good = bool(inner) and len(inner) == 2 and inner[0][0] == 6 and inner[1][0] == 0x30 and bool(_children(data, inner[1][1], inner[1][2])) and parts[1][2] - parts[1][1] >= 16
    return top[2] if good else None


def is_der_key(data: bytes) -> bool:
    return der_end(data) == len(data)


def openssh_end(data: bytes, at: int = 0) -> int | None:
    """The end of an OpenSSH private key at `at`: names of cipher and derivation, public keys, private part."""
    if not data.startswith(OPENSSH_MAGIC, at):
        return None
    at += len(OPENSSH_MAGIC)

    def string() -> int | None:
        """Length of the string at `at`, which moves behind it; None if it isn't all there."""
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return n if at <= len(data) else None

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(string() for _ in range(keys + 1)) else None


def is_openssh_key(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def is_pem_body(body: str) -> bool:
    """A key in base 64, or whole cipher blocks of one after headers that name a cipher and its starting value."""
    body = re.sub(r"\\[nr]", "\n", body)
    if m := ENCRYPTED.match(body):
        data, block = _decode64(re.sub(r"\s", "", m[3])), CIPHER_BLOCK.get(m[1][:3])
        return bool(data) and block is not None and len(m[2]) == 2 * block and len(data) % block == 0 and len(data) >= 32
    data = _decode64(re.sub(r"\s", "", body))
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def _json_object(part: str) -> dict | None:
    data = _decode64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def header_start(segment: str) -> int | None:
    """Where in the characters before the first dot a JSON header with an algorithm begins that ends with them."""
    read, texts = json.JSONDecoder().raw_decode, {}
    for m in HEADER.finditer(segment):
        at, phase = m.start(), m.start() % 4
        if phase not in texts:
            texts[phase] = (_decode64(segment[phase:]) or b"").decode("latin-1")
        begin = (at - phase) // 4 * 3
        if begin < len(texts[phase]):
            try:
                head, end = read(texts[phase], begin)
            except (ValueError, RecursionError):
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and not texts[phase][end:].strip():
                return at
    return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _json_object(header)
    if not head or not isinstance(head.get("alg"), str):
        return False
    return "enc" in head or _json_object(payload) is not None and (bool(signature) or head["alg"].lower() == "none")


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain matches."""
    runs = [m.span() for m in RUN.finditer(text)] if runs is None else runs
    low = text.lower()
    out = []
    if any(x in low for x in NAMES):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for s, e in runs for m in HEX.finditer(text, s, e)]
    return out


def streams(text: str, runs: list[tuple[int, int]], line: re.Pattern, tail: re.Pattern) -> Iterator[list[tuple[int, int]]]:
    """The lines of each stream, as places in the text."""
    parts: list[tuple[int, int]] = []

    def whole():
        last = tail.match(text, parts[-1][1])
        return [*parts, last.span(1)] if last else parts

    for s, e in runs:
        for m in line.finditer(text, s, e):
            if parts and not (m.start() - parts[-1][1] <= 64 and GAP.fullmatch(text, parts[-1][1], m.start())):
                yield whole()
                parts = []
            parts.append(m.span())
    if parts:
        yield whole()


def stream_spans(text: str, parts: list[tuple[int, int]], depth: int, hexadecimal: bool = False) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the keys in a stream, by its own lengths, and of what its bytes hold as text."""
    joined = "".join(text[s:e] for s, e in parts)
    starts = list(accumulate((e - s for s, e in parts), initial=0))
    # so many characters are so many bytes
    characters, size = (2, 1) if hexadecimal else (4, 3)
    joined = joined if hexadecimal else joined.replace("-", "+").replace("_", "/")

    def place(at: int) -> int:
        i = bisect_right(starts, at, hi=len(parts)) - 1
        return parts[i][0] + at - starts[i]

    def span(first: int, last: int, kind: str) -> tuple[int, str, int]:
        end = place(last - 1) + 1
        while not hexadecimal and text.startswith("=", end):
            end += 1
        return place(first), kind, end

    data = []
    for phase in range(characters):
        body = joined[phase:]
        if hexadecimal:
            data.append(bytes.fromhex(body[: len(body) // 2 * 2]))
        else:
            data.append(_decode64(body if len(body) % 4 != 1 else body[:-1]) or b"")
    out, done = [], 0
    for m in (HEAD_HEX if hexadecimal else HEAD64).finditer(joined):
        at, own = m.start(), data[m.start() % characters]
        if at >= done:
            begin = at // characters * size
            kind = "openssh" if own.startswith(OPENSSH_MAGIC, begin) else "der"
            if end := (openssh_end if kind == "openssh" else der_end)(own, begin):
                done = at + -(-(end - begin) * characters // size)
                out.append(span(at, done, kind))
    if depth < DEPTH:
        for phase, own in enumerate(data):
            inner = own.decode("latin-1")
            for s, kind, e in confirmed_spans(inner, [x.span() for x in RUN.finditer(inner)], depth + 1):
                first, last = phase + s * characters // size, phase + -(-e * characters // size)
                # the rest of a line's last characters, such as an encoded line end, is part of it
                line = starts[bisect_right(starts, last - 1, hi=len(parts))]
                out.append(span(first, line if line - last < characters else last, kind))
    return out


def confirmed_spans(text: str, runs: list[tuple[int, int]], depth: int = 0) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose bytes parse."""
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), "pem", m.end()) for m in PEM.finditer(text) if is_pem_body(m[2])]
    flat = text
    if "\\" in text:
        # written-out line ends become space of the same length
        flat = re.sub(r"\\[nrt]", "  ", text)
        runs = [m.span() for m in RUN.finditer(flat)]
    done = 0
    for s, e in runs:
        for m in SIGNED.finditer(flat, s, e):
            at = header_start(m[1]) if m.start() >= done else None
            if at is not None and is_signed_token(m[1][at:], m[2], m[3]):
                done = m.end(4)
                found.append((m.start() + at, "jwt", done))
    if runs:
        for kind in (STANDARD64, URL64, ANYHEX):
            for parts in streams(flat, runs, *kind):
                if kind is URL64 and not any(c in flat[s:e] for s, e in parts for c in "-_"):
                    continue
                if sum(e - s for s, e in parts) >= (64 if kind is ANYHEX else 40):
                    found += stream_spans(flat, parts, depth, kind is ANYHEX)
    if ":" in flat:
        for m in COLONS.finditer(flat):
            found += stream_spans(flat, [x.span() for x in BYTE.finditer(flat, *m.span())], depth, True)
    out, covered = [], -1
    for s, kind, e in sorted(set(found), key=lambda x: (x[0], -x[2], x[1] != "pem")):
        if kind == "pem":
            covered = max(covered, e)
        if kind in ("pem", "jwt") or e > covered:
            out.append((s, kind, e))
    return out


def find_secrets(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), both sorted by start, then kind as listed."""
    runs = [m.span() for m in RUN.finditer(text)]
    key = lambda x: (x[0], _ORDER[x[1]], x[2])
    base = sorted(base_spans(text, runs), key=key)
    return base, sorted(base + confirmed_spans(text, runs), key=key)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """text with each union of overlapping spans replaced by one mark that names the first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.upper()} REMOVED]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: counts of base kinds, digest of base spans, all spans, how many were confirmed."""
    narrow = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def scan(rows):
        out = {k: [] for k in ("id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
        for text in rows["text"]:
            base, spans = find_secrets(text)
            kinds = [k for _, k, _ in base]
            for k in BASE_KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_confirmed"].append(len(spans) - len(base))
        return out | {"id": rows["id"]}

    schema = f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return map_slices(narrow, scan, schema).withColumnRenamed("id", id_column)


def redact_secrets(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs, every row kept, with secrets in the text replaced by marks; the length column follows. A null text stays null."""
    out = with_text(docs, text_column, lambda t: redact(t, find_secrets(t)[1]))
    if length_column and length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.when(F.col(text_column).isNull(), F.col(length_column)).otherwise(F.length(text_column)).cast(kind))
    return out
