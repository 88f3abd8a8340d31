"""Derivatives of web captures: linked metadata and plain-text conversion records for each response.

A capture is a row (record_id, target_uri, date, http, payload). Each gives a `metadata` record (status and all headers
of the source's HTTP response, page title, language, charset, links: lines of name and value) and a `conversion` record
(the visible text), both with WARC-Refers-To naming the response, the source's URI and date, and SHA-1 digests in base
32. render() gives the bytes of any record, write_archives() puts them into gzip members, read_archives() reads such
files again.

A tag ends at the first > after it; what opens after a page's last > is text. So each page is read a fixed number of
times, whatever it holds.

Defined results: a null page is an empty one and still gets its records; a null URI, date or HTTP block leaves those
headers out; a null record id leaves refers-to out; record ids are name-based UUIDs of what the record refers to, so
reruns agree and repeated rows repeat their records; columns to carry may bear any name, one that a record has too is
returned as source_<name>; other columns of the input are ignored. Whole pages are converted, in bounded slices.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import map_slices, row_slices

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:salesprism:warc")
CAPTURED = "2024-01-01T00:00:00Z"
HIDDEN = r"script|style|noscript|template|svg|iframe"
#: Comments and hidden elements; one that isn't closed runs to the end of the page.
SKIPPED = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?A-Za-z][^>]*>")
SPACE, LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")
NAMED = re.compile(r"<(html|meta|title|a)\b([^>]*)>", re.I)
TITLE_END = re.compile(r"</title", re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(lang|charset|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SHORT_NAME = re.compile(r"[A-Za-z0-9_-]+")
#: Character references beyond any code point, which may have thousands of digits.
TOO_LARGE = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|0*[1-9][0-9]{7,});?")
RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, length long, headers string, content string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def resolved(text: str) -> str:
    """text without character references."""
    return html.unescape(TOO_LARGE.sub("�", text))


def without_hidden(page: str) -> str:
    """page with a space for each comment and hidden element."""
    end = page.rfind(">") + 1
    unclosed = page.rfind("<!--", end)  # a comment opens even where no > follows
    tail = page[end:] if unclosed < 0 else page[end : page.find("<!--", end)]
    shown = SKIPPED.sub(" ", page[:end])
    # what runs to the end of the part runs to the end of the page
    open_ended = [m for m in SKIPPED.finditer(page, 0, end) if m.end() == end and not m[0].endswith("-->") and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)] if tail else []
    return shown if open_ended else shown + tail


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, spaces folded, entities resolved."""
    shown = without_hidden(page)
    end = shown.rfind(">") + 1
    text = TAG.sub("", BREAK.sub("\n", shown[:end])) + shown[end:]
    return LINES.sub("\n", SPACE.sub(" ", resolved(text))).strip()


def page_fields(page: str) -> list[tuple[str, str]]:
    shown = without_hidden(page)
    first: dict[str, str] = {}
    links, titled = [], True
    for m in NAMED.finditer(shown, 0, shown.rfind(">") + 1):
        tag = m[1].lower()
        if tag == "title":
            if "title" not in first and titled:
                end = TITLE_END.search(shown, m.end())
                titled = end is not None  # without an end here there is none further on
                if end:
                    first["title"] = shown[m.end() : end.start()]
            continue
        wanted = {"html": "lang", "meta": "charset", "a": "href"}[tag]
        value = next((x[2] or x[3] or x[4] or "" for x in ATTRIBUTE.finditer(m[2]) if x[1].lower() == wanted), None)
        if value is None:
            continue
        if tag == "a":
            links.append(value)
        elif short := SHORT_NAME.match(value):
            first.setdefault("language" if tag == "html" else "charset", short[0])
    return [(k, one_line(resolved(first[k]))) for k in ("title", "language", "charset") if k in first] + [("outlink", one_line(resolved(x))) for x in links]


def source_headers(http: str | None) -> list[tuple[str, str]]:
    """The status line and every header of an HTTP response; a line that begins with a blank goes on with the one before."""
    head = re.split(r"\r?\n\r?\n", http or "", maxsplit=1)[0]
    lines = re.sub(r"\r?\n[ \t]+", " ", head).splitlines()
    out = [("http-status", lines[0])] if lines and lines[0].upper().startswith("HTTP/") else []
    for line in lines[len(out) :]:
        name, colon, value = line.partition(":")
        if colon and name.strip():
            out.append((f"http-header-{one_line(name).replace(' ', '-')}", value.strip()))
    return out


def header_lines(fields: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields if v is not None)


def make_record(kind: str, refers_to: str | None, uri: str | None, date: str | None, content_type: str, content: str, extra: list[tuple[str, str | None]] = (), record_id: str | None = None, payload: bytes | None = None) -> dict:
    data = content.encode("utf-8", "surrogatepass")
    own = {
        "record_id": record_id or record_name(kind, refers_to or "", uri or ""),
        "record_type": kind,
        "refers_to": refers_to,
        "target_uri": uri,
        "date": date,
        "content_type": content_type,
        "block_digest": digest(data),
        "payload_digest": digest(data if payload is None else payload),
        "length": len(data),
        "content": content,
    }
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own["record_id"]), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date), *extra]
    fields += [("WARC-Block-Digest", own["block_digest"]), ("WARC-Payload-Digest", own["payload_digest"]), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    return own | {"headers": header_lines(fields)}


def render(headers: str, content: str) -> bytes:
    return f"WARC/1.1\r\n{headers}\r\n".encode() + content.encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def derive(record_id: str | None, uri: str | None, date: str | None, http: str | None, payload: str | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = payload or ""
    source = digest(payload.encode("utf-8", "surrogatepass"))
    fields = [*source_headers(http), ("source-payload-digest", source), *page_fields(payload)]
    extra = [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    metadata = make_record("metadata", record_id, uri, date, "application/warc-fields", header_lines(fields), extra)
    text = plain_text(payload)
    return [metadata, make_record("conversion", record_id, uri, date, "text/plain; charset=utf-8", text, [*extra, ("WARC-Concurrent-To", metadata["record_id"]), ("WARC-Source-Payload-Digest", source)])]


def pages_as_responses(pages: DataFrame, date: str = CAPTURED) -> DataFrame:
    """Captures of a table (page_id, url, html), as a crawler would have stored them."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    key = F.concat_ws(chr(0), F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.sha1(F.coalesce("html", F.lit(""))))
    h = F.sha1(key)
    name = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), F.coalesce("html", F.lit("")).alias("payload"))


def build_derivatives(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response row; the columns in carry go along, as source_<name> where a record has that name itself."""
    names = ("record_id", "target_uri", "date", "http", "payload")
    narrow = responses.select(*[F.col(c).alias(f"own_{c}") for c in carry], *names)
    kept = [(f"own_{c}", narrow.schema[f"own_{c}"].dataType.simpleString()) for c in carry]
    fields = [x.split()[0] for x in RECORD.split(", ")]

    def build(rows):
        out = {k: [] for k in [*[c for c, _ in kept], *fields]}
        for i in range(len(rows["record_id"])):
            for record in derive(*[rows[n][i] for n in names]):
                for k in fields:
                    out[k].append(record[k])
                for c, _ in kept:
                    out[c].append(rows[c][i])
        return out

    schema = ", ".join([*[f"{c} {t}" for c, t in kept], RECORD])
    return map_slices(narrow, build, schema).withColumnsRenamed({f"own_{c}": f"source_{c}" if c in fields else c for c in carry})


def write_archives(records: DataFrame, path: str) -> None:
    """Records as gzip members, one file of members in each row of a binary Parquet column `archive`, one row for each slice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches):
            data = b"".join(gzip.compress(render(h, c), mtime=0) for h, c in zip(rows["headers"], rows["content"], strict=True))
            yield pa.RecordBatch.from_pydict({"archive": [data]}, schema=pa.schema([("archive", pa.binary())]))

    records.select("headers", "content").mapInArrow(pack, "archive binary").write.parquet(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; gzip or plain bytes."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        start, n = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + n]
        at = start + n


def read_archives(spark: SparkSession, path: str, column: str = "archive") -> DataFrame:
    """Records of files that write_archives() made, or of .warc and .warc.gz files."""
    archives = spark.read.format("binaryFile").load(path).select(F.col("content").alias(column)) if re.search(r"\.warc(\.gz)?$", path) else spark.read.parquet(path)
    wanted = (("record_id", "WARC-Record-ID"), ("record_type", "WARC-Type"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("content_type", "Content-Type"), ("block_digest", "WARC-Block-Digest"))

    def parse(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(parse_archive(data)) if data else []
                columns = {k: [h.get(n) for h, _ in found] for k, n in wanted} | {"block": [b for _, b in found]}
                yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([*[(k, pa.string()) for k, _ in wanted], ("block", pa.binary())]))

    return archives.select(column).mapInArrow(parse, ", ".join([*[f"{k} string" for k, _ in wanted], "block binary"]))
