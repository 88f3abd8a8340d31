"""Derivatives against the standard library's HTML parser, hostile pages, nulls, headers and clashing names."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from salesprism.llm import warc as W


class Plain(HTMLParser):
    """A slow reading of well-formed pages: text outside hidden elements, links, title, language."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text, self.links, self.titles, self.in_title, self.lang = 0, [], [], [], False, None

    def handle_starttag(self, tag, attributes):
        own = dict(attributes)
        self.hidden += tag in W.HIDDEN.split("|")
        self.in_title = tag == "title"
        if tag == "a" and "href" in own and not self.hidden:
            self.links.append(own["href"])
        if tag == "html":
            self.lang = own.get("lang")

    def handle_endtag(self, tag):
        self.hidden -= tag in W.HIDDEN.split("|")
        self.in_title = False

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.in_title:
                self.titles.append(data)


def test_text_and_fields_equal_a_parser():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "b&amp;c", "&lt;d&gt;", "é", "x&#233;", "12", "end."])
    for _ in range(200):
        parts = [f'<html lang="{rng.choice(["de", "en-GB"])}"><title>{word()} t</title>']
        for _ in range(rng.randint(0, 12)):
            body = " ".join(word() for _ in range(rng.randint(1, 4)))
            parts.append(rng.choice([f"<p class='x y'>{body}</p>", f'<a class="q" href="/{rng.randrange(99)}?a=1&amp;b=2">{body}</a>', f"<script>{rng.randrange(9)} < b</script>", f"<!-- {body} -->", f"<style>p > a</style><b>{body}</b>", f" {body} <br/>"]))
        page = "".join(parts)
        slow = Plain()
        slow.feed(page)
        slow.close()
        fields = W.page_fields(page)
        assert [v for k, v in fields if k == "outlink"] == slow.links
        assert dict(fields)["title"] == " ".join("".join(slow.titles).split()) and dict(fields)["language"] == slow.lang
        assert "".join(W.plain_text(page).split()) == "".join("".join(slow.text).split())


def test_hostile_pages_take_linear_time():
    for part in ("<a ", "<html ", "<title>", "<meta charset ", "<script ", "<!-- ", "&#9", "<a href='", '<a href="', "</script ", " \n", "<p <"):
        began = time.perf_counter()
        page = part * (1_000_000 // len(part))
        W.page_fields(page)
        W.plain_text(page)
        W.plain_text("x>" + page)
        assert time.perf_counter() - began < 5, part
    assert W.plain_text("a &#" + "9" * 6000 + "; b &#x" + "f" * 5000 + "; c") == "a � b � c"


def test_what_opens_after_the_last_tag_is_text():
    assert W.plain_text("<p>a</p> 1 < 2") == "a\n1 < 2" and W.plain_text("<p>a</p> b <!-- c") == "a\nb"
    assert W.plain_text("<p>a<script>b c") == "a" and W.plain_text("a <b") == "a <b"


def test_source_headers_and_nulls(spark):
    http = "HTTP/1.1 301 Moved\r\nContent-Type: text/html\r\nServer: x: y\r\nX-Long: a\r\n  b\r\nbroken\r\n\r\nbody: no"
    rows = [("<r1>", "http://a", "2020", http, "<p>x", "k", "t"), (None, None, None, None, None, None, None), ("<r1>", "http://a", "2020", http, "<p>x", "k", "t")]
    table = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http string, payload string, headers string, extra string")
    out = W.build_derivatives(table, carry=("headers", "extra", "record_id")).collect()
    assert len(out) == 6 and {"source_headers", "extra", "source_record_id", "headers", "record_id"} <= set(out[0].asDict())
    meta = next(r for r in out if r["record_type"] == "metadata" and r["extra"] == "t")
    lines = meta["content"].split("\r\n")
    assert lines[:4] == ["http-status: HTTP/1.1 301 Moved", "http-header-Content-Type: text/html", "http-header-Server: x: y", "http-header-X-Long: a b"] and "body" not in meta["content"]
    assert meta["source_headers"] == "k" and meta["refers_to"] == "<r1>" == meta["source_record_id"]
    bare = [r for r in out if r["extra"] is None]
    assert len(bare) == 2 and all(r["refers_to"] is None and "WARC-Refers-To" not in r["headers"] for r in bare)
    assert W.build_derivatives(table.where(F.lit(False)), carry=("extra",)).count() == 0
