"""Main text of pages whose shapes say little, and of the given pages by an independent reading of their article element."""

from __future__ import annotations

import os
from html.parser import HTMLParser

import pytest

from heapstone.llm import html_extract

PAGES = "/root/testdata/sf0.01/pages.parquet"
PARAGRAPHS = [f"Paragraph number {k} tells a story about the river and the old town that nobody wanted to leave behind." for k in range(6)]
P, TEXT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), " ".join(PARAGRAPHS)


def article(inner):
    return f'<html><head><title>x</title></head><body><nav><a href="/">Home</a> <a href="/b">About</a></nav><article>{inner}</article><footer>Copyright 2020 all rights reserved</footer></body></html>'


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


@pytest.mark.parametrize(
    ("page", "more"),
    [
        (article(P), ""), (article(f'<div style="overflow:hidden">{P}</div>'), ""), (article(f'<div style="display:block;border:none">{P}</div>'), ""), (article(f'<div style="color:red">{P}</div>'), ""), (f"<div>{P}</div>", ""), (TEXT, ""), (f"<html><body>{TEXT}</body></html>", ""),
        (f"<html><body>{P}</body></html>", ""), ("<html><body>" + "".join(f"<div>{p}</div>" for p in PARAGRAPHS) + "</body></html>", ""), (article(f'{P}<div style="display: none"><p>Secret words here.</p></div>'), ""), (article(f"{P}<div hidden><p>Secret words here.</p></div>"), ""),
        (article(f'<p style="color:red; VISIBILITY : hidden">Secret words here now.</p>{P}'), ""), (article(P + "<pre>x = 1 and more code here</pre>"), " x = 1 and more code here"), (article(P + "<dl><dt>Term one</dt><dd>What the term means in this article</dd></dl>"), " Term one What the term means in this article"),
        (article(P + "<figure><figcaption>A river in the old town</figcaption></figure>"), " A river in the old town"), (article(P + "<p>Short.</p>"), " Short."),
    ],
)
def test_text_of_pages_of_any_shape(model, page, more):
    assert html_extract.main_texts(model, [page]) == [TEXT + more]


@pytest.mark.parametrize(("style", "hides"), [("display:none", True), ("DISPLAY : none !important", True), ("visibility:hidden;", True), ("overflow:hidden", False), ("display:block;border:none", False), ("display:none;display:block", False), ("", False), ("content:'display:none", False)])
def test_only_display_and_visibility_hide(style, hides):
    assert html_extract._hides(style) is hides


class Article(HTMLParser):
    """The text in the article element, without what stands in it and isn't part of it."""

    APART = {"aside", "nav", "form", "script", "style", "button", "footer"}
    NAMES = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "share", "social", "related", "newsletter", "cookie", "notice", "comments", "comment", "widget", "tags", "sidebar", "banner"}

    def __init__(self):
        super().__init__()
        self.inside, self.apart, self.open, self.text = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            self.text.append(" ")
            return
        named = {w for k, v in attrs if k in ("class", "id") for w in (v or "").split()}
        self.inside += tag == "article"
        self.apart += bool(self.apart) or tag in self.APART or bool(named & self.NAMES)
        self.open.append(tag)
        self.text.append(" " if tag not in html_extract.INLINE else "")

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.inside -= last == "article"
                self.apart -= bool(self.apart)
                if last == tag:
                    break
        self.text.append(" " if tag not in html_extract.INLINE else "")

    def handle_data(self, data):
        if self.inside > 0 and not self.apart:
            self.text.append(data)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="needs the given pages")
def test_given_pages_by_their_article_element(spark):
    rows = spark.read.parquet(PAGES).select("page_id", "html").where("html LIKE '%<article%</article>%'").collect()
    found = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.read.parquet(PAGES)).collect()}
    equal = 0
    for r in rows:
        reader = Article()
        reader.feed(r["html"])
        want = " ".join("".join(reader.text).split())
        equal += want == " ".join(found[r["page_id"]].split())
    assert len(rows) > 50 and equal >= 0.98 * len(rows), f"{equal} of {len(rows)}"
