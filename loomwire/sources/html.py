"""Main text of landed HTML pages: a boundary that replaces fetching."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that never hold the story, and where it is looked for, in order.
DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "figure"}
PLACES = (("tag", "article"), ("tag", "main"), ("itemprop", "articleBody"), ("class", "entry-content"), ("class", "article-content"), ("class", "post-content"), ("id", "content"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Texts(HTMLParser):
    """Texts of the body and of each place, in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[int]]] = []
        self.dropped = self.in_body = 0
        self.depth = [0] * len(PLACES)
        self.texts: list[list[str]] = [[] for _ in PLACES]
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        has = dict(attrs)
        at = [i for i, (kind, v) in enumerate(PLACES) if (tag == v if kind == "tag" else v in (has.get("class") or "").split() if kind == "class" else has.get(kind) == v)]
        self.open.append((tag, at))
        self.dropped += tag in DROPPED
        self.in_body += tag == "body"
        for i in at:
            self.depth[i] += 1

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            t, at = self.open.pop()
            self.dropped -= t in DROPPED
            self.in_body -= t == "body"
            for i in at:
                self.depth[i] -= 1
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or self.dropped:
            return
        if self.in_body:
            self.body.append(text)
        for i, d in enumerate(self.depth):
            if d:
                self.texts[i].append(text)


def main_text(html: str | None, least: int = 200) -> str:
    """The first place with enough text, else the body."""
    if not html:
        return ""
    p = _Texts()
    p.feed(html)
    p.close()
    found = ("\n".join(t) for t in p.texts)
    return next((t for t in found if len(t) >= least), "\n".join(p.body))


def with_main_text(pages: DataFrame, least: int = 200) -> DataFrame:
    """page_id, url and the main text of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([main_text(x.as_py(), least) for x in b.column("html")], pa.string())], ["page_id", "url", "body"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, body string")
