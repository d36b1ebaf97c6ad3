"""Result blocks of search pages (X4): link, title and snippet of every hit, in the three page layouts.

Pages are tokenised by the standard HTML tokenizer (any quoting, nested and unclosed tags) with
a stack of open elements, inside an Arrow batch function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pyarrow as pa

# ---------------------------------------------------------------------------
# The class of a result block per layout (priority order) and HTML's tag rules.
# ---------------------------------------------------------------------------
LAYOUTS = ["result", "b_algo", "g"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ROW = "layout string, pos long, link string, title string, snippet string"
SNIPPET_MAX = 500


class Element:
    """An element with its attributes and, in order, its child elements and texts."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.classes = set((attrs.get("class") or "").split())

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        stack = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(p for p in reversed(e.parts) if isinstance(p, Element))

    def text(self, joint: str = "") -> str:
        """Texts below the element, each stripped, the empty ones left out."""
        out, stack = [], list(reversed(self.parts))
        while stack:
            p = stack.pop()
            if isinstance(p, Element):
                if p.tag not in ("script", "style"):
                    stack.extend(reversed(p.parts))
            elif p.strip():
                out.append(p.strip())
        return joint.join(out)

    def first(self, tag: str | None = None, cls: str | None = None, href: bool = False) -> Element | None:
        return next((e for e in self.walk() if (tag is None or e.tag == tag) and (cls is None or cls in e.classes)
                     and (not href or "href" in e.attrs)), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self._close("li", {"ul", "ol"})
        elif tag in CLOSES_P:
            self._close("p", {"div", "td", "li", "article", "section"})
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        self.open[-1].parts.append(data)

    def _close(self, tag: str, bounds: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in bounds:
                return


def tree(page: str) -> Element:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def _query_value(link: str) -> str:
    try:
        return parse_qs(urlparse(link).query).get("q", [link])[0]
    except ValueError:
        return link


def _hit(layout: str, e: Element) -> tuple[str, str, str] | None:
    """(link, title, snippet) of a result block, None where a part is missing."""
    if layout == "result":
        head = next((a for t in e.walk() if "result__title" in t.classes for a in [t.first("a")] if a), None)
        if head is None:
            return None
        link = head.attrs.get("href", "")
        wrapped = re.search("uddg=([^&]+)", link)
        below = e.first(cls="result__snippet")
        return (unquote(wrapped[1]) if wrapped else link, head.text(), below.text() if below else "")
    head = e.first("a", href=True)
    if head is None:
        return None
    link = head.attrs["href"]
    if layout == "b_algo":
        below = next((p for c in e.walk() if "b_caption" in c.classes for p in [c.first("p")] if p), None)
        return link, head.text(), below.text() if below else ""
    h3 = e.first("h3")
    if h3 is None:
        return None
    title, full = h3.text(), e.text(" ")
    snippet = full.split(title, 1)[-1].strip()[:SNIPPET_MAX] if title and title in full else ""
    return _query_value(link) if link.startswith("/url?") else link, title, snippet


def hits(page: str | None) -> Iterator[tuple[str, int, str, str, str]]:
    """(layout, pos, link, title, snippet) of the result blocks of a page; only http links; in the second and third
    layout a link counts once."""
    place = dict.fromkeys(LAYOUTS, 0)
    seen: dict[str, set] = {k: set() for k in LAYOUTS}
    tags = {"result": None, "b_algo": "li", "g": "div"}
    for e in tree(page or "").walk():
        for layout in LAYOUTS:
            if layout in e.classes and tags[layout] in (None, e.tag):
                hit = _hit(layout, e)
                if hit and hit[0].startswith("http") and (layout == "result" or hit[0] not in seen[layout]):
                    seen[layout].add(hit[0])
                    yield (layout, place[layout], *hit)
                    place[layout] += 1


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (html, id) -> id and ROW of each result block."""
    for batch in batches:
        at, rows = [], []
        for i, page in enumerate(batch.column(0).to_pylist()):
            for r in hits(page):
                at.append(i)
                rows.append(r)
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=[batch.schema.names[1], *[f.split(" ")[0] for f in ROW.split(", ")]])
