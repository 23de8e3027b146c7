"""Main text of an HTML page by a tag-stack scan into blocks with text and link density.

One pass over the tags keeps a stack of open elements and collects the text of
each block (paragraph, list item, quotation, heading, cell) with the length of
its links. Blocks in elements that never hold an article's text are left out.
A block of enough words and few links is kept; a short one (a list item, a
quotation's line, a heading) goes with its neighbours: it stays if a kept block
of the same container stands right before or after it, or if it is part of an
``article`` or ``main`` element.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = set("p div li ul ol dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 section article main header footer nav aside table tr td th figure figcaption form body html address hr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head nav aside footer form button select textarea iframe svg object".split())
#: Names of parts beside the text, as whole words of a class or id.
BESIDE = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie menu newsletter promo related share sidebar social sponsored".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_LONGEST = 100_000


class _Scan(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, silent, in an article, container
        self.blocks: list[list] = []  # text pieces, link length, in an article, container
        self.containers = 0
        self.links = 0
        self._new_block()

    def _new_block(self) -> None:
        _, silent, inside, container = self.stack[-1] if self.stack else ("", False, False, 0)
        self.silent = silent
        self.blocks.append([[], 0, inside, container])

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1][0].append(" ")
        if tag in VOID:
            return
        closes = _CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        while self.stack and self.stack[-1][0] in closes:
            self._pop()
        _, silent, inside, container = self.stack[-1] if self.stack else ("", False, False, 0)
        names = {w for k, v in attrs if k in ("class", "id") and v for w in v.lower().replace("_", " ").replace("-", " ").split()}
        silent = silent or tag in SILENT or (tag == "header" and not inside) or (tag in BLOCKS and len(names & BESIDE) > 0 and tag not in ("body", "html", "article", "main")) or any(k == "hidden" for k, _ in attrs)
        if tag in ("div", "section", "article", "main", "ul", "ol", "blockquote", "table", "td"):
            self.containers += 1
            container = self.containers if tag in ("div", "section", "article", "main", "td") else container
        self.stack.append((tag, silent, inside or tag in ("article", "main"), container))
        self.links += tag == "a"
        if tag in BLOCKS or silent != self.silent:
            self._new_block()

    def _pop(self):
        tag = self.stack.pop()[0]
        self.links -= tag == "a"
        if tag in BLOCKS or tag in SILENT:
            self._new_block()

    def handle_endtag(self, tag):
        if any(open_[0] == tag for open_ in self.stack[-64:]):  # an end without a start is no end
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.silent:
            self.blocks[-1][0].append(data)
            if self.links:
                self.blocks[-1][1] += len(data.strip())


def main_text(html: str, least_words: int = 8, most_links: float = 0.34) -> list[str]:
    """The blocks of a page's text, in order; whole blocks up to 100 000 characters."""
    scan = _Scan()
    scan.feed(html)
    scan.close()
    found = []
    for pieces, links, inside, container in scan.blocks:
        text = " ".join("".join(pieces).split())
        if text:
            found.append((text, links <= most_links * len(text), inside, container))
    inside_any = any(ok and inside for _, ok, inside, _ in found)
    seeds = [ok and (inside or not inside_any) and len(text.split()) >= least_words for text, ok, inside, _ in found]
    out, used = [], 0
    for i, (text, ok, inside, container) in enumerate(found):
        beside = any(0 <= j < len(found) and seeds[j] and found[j][3] == container for j in (i - 1, i + 1))
        if ok and (seeds[i] or (inside and inside_any) or beside):
            used += len(text) + 1
            if used > _LONGEST + 1:
                break
            out.append(text)
    return out


def main_blocks(html: Column) -> Column:
    """Array of a page's text blocks; none for null."""

    @F.pandas_udf("array<string>")
    def scan(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages:
            yield part.map(lambda page: main_text(page) if page else [])

    return scan(html)
