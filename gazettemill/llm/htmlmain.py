"""Main text of pages by a site style tree.

Pages of one host are merged by style path (the chain of tags with their
classes and ids). Each path collects, over the host's different pages, how
varied its content and its presentation (the sequence of child tags) are, as
entropies to the base of the number of pages: 0 where all pages show the
same, 1 where all differ. A branch whose importance is below ``threshold`` on
a host with ``min_pages`` or more different pages is template and goes from
every page. Branches that are template by their meaning (menus, footers,
adverts, forms, reader comments and so on) go on any host. Text is taken from
the article or main region, or else from the whole body.

The host's statistics are counted with partial aggregates over (host, path,
content); exact copies of a page count once, so a large group of copies
doesn't make its article look like template. If pruning by importance left a
page without text, that page keeps its branches.

Null html counts as empty and gives an empty text; a null or odd url has the
empty host. Repeated rows are extracted each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: HTML element classes and words of template branches.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "summary"}
TEMPLATE_TAGS = set("script style noscript template head title nav header footer aside form button select option textarea iframe svg canvas object dialog menu label datalist fieldset".split())
TEMPLATE_ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
TEMPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "promotion recommendations recommended related rail share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc "
    "toolbar topbar widget widgets".split()
)
_KEEP_HEADS = {"html", "body", "article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "path", "parent", "template", "children")

    def __init__(self, tag, path, parent, template):
        self.tag, self.path, self.parent, self.template = tag, path, parent, template
        self.children: list = []  # nodes, and strings of text


def _named_template(tag: str, attributes: str) -> tuple[str, bool]:
    """The style of an element for its path, and whether its class, id or role names template."""
    if not attributes.strip():
        return tag, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    style, names = tag, []
    for key in ("class", "id"):
        if value := found.get(key):
            style += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value.strip())
            names += value.lower().replace("_", "-").split()
    if tag in _KEEP_HEADS:
        return style, False
    words = {w for name in names for w in _WORDS.findall(name)}
    return style, bool(words & TEMPLATE_WORDS) or found.get("role", "").lower() in TEMPLATE_ROLES or "hidden" in found


def parse(text: str) -> Node:
    """A lenient element tree: implied ends of p, li and table parts, stray end tags ignored."""
    root = Node("", "", None, False)
    here, at = root, 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            here.children.append(text[at:])
            break
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        ends = {"p"} if tag in CLOSES_P else set()
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}[tag] | {"p"}
        if ends:
            stop = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "blockquote", "nav", "aside", "footer", "header", "form"}
            node, last = here, None
            while node is not root and node.tag not in stop:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        style, named = _named_template(tag, m[3])
        node = Node(tag, f"{here.path}/{style}", here, named or tag in TEMPLATE_TAGS)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    return root


def _regions(node: Node) -> list[Node]:
    """The outermost article and main elements that aren't within template."""
    out: list[Node] = []
    todo = [node]
    while todo:
        n = todo.pop()
        if n.template:
            continue
        if n.tag in ("article", "main"):
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def _blocks(node: Node, noise: frozenset[int]) -> list[str]:
    """Text of the blocks below ``node``, white space joined."""
    out: list[str] = []
    current: list[str] = []

    def flush():
        if block := " ".join(htmllib.unescape("".join(current)).split()):
            out.append(block)
        current.clear()

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            current.append(n)
        elif not n.template and (not noise or _path_id(n.path) not in noise):
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            elif n.tag == "br":
                current.append(" ")
            todo += reversed(n.children)
    flush()
    return out


def main_text(page: str, noise: frozenset[int] = frozenset()) -> str:
    root = parse(page)
    regions = _regions(root) or [root]
    blocks = [b for r in regions for b in _blocks(r, noise)]
    if not blocks and noise:
        blocks = [b for r in regions for b in _blocks(r, frozenset())]
    return "\n".join(blocks)


def _path_id(path: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(path) - (1 << 63)


def _styles(page: str) -> list[tuple[int, int, int, int]]:
    """(page hash, path, content hash, presentation hash) of each style path in the page, template left out."""
    from xxhash import xxh64_intdigest

    content, looks = defaultdict(list), defaultdict(list)

    def collect(node: Node) -> str:
        """Children first, without recursion over deep pages."""
        stack: list = [(node, iter(node.children), [])]
        while True:
            n, rest, texts = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                whole = "".join(texts)
                content[n.path].append(whole)
                looks[n.path].append(",".join(c.tag for c in n.children if isinstance(c, Node)))
                if not stack:
                    return whole
                stack[-1][2].append(whole)
            elif isinstance(child, str):
                texts.append(child)
            elif not child.template:
                stack.append((child, iter(child.children), []))

    digest = lambda parts: xxh64_intdigest("\0".join(parts)) - (1 << 63)
    root = parse(page)
    body = digest([collect(region) for region in _regions(root) or [root]])
    return [(body, _path_id(p), digest(content[p]), digest(looks[p])) for p in content]


def host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def template_paths(pages: DataFrame, threshold: float = 0.2, min_pages: int = 10, content_share: float = 0.9) -> DataFrame:
    """(host, noise): the path ids whose importance is below the threshold on that host."""

    def styles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, *s) for h, page in zip(pdf["host"], pdf["html"]) for s in _styles(page)]
            yield pd.DataFrame(rows, columns=["host", "body", "path", "content", "looks"])

    texts = pages.select(host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    seen = texts.mapInPandas(styles, "host string, body long, path long, content long, looks long")
    once = common.cut(seen.distinct(), "styles")  # a row for each path of each different page

    def entropy(column: str) -> DataFrame:
        n = once.groupBy("host", "path", column).agg(F.count("*").alias("n"))
        both = n.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return both.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0).alias(f"{column}_entropy"))

    both = entropy("content").join(entropy("looks").drop("m"), ["host", "path"])
    importance = content_share * F.col("content_entropy") + (1 - content_share) * F.col("looks_entropy")
    low = both.where((F.col("m") >= min_pages) & (importance < threshold))
    return common.cut(low.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("noise")), "noise")


def extract(pages: DataFrame, **params) -> DataFrame:
    """(page_id, url, text) of every page."""
    common.small_batches(pages.sparkSession)
    noise = template_paths(pages, **params)
    joined = pages.select("page_id", "url", host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).join(noise, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(page, frozenset(n.tolist()) if n is not None else frozenset()) for page, n in zip(pdf["html"], pdf["noise"])]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pd.Series(pdf["url"].tolist(), dtype=object), "text": pd.Series(texts, dtype=object)})

    return joined.mapInPandas(run, "page_id long, url string, text string")
