"""Readable text of a rendered page: furniture removed, outermost text blocks kept.

A small tree over the standard tokenizer. Tags are closed only by their own end tag
(an unclosed ``<p>`` holds what follows it), as simple tree builders do.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Tags and names of the pages.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote".split())
NOISE_TAGS = frozenset("style script table".split())
NOISE_CLASSES = frozenset(
    "reference mw-editsection noprint ws-noexport ws-header pagenum ws-pagenum mw-empty-elt toc printfooter catlinks prp-page-qualityheader navbox ambox".split()
)
NOISE_IDS = frozenset("headerContainer toc".split())
LIST_NOISE = ("ol", "references")
ROOT_CLASS = "mw-parser-output"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "classes", "id", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = (attrs.get("class") or "").split()
        self.id = attrs.get("id") or ""

    def is_noise(self) -> bool:
        return self.tag in NOISE_TAGS or self.id in NOISE_IDS or any(c in NOISE_CLASSES for c in self.classes) or (self.tag == LIST_NOISE[0] and LIST_NOISE[1] in self.classes)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def _walk(node: Node):
    """All elements in document order, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _strings(node: Node) -> list[str]:
    """Text pieces in order; noise is skipped, ``<br>`` is a newline."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x is node or not x.is_noise():
            stack.extend(reversed(x.children))
    return out


def html_to_text(page: str | None) -> str:
    tree = parse(page or "")
    root = next((n for n in _walk(tree) if ROOT_CLASS in n.classes), tree)
    blocks, stack = [], list(reversed(root.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.is_noise():
            continue
        if x.tag in BLOCKS:
            text = "".join(_strings(x)).strip()
            if text:
                blocks.append(text)
        else:
            stack.extend(reversed(x.children))
    return "\n\n".join(blocks) if blocks else "\n".join(_strings(root))


def links(page: str | None) -> list[tuple[int, str, str, list[str]]]:
    """(position, href, title, classes) of the anchors with a href, in order."""
    found = [n for n in _walk(parse(page or "")) if n.tag == "a" and "href" in n.attrs]
    return [(i, n.attrs["href"], n.attrs.get("title", ""), n.classes) for i, n in enumerate(found)]


@pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else html_to_text(p))


_LINKS = T.ArrayType(T.StructType().add("pos", T.LongType()).add("href", T.StringType()).add("title", T.StringType()).add("classes", T.ArrayType(T.StringType())))


@pandas_udf(_LINKS)
def page_links(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [{"pos": i, "href": h, "title": t, "classes": c} for i, h, t, c in links(p)])
