"""The main part of a page: the block with the most running text that is not links.

A page is read as a tree of elements. Each paragraph gives points to what holds it, and half of them to what holds that:
one, one more for each comma, and up to three for its length. Names of classes and ids that speak for or against main text add or take some.
A block's points are lessened by the share of its text that stands in links. The best block wins, with those beside it that come near; its text passes
the same clean-up as any article, and counts only if it is long enough and no code.

One page is one row: the tree is built and dropped inside a batch."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import article as article_text
from glossa.functions import text as X
from glossa.operators.ingest import _VOID, BLOCKS, DROPPED, NOISE

#: Parts of names that speak for main text, parts that speak against it, and elements that are no main text.
FOR, AGAINST = ("article", "body", "content", "entry", "main", "post", "story", "text"), ("ad-", "banner", "comment", "cookie", "footer", "header", "menu", "nav", "promo", "related", "reply", "sponsor", "subscribe", "tags", "teaser", "widget")
SIDE = DROPPED | {"button", "footer", "form", "head", "noscript", "script", "select", "style", "template", "title"}
PARAGRAPHS, LEAST_PARAGRAPH = {"p", "pre", "blockquote", "td"}, 25
#: Points of a name, and what a block beside the best one must have: points of its own, or a share of the best one's.
NAME, BESIDE, SHARE = 25.0, 10.0, 0.2


class Node:
    __slots__ = ("tag", "side", "parts", "up", "points", "chars", "linked", "named")

    def __init__(self, tag: str, up: Node | None, side: bool, named: float):
        self.tag, self.up, self.side, self.named, self.parts, self.points, self.chars, self.linked = tag, up, side, named, [], 0.0, 0, 0

    def text(self) -> str:
        """The text in reading order, without side matter; two line ends behind each block."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif not x.side:
                if x.tag in BLOCKS:
                    todo.append("\n\n")
                todo += reversed(x.parts)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", None, False, 0.0)
        self.nodes: list[Node] = []

    def handle_starttag(self, tag, attrs):
        # What may be left open is closed by the next of its kind.
        if tag in ("p", "li", "td", "tr", "dt", "dd") or tag in BLOCKS and self.at.tag == "p" and tag != "br":
            self._close({"td": "td", "tr": "tr"}.get(tag, tag if tag in ("li", "dt", "dd") else "p"), {"td": "tr", "tr": "table", "li": "ul"}.get(tag))
        name = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        bad = any(n in name for n in AGAINST)
        node = Node(tag, self.at, tag in SIDE or any(n in name for n in NOISE), -NAME * bad + NAME * (not bad and any(n in name for n in FOR)))
        self.at.parts.append(node)
        if tag not in _VOID:
            self.nodes.append(node)
            self.at = node

    def _close(self, tag: str, within: str | None) -> None:
        x = self.at
        while x.up is not None and x.tag != tag and (x.tag not in BLOCKS or x.tag == "p") and x.tag != within:
            x = x.up
        if x.tag == tag and x.up is not None:
            self.at = x.up

    def handle_endtag(self, tag):
        x = self.at
        while x.up is not None and x.tag != tag:
            x = x.up
        if x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        self.at.parts.append(data)


def main_part(html: str) -> str | None:
    """The text of the main part of a page; None without a paragraph."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    # Children come after their parents in the list, so sums go up from its end.
    for x in reversed(tree.nodes):
        if x.side:
            continue
        own = sum(len(p.strip()) for p in x.parts if isinstance(p, str))
        own += sum(p.chars for p in x.parts if isinstance(p, Node) and p.tag not in BLOCKS)
        x.chars = own + sum(p.chars for p in x.parts if isinstance(p, Node) and p.tag in BLOCKS)
        x.linked = x.chars if x.tag == "a" else sum(p.linked for p in x.parts if isinstance(p, Node))
        if own >= LEAST_PARAGRAPH and (x.tag in PARAGRAPHS or x.tag in BLOCKS):
            commas = sum(p.count(",") if isinstance(p, str) else p.text().count(",") for p in x.parts if isinstance(p, str) or p.tag not in BLOCKS)
            points = (1 + commas + min(own / 100, 3.0)) * (1 - x.linked / max(1, x.chars))
            holder = x.up if x.tag in PARAGRAPHS else x  # a block with text of its own holds it itself
            holder.points += points
            if holder.up is not None:
                holder.up.points += points / 2
    final = lambda x: (x.points + x.named) * (1 - x.linked / max(1, x.chars)) if x.points > 0 and not x.side else 0.0
    inner = [x for x in [tree.root, *tree.nodes] if final(x) > 0 and x.tag not in ("p", "html")]
    tree.root.chars = max(tree.root.chars, 1)
    if not inner:
        return None
    best = max(inner, key=final)
    if best.up is None:
        return best.text()
    least = max(BESIDE, SHARE * final(best))
    beside = [x for x in best.up.parts if isinstance(x, Node) and not x.side]
    near = lambda x: x is best or x.named >= 0 and (final(x) >= least or x.tag == "p" and x.chars > 80 and x.linked < x.chars / 4)
    return "\n\n".join(x.text() for x in beside if near(x))


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(lambda s: None if s is None else main_part(s))


def main_articles(pages: DataFrame, html: str = "html", name: str = "article") -> DataFrame:
    """pages with the cleaned text of their main part; null where that is too short or looks like code, and for pages without any or that are null."""
    found = article_text.cleaned(pages.withColumn(name, main_text(X.strip_noise(F.col(html)))), name)
    return found.withColumn(name, F.when(~X.code_like(F.col(name)), F.col(name)))
