"""Main text of web pages by tag-path ratios.

A page is read in one pass as a list of text blocks, each with the path of block
tags (and their classes) from the root.  For each path of a page the text length
without links, the punctuation and the number of tags are added up.  Text-to-tag
and punctuation ratios are smoothed over neighbouring paths of one parent and
fused; tags and class words that name something else weigh a path down, and so
does a path's share of links.  Paths at or above a part of the page's own level
are content, and their blocks are the text.

A content path carries what belongs to it: headings the block they stand over,
lists, tables and quotes the flow they stand in, and an article or main element
with most of the content everything inside it, if no tag or class word there
weighs it down.  As weights are compared within the page, a class word on a
wrapper around the whole content changes nothing.

Defined results: a null page is empty; a page without content gives an empty
text; unclosed and truncated markup is read as far as it goes, in time linear in
the page (a quote that is never closed ends with its tag); repeated rows are
separate rows; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REST = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?+|<"
#: Nothing here goes back over what it has read.  "odd" is a tag with a quote that is never closed; from there on quotes are not heeded, so that no later tag looks for their end again.
_TOKEN = re.compile(rf"[^<]++|</?+[A-Za-z][A-Za-z0-9:-]*+>|</?+[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|(?P<odd></?+[A-Za-z][^>]*+(?:>|\Z))|{_REST}", re.DOTALL)
_PLAIN = re.compile(rf"[^<]++|</?+[A-Za-z][^>]*+(?:>|\Z)|{_REST}", re.DOTALL)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_MARKED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.IGNORECASE)
_POINTS = ".,;:!?"
_WORDS = re.compile(r"[A-Za-z]+")

#: Elements whose content is data or not shown.
RAW = frozenset("script style noscript template svg annotation iframe canvas textarea select option title head".split())
#: Those of them whose content is text, not markup.
RAW_TEXT = ("script", "style", "noscript", "iframe", "textarea", "title")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in RAW_TEXT}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msubsup msup mtext q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Tags that hold no article, and one that seldom does.
ASIDE_TAGS = frozenset("nav header footer aside button menu dialog".split())
FORM_WEIGHT = 0.01
#: Words of class, id and role that name what is not the article; they weigh by their share of a name.
ASIDE_WORDS = frozenset(
    """ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies dialog disclaimer
    discussion disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion
    related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets""".split()
)
#: A name with one of these says that something else has or lacks the thing.
ABOUT = frozenset("has have is no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Leaves that belong to the flow of text around them.
FLOW = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre address summary".split())


def named_weight(words: list[str]) -> float:
    """How much a class, id or role of these words weighs its element down."""
    share = sum(w in ASIDE_WORDS for w in words) / len(words)
    if not share or ABOUT.intersection(words):
        return 1.0
    return 0.03 if share == 1 else 0.1 if share >= 0.5 else 0.6


#: Elements nested deeper than this stand beside each other at that depth.
DEPTH = 256


class Block:
    __slots__ = ("path", "text", "tags", "linked", "links", "aside", "weight", "nodes", "weights", "article")

    def __init__(self, path, nodes, weights, aside, article):
        self.path, self.nodes, self.weights, self.aside, self.article = path, nodes, weights, aside, article
        self.weight = weights[-1]
        self.text: list[str] = []
        self.tags, self.linked, self.links = 1, 0, 0


class Node:
    """An open element: ``nodes`` number it and its ancestors, ``weights`` are the products of their weights; ``article`` numbers the outermost article and main."""

    __slots__ = ("tag", "path", "aside", "nodes", "weights", "article")

    def __init__(self, tag, path, aside, nodes, weights, article):
        self.tag, self.path, self.aside, self.nodes, self.weights, self.article = tag, path, aside, nodes, weights, article


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order. Inline tags do not start one."""
    blocks: list[Block] = []
    stack = [Node("", "", False, (0,), (1.0,), (0, 0))]
    made, current, links, skip, rules = 0, None, 0, "", _TOKEN
    opened: dict[str, int] = defaultdict(int)

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    tokens = rules.finditer(html)
    while (m := next(tokens, None)) is not None:
        token = m[0]
        if token[0] != "<" or token == "<":
            if skip:
                continue
            if current is None:
                top = stack[-1]
                current = Block(top.path, top.nodes, top.weights, top.aside, top.article)
                blocks.append(current)
            current.text.append(token)
            if links:
                current.linked += len(token)
            continue
        if rules is _TOKEN and m.lastgroup:
            rules = _PLAIN
            tokens = rules.finditer(html, m.end())
        closing = token[1:2] == "/"
        name = token[2:-1] if closing else token[1:-1]
        if not name.isalnum() or token[-1] != ">":
            named = _NAME.match(token)
            if not named:
                continue
            name = named[1]
        tag = name.lower()
        if skip:
            if closing and tag == skip:
                skip = ""
            continue
        if tag in RAW and not closing:
            # nothing inside counts; "head" ends at "body" too, in case it is never closed
            if not token.endswith("/>") and tag != "head":
                skip = tag
                if tag in RAW_TEXT:  # a '<' in it opens no tag; only its own end tag ends it
                    end = _ENDS[tag].search(html, m.end())
                    tokens = rules.finditer(html, end.start() if end else len(html))
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
                if current is not None:
                    current.links += links
            if current is not None:
                current.tags += 1
            continue
        if tag == "br" or tag in VOID:
            if current is not None:
                current.text.append(" " if tag != "wbr" else "")
                current.tags += 1
            continue
        current, links = None, 0
        if closing:
            if opened[tag]:
                close(max(k for k in range(len(stack)) if stack[k].tag == tag))
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("button", "td", "th", "table"):
                    break
        elif tag in ITEMS:
            ends, within = ITEMS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends.split():
                    close(k)
                    break
                if stack[k].tag in within:
                    break
        if len(stack) > DEPTH:
            close(len(stack) - 1)
        top, weight, words = stack[-1], FORM_WEIGHT if tag == "form" else 1.0, []
        for mark in _MARKED.findall(token) if " " in token or "\n" in token else ():
            for name in mark.strip("\"'").split():
                if parts := [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]:
                    words += parts
                    if tag not in ("html", "body", "main", "article"):
                        weight = min(weight, named_weight(parts))
        made += 1
        path = f"{top.path}/{tag}.{'.'.join(sorted(set(words)))}" if words else f"{top.path}/{tag}"
        aside = top.aside or tag in ASIDE_TAGS and not (tag == "header" and any(top.article))
        article, main = top.article
        opened[tag] += 1
        stack.append(Node(tag, path, aside, (*top.nodes, made), (*top.weights, top.weights[-1] * weight), (article or made * (tag == "article"), main or made * (tag == "main"))))
    return blocks


def path_levels(blocks: list[Block], texts: list[str], *, side: float = 1 / 16) -> dict[str, float]:
    """For each path, in page order, its smoothed and fused ratios under its weight."""
    chars: dict[str, int] = defaultdict(int)
    points: dict[str, int] = defaultdict(int)
    tags: dict[str, int] = defaultdict(int)
    weight: dict[str, float] = {}
    for b, text in zip(blocks, texts):
        weight.setdefault(b.path, b.weight)
        tags[b.path] += b.tags
        chars[b.path] += max(0, len(text) - b.linked)
        points[b.path] += sum(map(text.count, _POINTS))
    paths = list(weight)
    above = [p.rpartition("/")[0] for p in paths]

    def smooth(x: list[float]) -> list[float]:
        """With the paths before and after, if they have the same parent."""
        out = []
        for k, v in enumerate(x):
            near = [x[j] for j in (k - 1, k + 1) if 0 <= j < len(x) and above[j] == above[k]]
            out.append(v + side * (sum(near) - len(near) * v))
        return out

    by_text = smooth([chars[p] / tags[p] for p in paths])
    by_points = smooth([points[p] / tags[p] for p in paths])
    return {p: a * (1 + b) * weight[p] for p, a, b in zip(paths, by_text, by_points)}


def content_paths(blocks: list[Block], texts: list[str], *, threshold: float = 0.3) -> set[str]:
    """Paths that reach ``threshold`` times the level at which the page's text stands: the mean of levels, weighted by text and level."""
    level = path_levels(blocks, texts)
    total = sum(level[b.path] * len(t) for b, t in zip(blocks, texts))
    if not total:
        return set()
    mean = sum(level[b.path] ** 2 * len(t) for b, t in zip(blocks, texts)) / total
    return {p for p, v in level.items() if v > 0 and v >= threshold * mean}


def main_text(html: str | None) -> str:
    """Blocks of the article joined by a line feed, white space inside a block turned into one space."""
    if not html:
        return ""
    kept = [(b, t) for b in blocks_of(html) if not b.aside and (t := " ".join(unescape("".join(b.text)).split()))]
    if not kept:
        return ""
    blocks, texts = [b for b, _ in kept], [t for _, t in kept]
    content = content_paths(blocks, texts)
    # The deepest node that holds nearly all the text of the content paths; an article or main element if one holds most of it.
    held: dict[int, float] = defaultdict(float)
    depth: dict[int, int] = {}
    own: dict[int, float] = {}
    total = 0.0
    for b, t in zip(blocks, texts):
        for k, n in enumerate(b.nodes):
            own[n], depth[n] = b.weights[k], k
        if b.path in content:
            total += len(t) * b.weight
            for n in b.nodes:
                held[n] += len(t) * b.weight
    if not total:
        return ""
    root = max((n for n in held if held[n] >= 0.9 * total), key=lambda n: depth[n], default=0)
    # a lone leaf is not an article by itself if it has siblings of its kind
    leaf = [b for b in blocks if b.nodes[-1] == root]
    if leaf and len(leaf[0].nodes) > 1 and _leaf_tag(leaf[0]) in FLOW:
        root = leaf[0].nodes[-2]
    named = 0
    for which in (0, 1):
        found = {b.article[which] for b in blocks if b.article[which]}
        best = max(found, key=lambda n: (held[n], -n), default=0)
        if best and held[best] >= 0.5 * total:
            named = root = best
            break
    if not named and own[root] < 1 and len([b for b in blocks if root in b.nodes]) < 2:
        return ""  # one block under a word for something else, and nothing beside it
    links: dict[str, int] = defaultdict(int)
    linked: dict[str, int] = defaultdict(int)
    size: dict[str, int] = defaultdict(int)
    for b, t in zip(blocks, texts):
        links[b.path] += b.links
        linked[b.path] += b.linked
        size[b.path] += len(t)
    inside = [(b, t) for b, t in zip(blocks, texts) if root in b.nodes]
    out: list[str] = []
    follows = False  # whether the next block that is no heading is in
    for b, t in reversed(inside):
        tag = _leaf_tag(b)
        ok = b.path in content
        if not ok and b.weight >= 0.5 * own[root]:  # no name below the root is mostly one for something else
            listed = links[b.path] >= 3 and linked[b.path] > 0.8 * size[b.path]
            if named:
                ok = not listed or tag == "p"
            elif tag in HEADINGS:
                ok = follows
            elif tag in FLOW:
                ok = linked[b.path] <= 0.5 * size[b.path]
        if ok:
            out.append(t)
        if tag not in HEADINGS:
            follows = ok
    return "\n".join(reversed(out))


def _leaf_tag(b: Block) -> str:
    return b.path.rpartition("/")[2].split(".")[0]


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points)."""
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]

    @F.pandas_udf(T.StringType())
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    out = pages.select(*(pages[f.name] for f in kept), text_of(pages[html_col]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
