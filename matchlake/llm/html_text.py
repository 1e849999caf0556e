"""Main text of web pages: flat text blocks with word count and link density of the block and its neighbours, classified
by a decision tree that is trained on a small labelled table."""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element names of the HTML standard by the role they play here, and usual class names of page furniture.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math", "canvas"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
FURNITURE = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie",
             "cookies", "gdpr", "legal", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
             "pagination", "popup", "promo", "promotion", "recommended", "related", "share", "sharing", "sidebar", "social",
             "sponsor", "sponsored", "subscribe", "toolbar", "widget", "alert", "complementary", "contentinfo", "overlay"}
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond", "discussion"}
ENDS_P = {"p", "div", "article", "section", "nav", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "footer", "aside", "form", "blockquote", "pre", "main", "figure", "dl", "address", "hr", "fieldset", "details"}

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "article", "has_article", "furniture",
            "footer", "form", "reader")
# The labelled table: judged blocks by shape (words and share of words in links, of the block and its neighbours; 1 for
# main text where no mark decides), each seen under every judged surrounding (marks as in FEATURES; None: shape decides).
SHAPES = [
    (60, 0.0, 220, 0.0, 80, 0.0, 1), (9, 0.0, 90, 0.0, 60, 0.0, 1), (35, 0.1, 400, 0.0, 70, 0.0, 1), (120, 0.05, 70, 0.0, 9, 0.2, 1),
    (75, 0.0, 75, 0.0, 30, 1.0, 1), (33, 0.0, 6, 0.0, 36, 0.0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 1), (300, 0.0, 5, 0.0, 7, 0.3, 1),
    (12, 0.0, 81, 0.0, 40, 0.0, 1), (40, 0.3, 3, 0.5, 60, 0.0, 1), (8, 0.0, 12, 0.0, 95, 0.0, 1), (26, 0.0, 1, 1.0, 50, 0.0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 6, 0.0, 0), (6, 0.8, 1, 1.0, 9, 0.9, 0), (14, 0.7, 5, 0.0, 70, 0.0, 0),
    (4, 1.0, 70, 0.0, 50, 0.0, 0), (2, 0.0, 300, 0.0, 7, 0.3, 0), (3, 0.0, 1, 0.0, 2, 0.0, 0), (30, 0.9, 60, 0.0, 0, 0.0, 0),
]
SURROUNDINGS = [  # article, has_article, furniture, footer, form, reader
    ((1, 1, 0, 0, 0, 0), 1), ((0, 1, 0, 0, 0, 0), None), ((0, 0, 0, 0, 0, 0), None), ((0, 1, 1, 0, 0, 0), 0), ((0, 1, 0, 1, 0, 0), 0),
    ((1, 1, 1, 0, 0, 0), 0), ((1, 1, 0, 1, 0, 0), 0), ((1, 1, 0, 0, 1, 0), 0), ((1, 1, 0, 0, 0, 1), 0), ((0, 0, 1, 0, 0, 0), 0),
    ((0, 0, 0, 1, 0, 0), 0), ((0, 0, 0, 0, 1, 0), 0), ((0, 0, 0, 0, 0, 1), 0),
]
LABELLED = [(*shape[:-1], *marks, shape[-1] if main is None else main) for shape in SHAPES for marks, main in SURROUNDINGS]


def grow(rows: list[tuple], depth: int = 8):
    """Decision tree (Gini): a number at leaves (share of main text), else (feature, cut, below, above)."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in reversed(range(len(FEATURES))):   # marks win ties
        values = sorted({r[f] for r in rows})
        for cut in ((a + b) / 2 for a, b in zip(values, values[1:])):
            sides = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            cost = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in sides)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, sides)
    if best is None:
        return share
    _, f, cut, (low, high) = best
    return f, cut, grow(low, depth - 1), grow(high, depth - 1)


def decide(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def marks(name: str, attributes: str, in_article: bool) -> set[str]:
    """What an element says about the text below it."""
    out = set()
    if name in ("article", "main"):
        out.add("article")
    if name in ("nav", "aside", "menu", "dialog") or name == "header" and not in_article:
        out.add("furniture")
    if name == "footer":
        out.add("footer")
    if name in ("form", "button", "select", "fieldset"):
        out.add("form")
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[1] or m[2] or m[3] or "").lower()
            if {"article", "main"} & set(value.split()):  # whole names only: main-menu or article-teaser are no main text
                out.add("article")
            for word in re.split(r"[\s_\-]+", value):
                if word in FURNITURE or word == "header" and not in_article and name != "h1":
                    out.add("furniture")
                elif word == "footer":
                    out.add("footer")
                elif word in READERS:
                    out.add("reader")
    return out


def blocks(page: str) -> list[dict]:
    """Flat text blocks in page order: text, words, words in links, and the marks of the elements around them."""
    out: list[dict] = []
    parts: list[str] = []
    stack: list[tuple[str, set]] = []
    now, linked, in_link, at = set(), 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append({"text": text, "words": len(text.split()), "linked": linked, "marks": frozenset(now)})
        parts.clear()
        linked = 0

    def text_until(end: int):
        nonlocal linked
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece.split())

    while m := TOKEN.search(page, at):
        text_until(m.start())
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):  # what is inside is no markup: go on at its own closing tag
                end = RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            if name in ENDS_P and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if not m[3].endswith("/"):
                stack.append((name, marks(name, m[3], any("article" in s for _, s in stack))))
        now = set().union(*(s for _, s in stack)) if stack else set()
        in_link = 0
    text_until(len(page))
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    """The blocks that the tree takes for main text, one per line; empty for NULL, empty or markup-only pages."""
    if not page:
        return ""
    found = blocks(page)
    has = int(any("article" in b["marks"] and not b["marks"] & {"furniture", "footer", "form", "reader"} for b in found))
    shape = [(0, 0.0)] + [(b["words"], min(1.0, b["linked"] / b["words"])) for b in found] + [(0, 0.0)]
    kept = []
    for i, b in enumerate(found, 1):
        m = b["marks"]
        row = (*shape[i], *shape[i - 1], *shape[i + 1], int("article" in m), has,
               *(int(k in m) for k in ("furniture", "footer", "form", "reader")))
        if decide(tree, row):
            kept.append(b["text"])
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, the whole html read; repeated rows give repeated results."""
    tree = grow(LABELLED)

    def extract(batches):
        for b in batches:
            text = pa.array([main_text(h.as_py(), tree) for h in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn(
        "n_chars", F.char_length("text").cast("long"))
