"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A logistic classifier over text and
structure alone (words, links, punctuation, the element's share of the page; no
names of classes, no sectioning elements) gives log odds, which become each
block's capacity to the content or the boilerplate terminal. Edges between
neighbours on the page, and between a block and the last one under the same
parent, resist a different label the more the closer the two are in the document
tree. An element that says what it is (article, nav, a class name) is a node of
its own: what it says is its capacity to a terminal, and edges tie it to the blocks
in it. The minimum cut, found by maximum flow, labels all of a page at once, so a
page that says nothing about itself is labelled too.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classifier learns from at most so many pages, and of a longer page from its first so many characters.
SAMPLE_PAGES, SAMPLE_PAGE_CHARS = 300, 1 << 16
SMOOTHNESS = 0.8
MAX_LOG_ODDS = 4.0
#: Capacity of the edge between a block and the element that says what it is.
TIE = 12.0

RAW = frozenset("script style noscript template iframe svg title textarea select option canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var img wbr ruby rt rp".split()
)
IN_HEAD = frozenset("head html meta link base title script style noscript template".split())
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())

ARTICLE, NAV, HEADER, FOOTER, ASIDE, FORM, BOILER, COMMENTS, CONTENT, HIDDEN, HEAD = (1 << i for i in range(11))
TAG_FLAGS = {
    "article": ARTICLE, "main": ARTICLE, "nav": NAV, "menu": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE,
    "form": FORM, "button": FORM, "fieldset": FORM, "dialog": BOILER, "head": HEAD,
}
ROLE_FLAGS = {
    "main": ARTICLE, "article": ARTICLE, "navigation": NAV, "menu": NAV, "banner": HEADER, "contentinfo": FOOTER,
    "complementary": ASIDE, "search": FORM, "form": FORM, "dialog": BOILER, "alert": BOILER, "alertdialog": BOILER,
}
NEGATIVE = NAV | HEADER | FOOTER | ASIDE | FORM | BOILER | COMMENTS | HIDDEN
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDES = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
COMMENT_NAME = re.compile(r"comment|disqus|repl(?:y|ies)|respond|discussion")
BOILER_NAME = re.compile(
    r"sidebar|advert|sponsor|promo|banner|cookie|consent|gdpr|breadcrumb|newsletter|subscri|related|recommend|popup|modal|overlay|masthead|toolbar|topbar|paginat|copyright|disclaimer|navig|navbar|menu|footer|social|widget|notice|notification"
)
BOILER_TOKEN = frozenset("ad ads nav share sharing login signup signin search alert legal header pager tags author-box skip".split())
CONTENT_NAME = re.compile(r"article|content|story|entry|post-?body|body-?text|main")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")


class Node:
    """An open block element: parent, depth and inherited flags."""

    __slots__ = ("tag", "parent", "depth", "flags", "region", "last_block")

    def __init__(self, tag: str, parent: Node | None, flags: int):
        self.tag, self.parent, self.flags = tag, parent, flags
        self.depth = parent.depth + 1 if parent else 0
        # The nearest element, itself included, that says something new about what it holds.
        self.region = self if flags != (parent.flags if parent else 0) else parent.region if parent else None
        self.last_block = -1


class Block:
    """A run of text under one block element."""

    __slots__ = ("text", "node", "link_chars")

    def __init__(self, text: str, node: Node, link_chars: int):
        self.text, self.node, self.link_chars = text, node, link_chars


def own_flags(tag: str, attributes: str) -> int:
    flags = TAG_FLAGS.get(tag, 0)
    if not attributes or attributes.isspace():
        return flags
    if HIDES.search(attributes):
        flags |= HIDDEN
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            flags |= ROLE_FLAGS.get(value.strip(), 0)
            continue
        if COMMENT_NAME.search(value):
            flags |= COMMENTS
        elif BOILER_NAME.search(value) or not BOILER_TOKEN.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            flags |= BOILER
        elif CONTENT_NAME.search(value):
            flags |= CONTENT
    return flags


def parse(page: str) -> list[Block]:
    """The text blocks of a page in order; each part of the page is looked at once."""
    blocks: list[Block] = []
    root = Node("#root", None, 0)
    node, held, links, in_link = root, [], 0, False
    open_tags: dict[str, int] = {}
    end_of: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal held, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not node.flags & HEAD:
                blocks.append(Block(text, node, links))
            held, links = [], 0

    def close_until(tag: str) -> None:
        nonlocal node
        while node.parent is not None:
            gone = node
            open_tags[gone.tag] -= 1
            node = gone.parent
            if gone.tag == tag:
                break

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            piece = page[at:begin]
            held.append(piece)
            if in_link:
                links += len(piece)
        if begin == size:
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = size if stop < 0 else stop + 3
            continue
        m = TAG.match(page, begin) or LOOSE_TAG.match(page, begin)
        if m is None:
            if page[begin + 1 : begin + 2] in ("!", "?"):
                stop = page.find(">", begin)
                at = size if stop < 0 else stop + 1
            else:  # a bare < is text
                held.append("<")
                at = begin + 1
            continue
        at = m.end()
        closing, tag, attributes = bool(m.group(1)), m.group(2).lower(), m.group(3)
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = end_of.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>?", re.I)).search(page, at)
                at = end.end() if end else size
            if tag not in INLINE and tag != "option":
                held.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        if node.flags & HEAD and tag not in IN_HEAD and not closing:
            flush()
            close_until("head")
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if tag in VOID or tag in RAW or tag in ("html", "body"):
            continue
        if closing:
            if open_tags.get(tag):
                close_until(tag)
            continue
        if tag in CLOSES_SELF and node.tag == tag:
            close_until(tag)
        elif node.tag == "p":  # a block element ends the paragraph
            close_until("p")
        flags = own_flags(tag, attributes)
        if flags & HEADER and node.flags & ARTICLE:
            flags &= ~HEADER
        node = Node(tag, node, node.flags | flags)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if attributes.endswith("/"):
            close_until(tag)
    flush()
    return blocks


#: Where learning starts, and what it is drawn to: log odds of content for each feature of ``features``.
PRIOR = np.array([-0.6, -3.0, 0.6, 0.6, 0.5, 0.8, -0.4, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])
#: Log odds of content, a block, in an element with the mark; any mark of boilerplate outweighs those of content.
CONTENT_ODDS = {ARTICLE: 7.0, CONTENT: 1.5}
BOILER_ODDS = {NAV: -7.0, HEADER: -5.0, FOOTER: -6.0, ASIDE: -7.0, FORM: -7.0, BOILER: -7.0, COMMENTS: -8.0, HIDDEN: -8.0}


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block of what its text and its place in the tree look like; nothing that names the block's kind."""
    page = sum(len(b.text) for b in blocks)
    holders: dict[int, list[int]] = {}
    for b in blocks:
        of = holders.setdefault(id(b.node.parent or b.node), [0, 0, 0])
        of[0] += 1
        of[1] += len(b.text)
        of[2] += b.text.count(" ") + 1
    rows = []
    for i, b in enumerate(blocks):
        text, tag = b.text, b.node.tag
        words = text.count(" ") + 1
        count, chars, held = holders[id(b.node.parent or b.node)]
        place = (i + 0.5) / len(blocks)
        rows.append([
            1.0,
            min(1.0, b.link_chars / len(text)),
            min(6.0, float(np.log1p(words))),
            float(text[-1] in ".!?\"'…"),
            float(tag in ("h1", "h2", "h3")),
            float(tag in ("p", "blockquote", "pre", "td")),
            float(tag == "li"),
            min(4.0, float(np.log1p(count))),
            chars / page,
            min(6.0, float(np.log1p(held / count))),
            min(1.0, (text.count(".") + text.count(",")) / words),
            min(b.node.depth, 12) / 12,
            4 * place * (1 - place),
        ])
    return np.asarray(rows).reshape(len(blocks), len(PRIOR))


def region_odds(flags: int) -> float:
    """What an element says of itself by its marks, per block that it holds."""
    if flags & NEGATIVE:
        return max(-8.0, sum(w for f, w in BOILER_ODDS.items() if flags & f))
    return min(8.0, sum(w for f, w in CONTENT_ODDS.items() if flags & f))


def distance(a: Node, b: Node, most: int = 6) -> int:
    """Steps between two elements of the tree, ``most`` at most."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the next one under the same parent."""
    out: dict[tuple[int, int], float] = {}
    for i, block in enumerate(blocks):
        if i:
            out[i - 1, i] = SMOOTHNESS / (1 + distance(blocks[i - 1].node, block.node))
        holder = block.node.parent or block.node
        if 0 <= holder.last_block < i:
            pair = (holder.last_block, i)
            out[pair] = out.get(pair, 0.0) + SMOOTHNESS / 2
        holder.last_block = i
    return [(i, j, w) for (i, j), w in out.items()]


def graph(blocks: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal log odds and edges: the blocks of a page first, then the elements that say what they are."""
    odds = np.clip(features(blocks) @ weights, -MAX_LOG_ODDS, MAX_LOG_ODDS).tolist()
    edges = edges_of(blocks)
    place: dict[int, int] = {}
    for i, block in enumerate(blocks):
        region = block.node.region
        if region is None:
            continue
        j = place.setdefault(id(region), len(odds))
        if j == len(odds):
            odds.append(0.0)
        odds[j] += region_odds(region.flags)
        edges.append((i, j, TIE))
    return odds, edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut; ties are boilerplate.

    A node whose terminal outweighs all its undecided edges is decided at once and its
    edges move to the neighbours' terminals, which leaves the cut as it is. What
    remains is solved by maximum flow: what the flow's sources still reach is content.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    terminal, load = list(odds), [sum(e.values()) for e in near]
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None or abs(terminal[i]) <= load[i] + 1e-9:
            continue
        label[i] = terminal[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            load[j] -= w
            terminal[j] += w if label[i] else -w
            waiting.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    reached = maximum_flow({i: max(0.0, terminal[i]) for i in left}, {i: max(0.0, -terminal[i]) for i in left}, near)
    return [i in reached if x is None else bool(x) for i, x in enumerate(label)]


def maximum_flow(supply: dict[int, float], drain: dict[int, float], flow: list[dict[int, float]]) -> dict[int, int]:
    """Send all that can flow from the supplies to the drains; what is reached from supplies that still have some.

    ``flow`` holds what each edge can still take and is changed. In each phase nodes get levels, their
    distance from a supply, and paths go from level to level until none is left; an edge that has been
    found useless is not looked at again in that phase.
    """
    least = 1e-12
    while True:
        level = {i: 0 for i, s in supply.items() if s > least}
        queue, ends = deque(level), False
        while queue:
            i = queue.popleft()
            ends = ends or drain[i] > least
            for j, w in flow[i].items():
                if w > least and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return level
        onward = {i: iter([j for j, w in flow[i].items() if w > least and level[j] == level[i] + 1]) for i in level}
        at: dict[int, int | None] = {i: next(onward[i], None) for i in level}
        for source in [i for i, d in level.items() if d == 0]:
            path = [source]
            while path and supply[source] > least:
                i = path[-1]
                if drain[i] > least:
                    steps = list(zip(path, path[1:], strict=False))
                    push = min([supply[source], drain[i], *[flow[a][b] for a, b in steps]])
                    supply[source] -= push
                    drain[i] -= push
                    full = len(path) - 1
                    for k in range(len(steps) - 1, -1, -1):
                        a, b = steps[k]
                        flow[a][b] -= push
                        flow[b][a] += push
                        if flow[a][b] <= least:
                            at[a] = next(onward[a], None)
                            full = k
                    del path[full + 1 :]
                elif at[i] is not None:
                    path.append(at[i])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] = next(onward[path[-1]], None)


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = parse(page)
    if not blocks:
        return ""
    keep = minimum_cut(*graph(blocks, weights))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=False) if k)


def learned_blocks(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and kind (1 content) of the blocks whose elements say what they are: inside an article and no mark of boilerplate, or the other way round."""
    blocks = parse(page)
    good, bad = [np.array([bool(b.node.flags & f) for b in blocks], dtype=bool) for f in (ARTICLE, NEGATIVE)]
    return features(blocks)[good != bad], good[good != bad].astype(np.float64)


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> np.ndarray:
    """Weights of the text features by logistic regression, drawn to PRIOR, on the blocks of a bounded sample that say what they are.

    Sampled are SAMPLE_PAGES ids in hash order; a page counts with its first SAMPLE_PAGE_CHARS characters.
    """
    known = pages.where((F.octet_length(html) > 0) & F.col(page_id).isNotNull())
    first = known.select(page_id).distinct().orderBy(F.xxhash64(page_id), page_id).limit(SAMPLE_PAGES)
    # Of rows that repeat an id the least page, so that the bound holds for rows as well.
    rows = known.join(F.broadcast(first), page_id).groupBy(page_id).agg(F.min(F.substring(html, 1, SAMPLE_PAGE_CHARS))).collect()
    seen = [learned_blocks(page) for _, page in sorted((r[0], r[1]) for r in rows)]
    w = PRIOR.copy()
    if not sum(len(y) for _, y in seen):
        return w
    xs, ys, pull = np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen]), 2.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        grad = xs.T @ (p - ys) + pull * (w - PRIOR)
        w = w - np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + pull * np.eye(len(w)), grad)
    return w


def text_column(html: Column, weights: np.ndarray) -> Column:
    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, weights) if p else "" for p in column.to_pylist()], pa.string())

    return extracted.asNondeterministic()(html)


def extract_main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Every input row with text (empty if the page has none) and n_chars, its code points.

    A null or empty html has no text; equal pages have equal texts; with no page to
    learn from the prior weights serve. Columns of these names are replaced, all
    others pass through.
    """
    weights = fit(pages, html, page_id)
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    found = pages.select(*rest, text_column(F.col(html), weights).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
