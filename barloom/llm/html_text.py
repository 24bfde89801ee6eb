"""Operator 6: main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element kinds, and words in class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas nav header footer aside button select textarea dialog menu title".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option"}),
}
# Words that name what isn't the article, and words that may stand beside them in such a name.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup popups modal "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer footers header masthead comment comments commentlist disqus respond replies share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup widget widgets pagination pager toolbar skip legal copyright".split()
)
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right side inner outer box bar block list item items section area container wrapper wrap panel slot unit group row col column links link posts post "
    "articles stories news buttons button icons form text message policy thread reader user users to a the and us box1 box2 banner ad1 ad2 ad3".split()
)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)?""")
SPACE = re.compile(r"\s+")


def named_otherwise(names: str) -> bool:
    """Whether a class, id or role has a name made of words for what isn't the article and of words that go with them."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not NOT_ARTICLE.isdisjoint(words) and all(w in NOT_ARTICLE or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag from its name's end on, where the tag ends (after its >, or with the page), and whether it closes itself.
    The first of each name counts."""
    out: dict[str, str] = {}
    slash = True
    while at < len(page):
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if not m[1]:
            return out, at + 1, slash and page[at - 1] == "/"
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        slash = not (m[4] or "").endswith("/")  # else the slash is the value's
    return out, at, False


class _Node:
    __slots__ = ("tag", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum", "kids", "last", "doubtful")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.kids: list[_Node] = []
        self.last = 0
        self.doubtful = False


class _Open:
    """The open elements, innermost last, with the places of each tag and of the blocks among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []

    def push(self, tag: str, node: int) -> None:
        k = len(self.stack)
        self.stack.append((tag, node))
        self.of.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in WALLS:
            self.walls.append(k)

    def cut(self, k: int) -> bool:
        """Close all from place k on; whether a block was among them."""
        for tag, _ in self.stack[k:]:
            self.of[tag].pop()
        del self.stack[k:]
        block = False
        for places in (self.blocks, self.walls):
            while places and places[-1] >= k:
                places.pop()
                block = True
        return block


#: An end tag of an inline element doesn't close these.
WALLS = frozenset("td th table article section div main".split())


def _parse(page: str) -> tuple[list[_Node], list[tuple[int, str]]]:
    """Nodes in page order, and items (node number, text) with "" for the edge of a block. Dropped elements leave nothing.

    Forms and elements with a name that articles don't have are doubtful: _settle keeps or drops them. The page is passed once.
    """
    nodes = [_Node("body", None)]
    items: list[tuple[int, str]] = []
    opened = _Open()
    opened.push("body", 0)  # -1: inside a dropped element
    stack, at, end, text = opened.stack, 0, len(page), 0

    def told(upto: int) -> None:
        if upto > text and stack[-1][1] >= 0:
            items.append((stack[-1][1], html.unescape(page[text:upto])))

    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        if page.startswith(("<!", "<?"), start):
            told(start)
            mark = "-->" if page.startswith("<!--", start) else ">"
            close = page.find(mark, start + 2)
            at = text = close + len(mark) if close >= 0 else end
            continue
        m = NAME.match(page, start)
        if not m:
            at = start + 1
            continue
        told(start)
        tag = m[1].lower()
        attrs, at, closed = attributes(page, m.end())
        text = at
        if page[start + 1] == "/":
            places = opened.of.get(tag)
            if tag == "p" and not places and stack[-1][1] >= 0:
                items.append((stack[-1][1], ""))
            if places and places[-1] > 0 and (tag in BLOCKS or not opened.walls or opened.walls[-1] < places[-1]):
                block = opened.cut(places[-1])
                if block and stack[-1][1] >= 0:
                    items.append((stack[-1][1], ""))
            continue
        if tag in ("html", "body"):
            continue
        if tag != "head" and len(stack) > 1 and stack[1][0] == "head" and (tag in BLOCKS or tag in ("a", "span")):
            opened.cut(1)
        block = opened.blocks[-1]
        if tag in CLOSED_BY.get(stack[block][0], ()):
            opened.cut(block)
        elif tag == "option" and opened.of.get("option") and opened.of["option"][-1] > block:
            opened.cut(opened.of["option"][-1])
        inside = stack[-1][1]
        dropped = inside < 0 or tag in DROPPED
        doubtful = tag == "form"
        if not dropped and attrs and tag not in ("article", "main"):
            style = "".join(attrs.get("style", "").lower().split())
            dropped = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style
            doubtful |= any(named_otherwise(attrs[a]) for a in ("class", "id", "role", "aria-label") if a in attrs)
        if inside >= 0 and tag in BLOCKS:
            items.append((inside, ""))
        if tag == "br" and inside >= 0:
            items.append((inside, " "))
        if tag in RAW and not closed:
            shut = _closing(tag).search(page, at)
            at = text = shut.end() if shut else end
            continue
        if tag in VOID or closed and tag not in BLOCKS:
            if not dropped and not doubtful:
                nodes[inside].tags += 1
            continue
        if dropped:
            opened.push(tag, -1)
        else:
            node = _Node(tag, nodes[inside])
            node.doubtful = doubtful
            nodes[inside].kids.append(node)
            opened.push(tag, len(nodes))
            nodes.append(node)
    told(end)
    return nodes, items


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _settle(nodes: list[_Node], items: list[tuple[int, str]]) -> tuple[list[_Node], list[tuple[int, str]]]:
    """Nodes and items without those doubtful nodes that don't hold the article, by characters outside links.

    The largest are settled first. One that holds article or main stays, unless others that stand in no doubtful node, or in one
    that stays, hold over twice as much. Any other stays if it holds the greater part of the page and over four times as much as they.
    """
    if not any(n.doubtful for n in nodes):
        return nodes, items
    number = {id(n): k for k, n in enumerate(nodes)}
    above = [number[id(n.parent)] if n.parent else -1 for n in nodes]
    linked, inside = [False] * len(nodes), [False] * len(nodes)
    nearest = [-1] * len(nodes)
    for k, n in enumerate(nodes):
        up = above[k]
        linked[k] = n.tag == "a" or up >= 0 and linked[up]
        inside[k] = n.tag in ("article", "main") or up >= 0 and inside[up]
        nearest[k] = k if n.doubtful else nearest[up] if up >= 0 else -1
    size, article, direct = [0] * len(nodes), [0] * len(nodes), {-1: 0}
    for k, text in items:
        if not linked[k]:
            chars = len(SPACE.sub("", text))
            size[k] += chars
            if inside[k]:
                direct[nearest[k]] = direct.get(nearest[k], 0) + chars
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].tag in ("article", "main"):
            article[k] = size[k]
        if above[k] >= 0:
            size[above[k]] += size[k]
            article[above[k]] += article[k]
    most, stays = direct[-1], set()
    for k in sorted((k for k, n in enumerate(nodes) if n.doubtful), key=lambda k: (-article[k], -size[k], k)):
        outer = nearest[above[k]]
        if outer >= 0 and outer not in stays:
            continue
        if article[k] and 2 * article[k] >= most or 2 * size[k] > size[0] and size[k] > 4 * most:
            stays.add(k)
            most = max(most, direct.get(k, 0))
    to, left = [-1] * len(nodes), []
    for k, n in enumerate(nodes):
        if (above[k] < 0 or to[above[k]] >= 0) and (not n.doubtful or k in stays):
            to[k] = len(left)
            left.append(n)
    for n in left:
        n.kids = [x for x in n.kids if to[number[id(x)]] >= 0]
    return left, [(to[k], text) for k, text in items if to[k] >= 0]


def _weigh(nodes: list[_Node], items: list[tuple[int, str]]) -> None:
    """Composite text density of every node: characters for each tag, lowered where links take a large part of either.

    The sum of a node adds up the densities of its children; inline elements stand for their own children there, since their text is
    their parents'.
    """
    for k, text in items:
        nodes[k].chars += len(SPACE.sub("", text))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        n.last = max(k, n.last)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.parent:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
            p.last = max(p.last, n.last)
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
            n.density = c / t * math.log(max(1.0 + 1e-9, c / lc * t / lt)) / math.log(max(base, 1.0) + 1.0)
    for n in reversed(nodes):
        if n.parent:
            n.parent.sum += n.density if n.tag in BLOCKS else n.sum


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by line feeds; empty if there is none.

    The node with the greatest sum of densities is where the article is densest, and the least density on the path from there to the
    body is the threshold: every branch that reaches it counts as content, by its own node of the greatest sum. The article is the
    smallest node around the densest one that holds four fifths of the content. Of equal sums the one with more text counts, and
    article or main before others.
    """
    if not page:
        return ""
    nodes, items = _settle(*_parse(page))
    _weigh(nodes, items)
    rank = [(n.sum, n.chars, n.tag in ("article", "main"), -k) for k, n in enumerate(nodes)]
    number = {id(n): k for k, n in enumerate(nodes)}
    best = list(range(len(nodes)))  # in each node's subtree
    for k in range(len(nodes) - 1, 0, -1):
        up = number[id(nodes[k].parent)]
        if rank[best[k]] > rank[best[up]]:
            best[up] = best[k]
    path = [nodes[best[0]]]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    content = bytearray(len(nodes))
    waiting = [0]
    while waiting:
        k = waiting.pop()
        n = nodes[k]
        if content[k] or n.density < threshold or not n.chars:
            continue
        top = best[k] if nodes[best[k]].sum else k
        if not content[top]:
            last = nodes[top].last
            content[top : last + 1] = b"\1" * (last + 1 - top)
        if not content[k]:
            waiting.extend(number[id(x)] for x in n.kids)
    held = [0] * len(nodes)
    for k, text in items:
        held[k] += len(SPACE.sub("", text)) if content[k] else 0
    for k in range(len(nodes) - 1, 0, -1):
        held[number[id(nodes[k].parent)]] += held[k]
    root = next(number[id(n)] for n in path if 5 * held[number[id(n)]] >= 4 * held[0])
    blocks, parts = [], []
    for k, text in [*items, (0, "")]:
        if text == "":
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif root <= k <= nodes[root].last:
            parts.append(text)
    return "\n".join(b for b in (SPACE.sub(" ", x).strip() for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row. Null or empty html gives empty text; nulls in other columns stay; repeated rows have
    equal results, an empty table gives no row, and more columns are ignored, whatever their names. A page is parsed in one pass, so
    that long ones and bad ones take time in proportion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                s = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in s.column("html")]
                yield pa.RecordBatch.from_arrays([s.column("page_id"), s.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
