"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive and tags negative, with weights
learnt from labelled pages (pages that mark their content with ``article`` or ``main``): the log
odds of a feature, inside against outside the content. A word's feature is its block's element,
whether the block is mostly links, and, on a page with marks, whether it stands inside them; for
pages without, the labelled pages are counted once more with their marks hidden. A linear scan
(Kadane) finds the best contiguous region, from a word to a word; its blocks are the main text,
on every page. Elements that never are article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; by element
name or by whole class and id names) are left out before the scan, with their tags, so a region
spans them at no cost; so is text between the marked parts of a page. Where a page's only article or main stands inside an element left out by a
layout class, the article counts.

Defined results: null or empty HTML, and pages without a positive region, give the empty text.
Markup may be broken: a ``<`` that starts no tag is text, unclosed elements end with their
parent. Character references are decoded; white space inside a block becomes one space; blocks
are joined in page order by one newline. Nothing else is dropped or capped.

Time grows with the length of a page, whatever its markup: a tag's end is looked for beyond the next
``>`` only until one quoted attribute runs to the end of the page, and what is open is indexed by name.

Scale: one map over the pages, no shuffle; weights come from a bounded sample of ``sample`` pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE = 400
#: Counts of a feature that weigh as much as what is assumed of it unseen.
PRIOR = 100
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag whose attributes may hold a quoted ``>``.
_REST = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
#: Elements whose content is no text, up to their end tag.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea title iframe svg math select object".split()}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("nav header footer aside form menu button dialog head label fieldset".split())
#: Elements by which pages mark their content.
MARKS = ("article", "main")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "option"))
#: Class and id words of page furniture; article or main inside such an element may still be the text.
_LAYOUT = frozenset("banner cookie cookies consent gdpr notice popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer share sharing social newsletter subscribe signup login search widget toolbar skip".split())
#: Class and id words of foreign texts, which have articles of their own.
_FOREIGN = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus respond replies reply related recommended".split())
#: Words that stand beside them in a name and leave its meaning.
_PARTS = frozenset("area bar block body bottom box btn button buttons center container form global google group heading icon icons inner item items left link links list mobile module outer page panel popular post posts primary reader right row secondary section site slot static sticky sub text title top unit user view wrap wrapper".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_WHITE = re.compile(r"\s+")


def _furniture(value: str) -> int:
    """1 if a whole name of a class or id says layout, 2 if one says foreign text; names like no-sidebar say neither."""
    found = 0
    for token in value.lower().split():
        pieces = [x for x in re.split(r"[_-]+", token) if x and not x[0].isdigit()]
        if all(x in _LAYOUT or x in _FOREIGN or x in _PARTS for x in pieces):
            found = max(found, 2 if any(x in _FOREIGN for x in pieces) else int(any(x in _LAYOUT for x in pieces)))
    return found


def _left_out(name: str, attributes: str) -> int:
    """2: never article text; 1: by a class or id of the layout alone; 0: may be article text."""
    if name in SKIPPED:
        return 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I) or key == "role" and value.lower() in _ROLES:
            return 2
        if key in ("class", "id"):
            found = max(found, _furniture(value))
    return found


class Block:
    """A run of text between block tags: its words, the tags met since the block before, its marks."""

    __slots__ = ("text", "tags", "feature", "content", "skipped", "words")

    def __init__(self, text: str, tags: list[str], feature: str, content: bool, skipped: bool):
        self.text, self.tags, self.feature, self.content, self.skipped = text, tags, feature, content, skipped
        self.words = text.count(" ") + 1 if text else 0


def _tags(page: str):
    """(text before, closing, name, attributes) of every tag, and the text after the last with an empty name."""
    last = at = 0
    final, quoted = page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end, closing, name, attributes = len(page) if end < 0 else end + 3, "", "", ""
        elif at > final:  # no tag ends any more
            break
        elif page[at + 1] in "!?":
            end, closing, name, attributes = page.find(">", at) + 1, "", "", ""
        elif m := _NAME.match(page, at):
            closing, name = m[1], m[2].lower()
            rest = _REST.match(page, m.end()) if quoted else None
            quoted = rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            attributes = page[m.end() : end - 1]
            if name in _RAW and not closing:
                stop = _RAW[name].search(page, end)
                end, name = stop.end() if stop else len(page), ""
        else:
            at += 1
            continue
        yield page[last:at], closing, name, attributes
        last = at = end
    yield page[last:], "", "", ""


class _Open:
    """The open elements, (name, left out, content, article in a layout element), with their places by name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple[str, int, bool, bool]) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def depth(self, name: str) -> int:
        """The innermost open element of a name; -1 without."""
        return self.places[name][-1] if self.places.get(name) else -1

    @property
    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def top(self) -> tuple[str, int, bool, bool]:
        return self.stack[-1] if self.stack else ("", 0, False, False)


def read_blocks(page: str, *, hide: bool = False) -> list[Block]:
    """The page's blocks in order; ``content``: inside article or main; ``skipped``: never article text. ``hide``: marks count as plain div."""
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    tags: tuple[list[str], list[str]] = ([], [])  # of elements that may be text, of those left out
    inside_layout: list[Block] = []
    linked = [0, 0]  # letters in links, letters

    def flush() -> None:
        text = _WHITE.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            name = opened.stack[opened.block][0] if opened.block >= 0 else "body"
            _, level, content, inside = opened.top()
            own = tags[level > 0]
            out.append(Block(text, own.copy(), f"{'div' if hide and name in MARKS else name}{':linked' if 2 * linked[0] > linked[1] else ''}", content, level > 0))
            if inside and level == 1:
                inside_layout.append(out[-1])
            own.clear()
        linked[0] = linked[1] = 0

    for raw, closing, name, attributes in _tags(page):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked[1] += len(text)
            if opened.depth("a") >= 0:
                linked[0] += len(text)
        if not name:
            continue
        shown = "div" if hide and name in MARKS else name
        if closing:
            depth = opened.depth(name)
            if name in BLOCKS:
                flush()
                tags[bool(opened.stack) and opened.stack[depth][1] > 0].append("/" + shown)
            if depth >= 0 and (name in BLOCKS or opened.block < depth):
                opened.cut(depth)
            continue
        if name in BLOCKS:
            flush()
            while opened.stack and (opened.top()[0] not in BLOCKS or opened.top()[0] == "p" or opened.top()[0] == name and name in CLOSED_BY_BLOCK):
                opened.cut(len(opened.stack) - 1)
            if name in ("article", "main", "body", "footer"):
                while opened.stack and opened.top()[0] in CLOSED_BY_BLOCK:
                    opened.cut(len(opened.stack) - 1)
        elif name == "br":
            pieces.append(" ")
        _, level, content, inside = opened.top()
        if name not in VOID and not attributes.rstrip().endswith("/"):
            own = _left_out(name, attributes)
            inside = inside or level == 1 and name in MARKS
            level = 2 if own and inside else max(level, own)
            opened.push((name, level, content or name in MARKS, inside))
        if name in BLOCKS:
            tags[level > 0].append(shown)
    flush()
    if not any(b.content and not b.skipped for b in out):
        for b in inside_layout:
            b.skipped = False
    return out


class Weights:
    """Log odds of features, learnt from labelled pages; words start positive, tags negative."""

    def __init__(self, inside: Counter[str] | None = None, outside: Counter[str] | None = None):
        inside, outside = inside or Counter(), outside or Counter()
        total_in, total_out = sum(inside.values()) + 1.0, sum(outside.values()) + 1.0
        self.weight = {}
        for f in inside.keys() | outside.keys():
            odds = math.log((inside[f] + 0.5) / total_in) - math.log((outside[f] + 0.5) / total_out)
            seen = inside[f] + outside[f]
            self.weight[f] = (seen * max(-4.0, min(4.0, odds)) + PRIOR * self.unseen(f)) / (seen + PRIOR)

    @staticmethod
    def unseen(feature: str) -> float:
        """The weight of a feature of which nothing is known."""
        if feature.startswith("tag:"):
            return -0.2
        return 1.0 if feature.endswith(":in") else -1.0 if feature.endswith(":out") else -0.5 if feature.endswith(":linked") else 0.5

    def of(self, feature: str) -> float:
        return self.weight.get(feature, self.unseen(feature))

    def tags(self, b: Block) -> float:
        """What the tags before a block cost; never a gain."""
        return sum(min(0.0, self.of("tag:" + t)) for t in b.tags)

    def words(self, b: Block, mark: str) -> float:
        return b.words * max(-1.0, min(1.0, self.of(f"word:{b.feature}{mark}")))


def _marked(blocks: list[Block]) -> list[str]:
    """Each block's place to the page's marks; all the same, and empty, on a page without any."""
    if not any(b.content for b in blocks):
        return [""] * len(blocks)
    return [":in" if b.content else ":out" for b in blocks]


def features(page: str) -> tuple[Counter[str], Counter[str]]:
    """Feature counts inside and outside the content of a page that marks it, with the marks and with them hidden; empty for other pages."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    shown, hidden = read_blocks(page), read_blocks(page, hide=True)
    kept = [b for b in shown if not b.skipped]
    for b, mark in zip(kept, _marked(kept), strict=True):
        if mark:
            (inside if b.content else outside)[f"word:{b.feature}{mark}"] += b.words
    if any(b.content for b in kept):
        for b in hidden:
            own = inside if b.content and not b.skipped else outside
            own["word:" + b.feature] += b.words
            for t in b.tags:
                own["tag:" + t] += 1
    return inside, outside


def best_region(costs: list[float], gains: list[float]) -> tuple[int, int]:
    """The blocks, first and last + 1, of the best region: gains of its blocks less the costs between them; (0, 0) if none is above zero.

    A region begins with a block's words, so what the tags before it cost does not count.
    """
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, (cost, gain) in enumerate(zip(costs, gains, strict=True)):
        run += cost
        if run <= 0:
            run, start = 0.0, i
        run += gain
        if run > best:
            best, span = run, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights, *, hide: bool = False) -> str:
    """The blocks of the best contiguous region, those left out and text between a page's marked parts excepted."""
    blocks = [b for b in read_blocks(page or "", hide=hide) if not b.skipped]
    marks = [""] * len(blocks) if hide else _marked(blocks)
    inside = [i for i, m in enumerate(marks) if m == ":in"]
    if inside:  # what stands between marked parts is an inset
        blocks, marks = zip(*((x, m) for i, (x, m) in enumerate(zip(blocks, marks, strict=True)) if m == ":in" or not inside[0] < i < inside[-1]), strict=True)
    a, b = best_region([weights.tags(x) for x in blocks], [weights.words(x, m) for x, m in zip(blocks, marks, strict=True)])
    return "\n".join(x.text for x in blocks[a:b])


def learn_weights(pages: DataFrame, *, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` pages, those with the smallest hashes of their text."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(html_col).cast("string").alias("_html")).where(F.col("_html").isNotNull())
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("_html"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))) + 1)

    def count(batches):
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for batch in batches:
            for page in batch.column("_html").to_pylist():
                a, b = features(page)
                inside.update(a)
                outside.update(b)
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["feature", "a", "b"])

    found = chosen.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # a few rows a block element
    return Weights(Counter({r["feature"]: r["a"] for r in found}), Counter({r["feature"]: r["b"] for r in found}))


def extract(pages: DataFrame, weights: Weights, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
