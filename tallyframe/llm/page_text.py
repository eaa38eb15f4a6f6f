"""Main text of web pages, without site templates.

Pages are parsed once, into text blocks and hashes of the element subtrees that
may be templates. Spark counts each subtree per host over pages that differ.
Subtrees that recur across many pages of their host are deleted, and so are
elements whose name or class says what they are. A page's own ``article`` or
``main`` is what is wanted and is never taken for a template, however often its
text is repeated; a page without one gives what is left of its body. Subtrees
below an ``article`` or ``main`` are counted over pages on which the rest of the
article's text differs, so that copies of one article do not make its parts
templates.

A subtree's hash is made from its own tag and text and its children's hashes, and
boxes know the box around them, so a page is read in time proportional to its
length however deep it is nested.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.url_rules import url_host
from tallyframe.session import cut_lineage

MIN_PAGES = 5  # pages that differ and share a subtree
MIN_SHARE = 0.1  # of the host's pages that differ

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements of HTML by their part in a page (fixed values).
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form script style textarea title noscript iframe template xmp noembed noframes head svg math button select dialog object audio video canvas menu datalist".split())
WANTED = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
BOXES = frozenset("div section ul ol dl table header details figure center fieldset".split())
CELLS = frozenset("td th br".split())
#: Classes, roles and ids that as a whole mark what is not the article (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social newsletter subscribe popup modal overlay pagination toolbar masthead complementary contentinfo search login signup".split()
)
OUTER_MARKS = frozenset("header top".split())
#: Words that mark an element as a part of its class or id, such as ``cookie-banner`` (fixed values).
PART_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr sidebar widget widgets nav navbar menu breadcrumb breadcrumbs footer share sharing newsletter subscribe signup popup modal pagination toolbar masthead".split()
)
TALK_MARKS = frozenset("comment comments disqus".split())
#: First words that say what a page has or lacks, such as ``has-sidebar`` and ``no-ads`` (fixed values).
STATE_WORDS = frozenset("no not non has have with without is hide show".split())
SMALL, TALK = 1, 2
SMALL_SHARE = 3  # a part-marked element goes if it has at most this fraction of the text, one in so many
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Articles inside dropped elements are wanted on pages that have no other article and no main.
FIRST, SECOND = 1, 2
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


class Element:
    __slots__ = ("tag", "dropped", "wanted", "holds", "box", "near", "value", "heading")

    def __init__(self, tag: str, dropped: bool, wanted: int, box: int, near: int, value: int) -> None:
        self.tag, self.dropped, self.box, self.near, self.value = tag, dropped, box, near, value
        self.wanted = wanted  # of the outermost article or main that holds it, or its own
        self.holds = False  # an article or main
        self.heading = False


def text_hash(text: str, kind: bytes = b"") -> int:
    """64-bit hash of a text with white space runs as one space; each kind has its own hashes."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8, person=kind).digest(), "big")


def signed(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def names(attributes: str, ids: bool = True) -> set[str]:
    """Classes and roles, and the id as a whole, in lower case."""
    found: set[str] = set()
    for m in NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() != "id":
            found.update(value.split())
        elif ids:
            found.add(value.strip())
    return found


def part_marks(words: set[str]) -> int:
    """What the parts of compound classes and ids say: TALK, SMALL or nothing."""
    found = 0
    for word in words:
        parts = [x for x in re.split(r"[-_]+", word) if x]
        if len(parts) > 1 and parts[0] not in STATE_WORDS:
            if not TALK_MARKS.isdisjoint(parts):
                return TALK
            if not PART_MARKS.isdisjoint(parts):
                found = SMALL
    return found


class Box:
    """An element that may go: a candidate for a template if it has a hash, part-marked if ``soft``."""

    __slots__ = ("parent", "hash", "inside", "soft", "heading")

    def __init__(self, parent: int, template: bool, inside: bool, soft: int) -> None:
        self.parent, self.inside, self.soft, self.heading = parent, inside, soft, False
        self.hash: int | None = None if template else 0


class Page:
    """Blocks of a page, each with the box around it, and the boxes."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[str, int, int]] = []  # text, FIRST or SECOND if inside article or main, nearest box
        self.boxes: list[Box] = []
        self.text: list[str] = []
        self._read()

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                top = self.stack[-1] if self.stack else None
                self.blocks.append((text, top.wanted if top else 0, top.near if top else -1))
            self.text = []

    def _pop(self) -> None:
        top = self.stack.pop()
        self.open[top.tag] -= 1
        if top.box >= 0:
            box = self.boxes[top.box]
            box.heading = top.heading
            if box.hash is None:
                box.hash = 0 if top.holds else signed(text_hash(f"{top.tag} {top.value}", b"inside" if box.inside else b"")) or 1
            if top.holds:  # what holds the article is no template and no part of the page's furniture
                box.soft = 0
        if self.stack:
            above = self.stack[-1]
            above.holds = above.holds or top.holds
            above.heading = above.heading or top.heading
            above.value = ((above.value ^ top.value) * STEP + 1) & MASK

    def _close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            for k in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                if self.stack[k].tag == "p":
                    self._close_to(k)
                    break
                if self.stack[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in STOPS[tag]:
                    break
                if self.stack[k].tag in CLOSES[tag]:
                    self._close_to(k)
                    break
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else None
        inside = bool(above and above.wanted)
        dropped = bool(above and above.dropped) or tag in DROPPED or (tag == "header" and not inside)
        root = tag in WANTED or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))
        soft = 0
        # ids of headings and sections in an article name what they are about
        if not dropped and attributes and not root and tag not in ("html", "body") and not (inside and tag in HEADINGS):
            words = names(attributes, ids=not (inside and tag == "section"))
            dropped = not words.isdisjoint(MARKS) or (not inside and not words.isdisjoint(OUTER_MARKS))
            soft = 0 if dropped else part_marks(words)
        wanted = 0
        if root and not (dropped and inside):
            wanted = SECOND if dropped and tag == "article" else FIRST
            dropped = False
        if inside:
            template = tag in BOXES and not dropped and not wanted
        else:
            template = (tag in BOXES or tag in DROPPED and tag not in RAW and tag != "head") and not wanted
        near, box = above.near if above else -1, -1
        if template or soft:
            box = len(self.boxes)
            self.boxes.append(Box(near, template, inside, soft))
            near = box
        top = Element(tag, dropped, (above.wanted if inside else wanted), box, near, text_hash(f"<{tag}{attributes}"))
        top.holds, top.heading = bool(wanted), tag in HEADINGS
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(top)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self.open.get(tag):
            return
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def _read(self) -> None:
        source, at = self.source, 0
        while True:
            found = TOKEN.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at and self.stack:
                top = self.stack[-1]
                if not source[at:stop].isspace():
                    top.value = ((top.value ^ text_hash(source[at:stop])) * STEP + 2) & MASK
            if stop > at and not (self.stack and self.stack[-1].dropped):
                self.text.append(source[at:stop])
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            attributes = found[3] or found[6] or ""
            if found[1] or found[4]:
                self._end(tag)
                continue
            if tag in CELLS:
                self.text.append(" ")
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            self._start(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "math", "path"):
                self._end(tag)
        self._flush()
        self._close_to(0)
        for box in self.boxes:
            box.hash = box.hash or 0

    def _sums(self, values: list[tuple[int, int]]) -> list[int]:
        """For every box the sum of the values at it and below; a box comes after the one around it."""
        sums = [0] * len(self.boxes)
        for k, value in values:
            if k >= 0:
                sums[k] += value
        for k in range(len(sums) - 1, -1, -1):
            if self.boxes[k].parent >= 0:
                sums[self.boxes[k].parent] += sums[k]
        return sums

    def _unmarked(self, chosen: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Blocks outside part-marked elements: small ones without a heading, and comments unless they are all there is."""
        if not any(box.soft for box in self.boxes):
            return chosen
        total = sum(len(b[0]) for b in chosen)
        sizes = self._sums([(b[2], len(b[0])) for b in chosen])
        gone = []
        for box, size in zip(self.boxes, sizes):
            small = box.soft == SMALL and not box.heading and SMALL_SHARE * size <= total
            talk = box.soft == TALK and size < total
            gone.append(small or talk or (box.parent >= 0 and gone[box.parent]))
        return [b for b in chosen if b[2] < 0 or not gone[b[2]]]

    def result(self) -> tuple[str, list[dict] | None, list[int], list[int], list[dict], bool]:
        """The text before templates are cut; its blocks if any lies in a subtree; hashes and parents of the boxes; all subtrees; whether there is an article."""
        own = [b for b in self.blocks if b[1] == FIRST] or [b for b in self.blocks if b[1] == SECOND]
        chosen = self._unmarked(own or self.blocks)
        values = [(b[2], text_hash(b[0], b"block")) for b in chosen] if own else []
        parts, total = {}, sum(v for _, v in values)
        inner = self._sums([(k, 1) for k, _ in values])
        for box, part, here in zip(self.boxes, self._sums(values), inner):
            if box.hash and here:
                parts[box.hash] = parts.get(box.hash, 0) + part
        outer = {box.hash for box in self.boxes if box.hash and not box.inside}
        subtrees = [{"subtree": h, "rest": None} for h in sorted(outer)] + [{"subtree": h, "rest": signed(total - parts[h])} for h in sorted(parts)]
        around = [False] * len(self.boxes)  # whether a box or one around it has a hash
        for k, box in enumerate(self.boxes):
            around[k] = bool(box.hash) or (box.parent >= 0 and around[box.parent])
        blocks = None
        if any(b[2] >= 0 and around[b[2]] for b in chosen):
            blocks = [{"text": b[0], "box": b[2]} for b in chosen]
        return "\n\n".join(b[0] for b in chosen), blocks, [box.hash for box in self.boxes], [box.parent for box in self.boxes], subtrees, bool(own)


def left_text(blocks: list[dict], hashes: list[int], parents: list[int], cut: set[int], own: bool) -> str:
    """The blocks outside all subtrees in ``cut``; an article that would be empty keeps them all."""
    gone: list[bool] = []
    for h, parent in zip(hashes, parents):
        gone.append(h in cut or (parent >= 0 and gone[parent]))
    kept = [b["text"] for b in blocks if b["box"] < 0 or not gone[b["box"]]]
    return "\n\n".join(kept or ([b["text"] for b in blocks] if own else []))


BLOCK_TYPE = "array<struct<text: string, box: int>>"
BLOCK_ARROW = pa.list_(pa.struct([("text", pa.string()), ("box", pa.int32())]))
SUBTREE_TYPE = "array<struct<subtree: bigint, rest: bigint>>"
SUBTREE_ARROW = pa.list_(pa.struct([("subtree", pa.int64()), ("rest", pa.int64())]))


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page with its host, a hash of its source, its text if no subtree can change it or else its blocks, its subtrees, and whether it has an article."""
    kind = pages.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                found = [Page((v.as_py() or b"").decode("utf-8", "replace")).result() for v in part.column(4).cast(pa.large_binary())]
                # a text that no subtree can change needs no blocks, any other no text
                found = [(None, blocks, hashes, parents, *rest) if blocks else (text, None, None, None, *rest) for text, blocks, hashes, parents, *rest in found]
                kinds = (pa.string(), BLOCK_ARROW, pa.list_(pa.int64()), pa.list_(pa.int32()), SUBTREE_ARROW, pa.bool_())
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["id", "url", "host", "page", "text", "blocks", "hashes", "parents", "subtrees", "own"])

    source = F.col(html_col).cast("string")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), url_host(F.col(url_col)).alias("host"), F.xxhash64(F.octet_length(source), source).alias("page"), source.cast("binary").alias("html")
    )
    return rows.mapInArrow(scan, f"id {kind}, url string, host string, page bigint, text string, blocks {BLOCK_TYPE}, hashes array<bigint>, parents array<int>, subtrees {SUBTREE_TYPE}, own boolean")


def host_templates(parsed: DataFrame, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Subtrees that recur on their host, and all occurrences; copies of one page or of the rest of an article count once."""
    found = parsed.select("host", "page", F.inline_outer("subtrees")).distinct()
    found = cut_lineage(found)
    pages = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    inside = found.where("rest is not null").select("host", "subtree", "rest").distinct()
    rows = found.where("subtree is not null and rest is null").select("host", "subtree").union(inside.select("host", "subtree"))
    counts = rows.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    templates = cut_lineage(counts).join(cut_lineage(pages), "host").where(F.col("n") >= min_share * F.col("pages"))
    return cut_lineage(templates.select("host", "subtree")), found


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block is one space,
    blocks are trimmed and joined in page order by two line ends; nothing is cut
    short. A NULL page is empty and gives an empty text. Pages without a URL
    form a host of their own. Repeated rows give equal texts and count as one
    page; an empty table gives no rows. An article of which only recurring
    subtrees are made keeps them. Other columns are not read, whatever their
    names.
    """
    parsed = cut_lineage(parsed_pages(pages, id_col, url_col, html_col))
    templates, found = host_templates(parsed, min_pages, min_share)
    sure = parsed.where("text is not null").select("id", "url", "text")
    open_ = parsed.where("text is null")
    hits = found.join(open_.select("host", "page").distinct(), ["host", "page"]).join(templates, ["host", "subtree"])
    hits = cut_lineage(hits.groupBy("host", "page").agg(F.collect_set("subtree").alias("cut")))  # at most the subtrees of one page
    rest = open_.join(hits, ["host", "page"], "left").withColumn("cut", F.coalesce("cut", F.expr("cast(array() as array<bigint>)")))
    kind = pages.schema[id_col].dataType.simpleString()

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                columns = [part.column(k).to_pylist() for k in range(2, part.num_columns)]
                texts = [left_text(blocks, hashes, parents, set(cut), own) for blocks, hashes, parents, cut, own in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    rest = rest.select("id", "url", "blocks", "hashes", "parents", "cut", "own").mapInArrow(clear, f"id {kind}, url string, text string")
    return sure.union(rest).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
