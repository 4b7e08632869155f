"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one a block element.  A line weighs as many
characters as stand outside links in it; nothing if most of it is links, if it is
page furniture that the markup names (menus, page headers, footers, sidebars,
adverts, notices, forms, scripts, styles, reader comments; by element or by words
of class, id or role), or if the page names an article or main element with text
and the line is not in one.  Weights are summed over sliding windows of ``WINDOW``
lines; where the sum surges to ``SURGE`` or more a stretch of text begins, at the
line where it left zero, and where it dives to zero the stretch ends.  A page
without a surge has its largest stretch for one.

A stretch belongs to the elements that its lines stand in: of an article or main
element all lines are kept, of another container (division, section, cell, body)
those from its first line of weight to its last, so that short closing paragraphs
and lists of links inside a text stay.  Named furniture never is.

Tags are read in one pass over the page; a quote that is never closed is an
ordinary character.  Named furniture that is never closed ends where the next
block begins, if its end tag may be left out, and otherwise names nothing.  A
division named like furniture that holds the article or a heading of the first
level is a wrapper, not furniture.

Character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined by a line feed.  Null, empty and textless pages
give an empty text; rows that repeat are extracted alike.  Columns other than id,
url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SURGE = 3, 80
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Of these an end tag that is missing swallows the rest of the page.
_SWALLOWS = frozenset("script style textarea title".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article main div section td body html".split())
_FURNITURE = frozenset("nav aside footer form head select button menu dialog object canvas audio video map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_END = frozenset("p li dt dd option tr td th".split())
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments respond replies disqus share sharing social related recommended footer header masthead subscribe newsletter signup login search widget pagination pager toolbar complementary contentinfo".split())
_TITLES = frozenset("header masthead banner".split())
_COMMENTS = frozenset("comment comments respond replies disqus".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_TAG = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_STOP = re.compile(r"[>\"']")


class Token(NamedTuple):
    start: int
    end: int
    tag: str  # empty: nothing but markup to leave out
    closing: bool
    attributes: str


class Line(NamedTuple):
    text: str
    weight: int
    regions: tuple[int, bool]  # the element it stands in; whether that is an article or main


def _words(attributes: str) -> set[str]:
    return {w for names in _NAMES.findall(attributes) for w in _SPLIT.split("".join(names).lower())} if attributes else set()


def tokens(page: str) -> list[Token]:
    """Tags, comments and raw elements, in one pass."""
    out: list[Token] = []
    low = page.lower()
    if len(low) != len(page):  # a letter whose lower case is longer
        low = "".join(c.lower() if c.isascii() else c for c in page)
    unclosed = {'"': len(page), "'": len(page)}  # from here on a quote has no partner
    absent: set[str] = set()
    dead: set[int] = set()  # opening quotes after which no tag ends outside quotes

    def tag_end(at: int) -> int:
        begin, seen = at, []
        while True:
            m = _STOP.search(page, at)
            if not m:
                break
            k, c = m.start(), m[0]
            if c == ">":
                return k + 1
            if k in dead:
                break
            if k >= unclosed[c]:
                at = k + 1
                continue
            close = page.find(c, k + 1)
            if close < 0:
                unclosed[c] = k
                at = k + 1
                continue
            seen.append(k)
            at = close + 1
        dead.update(seen)
        end = page.find(">", begin)
        return end + 1 if end >= 0 else len(page)

    at = page.find("<")
    while at >= 0:
        m = _TAG.match(page, at + 1)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            out.append(Token(at, end, "", False, ""))
        elif m:
            end, tag, closing = tag_end(m.end()), m[2].lower(), bool(m[1])
            own = page[m.end() : end - 1]
            if tag in _RAW and not closing and (tag in _SWALLOWS or not own.endswith("/")):
                stop = -1 if tag in absent else low.find(f"</{tag}", end)
                if stop < 0:
                    absent.add(tag)
                    end = len(page) if tag in _SWALLOWS else end
                else:
                    close = page.find(">", stop)
                    end = close + 1 if close >= 0 else len(page)
                out.append(Token(at, end, "", False, ""))
            elif tag in _RAW:
                out.append(Token(at, end, "", False, ""))
            else:
                out.append(Token(at, end, tag, closing, own))
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at)
            end = end + 1 if end >= 0 else len(page)
            out.append(Token(at, end, "", False, ""))
        else:
            end = at + 1
        at = page.find("<", end)
    return out


def _ends(found: list[Token]) -> dict[int, int]:
    """The token that closes each token's element, by its number."""
    stacks: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for k, t in enumerate(found):
        if not t.tag or t.tag in _VOID:
            continue
        if not t.closing:
            stacks.setdefault(t.tag, []).append(k)
        elif stacks.get(t.tag):
            ends[stacks[t.tag].pop()] = k
    return ends


def _named(found: list[Token], ends: dict[int, int]) -> dict[int, int]:
    """Furniture: number of the opening token, number of the first token that is no
    longer in it."""
    words = [_words(t.attributes) if t.tag and not t.closing else set() for t in found]
    heads: list[int] = [0]  # articles, main elements and headings before each token
    depth, inside = 0, []
    for t, w in zip(found, words, strict=True):
        holds = t.tag in ("article", "main", "h1") and not t.closing and _COMMENTS.isdisjoint(w)
        heads.append(heads[-1] + holds)
        if t.tag in ("article", "main"):
            depth = max(0, depth - 1) if t.closing else depth + 1
        inside.append(depth)
    out: dict[int, int] = {}
    for k, t in enumerate(found):
        if not t.tag or t.closing or t.tag in _VOID or t.tag in ("html", "body"):
            continue
        by_tag = t.tag in _FURNITURE or (t.tag == "header" and not inside[k])
        by_name = words[k] & (_COMMENTS if t.tag in ("article", "main") else _WORDS - _TITLES if inside[k] else _WORDS)
        if not by_tag and not by_name:
            continue
        stop = ends.get(k)
        if stop is None and t.tag in _OPEN_END:
            stop = next((j for j in range(k + 1, len(found)) if found[j].tag in _BLOCK), len(found))
        if stop is None or (not by_tag and t.tag not in ("article", "main") and heads[stop] > heads[k + 1]):
            continue
        out[k] = stop
    return out


def lines(page: str) -> list[Line]:
    """The lines of the page; a stretch of furniture is an empty line."""
    found = tokens(page)
    ends = _ends(found)
    named = _named(found, ends)
    out: list[Line] = []
    parts: list[str] = []
    containers: list[tuple[int, str]] = [(-1, "body")]
    links, link, at, k = 0, 0, 0, 0

    def region() -> tuple[int, bool]:
        main = next((c for c, tag in containers if tag in ("article", "main")), None)
        return (containers[-1][0], False) if main is None else (main, True)

    def flush():
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            plain = max(len(text) - links, 0)
            out.append(Line(text, plain if 2 * plain >= len(text) else 0, region()))
        parts.clear()
        links = 0

    while k < len(found):
        t = found[k]
        if t.start > at:
            parts.append(page[at : t.start])
            if link:
                links += t.start - at
        at = t.end
        if k in named:
            flush()
            out.append(Line("", 0, region()))
            k = named[k]
            if k < len(found) and found[k].closing:
                at, k = found[k].end, k + 1
            else:
                at = found[k].start if k < len(found) else len(page)
            continue
        if t.tag in _BLOCK:
            flush()
            if t.tag in _CONTAINER:
                if not t.closing:
                    containers.append((k, t.tag))
                elif len(containers) > 1 and any(tag == t.tag for _, tag in containers[1:]):
                    while containers.pop()[1] != t.tag:
                        pass
        elif t.tag == "br":
            parts.append(" ")
        elif t.tag == "a":
            link = 0 if t.closing else 1
        k += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def stretches(weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[first, last + 1) of the lines between surges and dives of the window sums."""
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    found, begin, most = [], None, 0
    for k in range(len(weight) + 1):
        s = total[min(len(weight), k + window)] - total[k] if k < len(weight) else 0
        if s and begin is None:
            begin, most = k, 0
        if s:
            most = max(most, s)
        elif begin is not None:
            found.append((most, begin, k))
            begin = None
    if not found:
        return []
    least = surge if any(most >= surge for most, _, _ in found) else max(found)[0]
    return [(a, b) for most, a, b in found if most >= least]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    found = lines(page or "")
    marked = any(x.text and x.regions[1] for x in found)
    weight = [x.weight if x.regions[1] or not marked else 0 for x in found]
    if not any(weight):  # nothing but links
        weight = [len(x.text) if x.regions[1] or not marked else 0 for x in found]
    chosen = {found[k].regions for a, b in stretches(weight, window, surge) for k in range(a, b) if weight[k]}
    extent: dict[tuple[int, bool], list[int]] = {}
    for k, x in enumerate(found):
        if x.regions in chosen and (weight[k] or x.regions[1]):
            extent.setdefault(x.regions, [k, k])[1] = k
    return "\n".join(x.text for k, x in enumerate(found) if x.text and x.regions in extent and extent[x.regions][0] <= k <= extent[x.regions][1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = common.arrow_map(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")), run, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
