"""Main text of web pages, by two passes of rules over blocks.

Pass one decides blocks by what they are made of: a block in a menu, header, footer, sidebar, form,
notice, advert or comment section is bad; otherwise link density, length and stop-word density
decide, and other blocks stay open. An article or main element is one more feature: lower bars in
pass one, and in pass two only neighbours within it. Pass two gives open blocks the label of their
nearest decided neighbours. One linear scan per page, whole pages, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the HTML standard, frequent function words, usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "title", "math", "canvas", "audio", "video")
#: Of these, the ones a browser reads as text to the end of the page when they are not closed; and those that `/>` closes.
TEXT_ONLY, FOREIGN = frozenset("script style iframe textarea title".split()), frozenset(("svg", "math"))
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
AWAY = frozenset("nav footer aside form button dialog menu head".split())
MAIN = frozenset("article main".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
AWAY_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar side aside footer masthead header topbar comment comments commentlist reply replies respond disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended widget toolbar pagination pager paywall disclaimer copyright legal skip search form").split())
STOP_WORDS = frozenset((
    # English
    "a about after all an and are as at be been but by for from had has have he her his i if in into is it its not of on one or our "
    "she so that the their there they this to was we were what when which who will with would you your "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa "
    "se ses son sont sur un une vous "
    # German
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht "
    "sich sie sind so über um und von vor war wie wird zu zum zur "
    # Spanish
    "al como con de del el ella en es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus un una y ya"
).split())

#: Characters below which a block is short, from which it may be good; stop-word and link shares.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.25, 0.35
#: Within an article or main element: the length from which a block may be good, and its stop-word share.
MAIN_LONG, MAIN_STOP = 100, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
_NAME = re.compile(r"[A-Za-z]+")
_OPEN_END = re.compile(r"<[a-zA-Z/!][^<>]*\Z")


@dataclass
class Block:
    tag: str
    main: int  # number of the outermost article or main element around it, 0 for none
    away: bool
    home: int  # number of the element around the block
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def is_away(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element opens a part of the page that is not its text."""
    if tag in AWAY or tag == "header" and not inside_main:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in AWAY_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and not AWAY_NAMES.isdisjoint(_NAME.findall(value)):
            return True
    return False


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order. Unclosed and stray tags are taken as browsers do, roughly; a tag cut off at the end is dropped."""
    end = _OPEN_END.search(html, max(0, html.rfind("<")))
    html = html[:end.start()] if end else html
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, within which main, away, number
    opened = 0
    held: Counter[str] = Counter()  # open elements by tag
    links, here = 0, [Block("", 0, False, 0)]
    unclosed: set[str] = set()  # elements of RAW without an end tag from here on

    def cut(tag: str = "") -> None:
        if here[0].pieces:
            out.append(here[0])
        _, main, away, number = stack[-1]
        home = stack[-2][3] if tag and tag == stack[-1][0] else number
        here[0] = Block(tag or next((t for t, *_ in reversed(stack) if t in BLOCKS), ""), main, away, home)

    def add(text: str) -> None:
        if text:
            here[0].pieces.append(text)
            if links:
                here[0].linked += len(text.split()) and len("".join(text.split()))

    def leave(depth: int) -> None:
        held.subtract(t for t, *_ in stack[depth:])
        del stack[depth:]
        cut()

    at, size, last_end = 0, len(html), html.rfind(">")
    while at < size:
        m = _TOKEN.search(html, at) if at <= last_end or html.startswith("<!--", at) else None
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            add(" ")
        elif closing:
            if tag == "a":
                links = max(0, links - 1)
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag) if held[tag] > 0 else 0
            if depth and tag in BLOCKS | AWAY:
                leave(depth)
            elif tag in BLOCKS:
                cut()
        elif tag in RAW:
            if tag not in FOREIGN or not attributes.endswith("/") or _UNQUOTED_SLASH.search(attributes):
                close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if close is None:
                    unclosed.add(tag)
                at = close.end() if close else size if tag in TEXT_ONLY else at
            if tag not in ("title", "script", "style"):
                add(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCKS or tag in AWAY:
            if tag in CLOSES_P:
                if stack[-1][0] == "p":
                    leave(len(stack) - 1)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1][0] == tag:
                leave(len(stack) - 1)
            _, main, away, _ = stack[-1]
            if tag != "hr":
                opened += 1
                stack.append((tag, main or (opened if tag in MAIN else 0), away or is_away(tag, attributes, main > 0), opened))
                held[tag] += 1
            if tag in AWAY | MAIN | {"section", "div", "header"}:
                links = 0
            cut(tag)
    cut()
    for b in out:
        b.text = " ".join(unescape("".join(b.pieces)).split())
        b.pieces = []
    return [b for b in out if b.text]


def decide(b: Block) -> str:
    """Pass one: good, bad, near (leans to good) or short (too short, or too few stop words, to say)."""
    size, words = len(b.text), b.text.lower().split()
    links = b.linked / max(1, size)
    if b.away:
        return "bad"
    if links > LINKS:
        return "bad"
    stop = sum(w.strip(".,;:!?\"'()«»") in STOP_WORDS for w in words) / len(words)
    if b.main:
        if size < SHORT:
            return "short"
        return "good" if size >= MAIN_LONG and stop >= MAIN_STOP else "near"
    if size < SHORT:
        return "bad" if links > 0 else "short"
    if stop >= STOP_HIGH:
        return "good" if size >= LONG else "near"
    return "near" if stop >= STOP_LOW else "bad" if links > 0 else "short"


def neighbours(blocks: list[Block]) -> list[Block | None]:
    """For each block the nearest decided one before it; within an article or main element only one of its text."""
    out: list[Block | None] = []
    last: Block | None = None
    inside: Block | None = None
    for b in blocks:
        if inside is not None and inside.main != b.main and not b.away:
            inside = None
        out.append(inside if b.main else last)
        if b.label in ("good", "bad"):
            last = b
            if b.main and not b.away:
                inside = b
    return out


def label(blocks: list[Block]) -> None:
    """Pass two: open blocks inherit from the nearest decided neighbours.

    Between two good ones they are good, between two bad ones bad. Between a good and a bad one (the
    end of the page counts as bad) a near block, a heading before a good block and a block that lies
    in the same element as the good one, but not as the bad one, are good, other short blocks bad.
    Within an article or main element the ends count as good and one good side is enough: what is
    open there is bad only between blocks of links. A page without any good block takes its near
    blocks as good first.
    """
    for b in blocks:
        b.label = decide(b)
    if all(b.label != "good" for b in blocks):
        for b in blocks:
            b.label = "good" if b.label == "near" else b.label
    before, after = neighbours(blocks), neighbours(blocks[::-1])[::-1]
    made = [_inherited(b, x, y) if b.label in ("near", "short") else b.label for b, x, y in zip(blocks, before, after)]
    for b, result in zip(blocks, made):
        b.label = result


def _inherited(b: Block, before: Block | None, after: Block | None) -> str:
    end = "good" if b.main else "bad"
    left, right = (end if x is None else x.label for x in (before, after))
    if left == right:
        return left
    good, bad = (before, after) if left == "good" else (after, before)
    if b.main or b.label == "near" or b.tag in HEADINGS and right == "good":
        return "good"
    return "good" if good is not None and good.home == b.home and (bad is None or bad.home != b.home) else "bad"


def main_text(html: str | None) -> str:
    """The good blocks, joined by an empty line; empty for null and for pages without any."""
    if not html:
        return ""
    blocks = blocks_of(html)
    label(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text) per row of `pages`, in any number of repeats; other columns are not read."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": [main_text(h) for h in pdf["html"]]})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, url string, text string")
