"""Main-text extraction from HTML by two-pass block rules.

Pass one looks at each block alone: its link density, its length and its stop-word density make it good, bad or
undecided, with its place as a prior (marked menus, footers, forms, adverts, comments ... are out). Pass two gives each
undecided block the label of the nearest decided block, in its own container first. Markup may be broken: unclosed elements, stray end
tags and missing ends are tolerated, and each tag costs constant time.

A null page counts as empty. A page without main text gives an empty string. Repeated rows give the same text each;
extra columns are ignored. Whole pages are read and nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in into is it its not of on or she so that the their them there they this to was we were which who will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en entre era es esta este fue ha la las lo los más no o para pero por se sin sobre son su sus también un una y ya "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind über um und unter vom von vor war wie wir zu zum zur".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody tfoot thead tr ul button label".split())
OUTSIDE = frozenset("nav footer aside form menu head select button dialog search fieldset".split())
ENDS_P = BLOCK - {"option", "optgroup", "legend", "label", "button", "caption", "summary", "figcaption"}
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tablist toolbar".split())
#: Name parts of classes and ids that mark text beside the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations widget widgets pagination pager skip copyright legal tags".split()
)
# quotes only open after an equals sign, values may have any length, and an attempt never goes beyond the next "<" outside of quotes
_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_NAME = re.compile(r"[a-z]+")
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    inside: bool
    container: int
    heading: bool


def _end(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element that begins at ``at`` ends, its end tag included."""
    m = re.compile(rf"</{tag}\s*>|</{tag}(?=[\s/])[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether attributes put an element beside the article, and whether they name it the article."""
    bad = main = False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            bad |= any(x in BAD_NAMES for x in _NAME.findall(value))
        elif name == "role":
            bad |= value in _BAD_ROLE
            main |= value in ("main", "article")
        elif name == "itemprop":
            main |= value == "articlebody"
        elif name == "hidden":
            bad = True
        elif value == "true":
            bad = True
    return bad, main


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with what is known of their place."""
    out: list[Block] = []
    # an open element: tag, whether it is beside the article, inside it, its container
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = containers = 0
    in_link = False
    heading = False
    at = 0

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, bad, inside, container = stack[-1]
                out.append(Block(text, min(linked, len(text)), bad, inside, container, heading))
            parts.clear()
        linked, in_link = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text)

    def close(tag: str) -> None:
        if opened.get(tag, 0):
            while True:
                name = stack.pop()[0]
                opened[name] -= 1
                if name == tag:
                    return

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in RAW:
            if not m[2] and not m[4].endswith("/"):
                at = _end(page, tag, at)
            continue
        if tag == "a":
            in_link = not m[2]
            continue
        if tag in ("br", "td", "th", "img"):
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        heading = False
        if m[2]:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and opened.get("p", 0) and stack[-1][0] == "p":
            close("p")
        if tag in ("li", "dt", "dd", "tr", "option") and stack[-1][0] == tag:
            close(tag)
        _, bad, inside, container = stack[-1]
        named, main = _marks(m[4]) if m[4] else (False, False)
        if tag in ("article", "main") or main:
            inside, named = True, named and tag not in ("article", "main", "body")
        bad |= tag in OUTSIDE or named and tag not in ("html", "body") or tag == "header" and not inside
        if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd", "pre", "blockquote", "figcaption", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot"):
            containers += 1
            container = containers
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        stack.append((tag, bad, inside, container))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    """Share of words that are stop words, marks around them aside."""
    found = text.lower().split()
    return sum(w in STOP_WORDS or _EDGE.sub("", w) in STOP_WORDS for w in found) / max(1, len(found))


def main_text(page: str | None, short: int = 70, long: int = 200, low: float = 0.05, high: float = 0.2, links: float = 0.34, linked_prose: float = 0.8) -> str:
    """The article's blocks, joined by line feeds.

    ``short``/``long``: lengths below which a block is undecided and from which its stop words must only pass ``low``;
    ``links``: link density from which a block is bad, unless its place is good, its stop words pass ``high`` and at most
    ``linked_prose`` of it is linked. Place is a prior: inside an article ``low`` is enough for any length, and a block
    without stop words is undecided there, not bad; text beside an article is bad only if the article has a good block.
    """
    found = blocks(page or "")
    label: list[bool | None] = []
    for b in found:  # pass one
        n = len(b.text)
        density = 0.0 if b.bad or n < short and b.linked <= links * n else stop_density(b.text)
        if b.bad:
            label.append(False)
        elif b.linked > links * n:
            label.append(b.inside and density >= high and b.linked <= linked_prose * n)
        elif n < short:
            label.append(None)
        elif density >= high or density >= low and (n >= long or b.inside):
            label.append(True)
        else:
            label.append(None if density >= low or b.inside else False)
    article = any(b.inside and x for b, x in zip(found, label, strict=True)) or any(b.inside for b in found) and not any(label)
    if article:
        label = [x if b.inside else False for b, x in zip(found, label, strict=True)]
    decided = [i for i, x in enumerate(label) if x is not None]
    out = []
    k = 0
    for i, b in enumerate(found):  # pass two
        while k < len(decided) and decided[k] < i:
            k += 1
        if label[i] is not None:
            good = label[i]
        else:
            left, right = (decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)
            near = [(found[j].container != b.container, abs(j - i), not label[j], label[j]) for j in (left, right) if j is not None]
            if not near or all(x[0] for x in near):
                good = b.inside or bool(near) and min(near)[3] and not article
            else:
                good = min(near)[3]
            if b.heading and not good and right is not None and label[right] and found[right].container == b.container:
                good = True  # a heading belongs to what follows
        if good:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page: a narrow map, one page in memory at a time beside its batch."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
