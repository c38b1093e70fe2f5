"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element, in page order. Lines of scripts, styles,
menus, headers, footers, sidebars, notices, adverts, forms and comments are left out; outside an
article or main element, lines that are links or a menu only have no weight. A line's weight is its length.

Distribution: the weights of `WINDOW` lines in a row are summed over a sliding window. Text begins at the
line that enters when the sum reaches the page's threshold (surge) and ends with the line that
leaves when the sum falls below it (dive). The threshold is a part of the page's largest sum, within
LOWEST and HIGHEST. Texts parted by less text than they have are one, if they lie in one
element. The heaviest text is the main one. It is completed by what belongs to its ends: headings right before it,
and short lines next to it in the same element. Where a page has article or main elements, only their lines have weight, and all
texts between a surge and its dive in them are the main text, completed by the lines next to them in the same article or main element that are too light
for a surge of their own. A page without a surge gives its longest stretch of lines.

An element's name tells that it is a menu or the like. Inside an article or main element the whole name must, and no other name may say content.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

WINDOW = 3
#: The threshold of a sum is this part of the page's largest one, but not under LOWEST or over HIGHEST.
PART, LOWEST, HIGHEST = 1 / 3, 40, 240

# Elements by what they do to lines.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes template".split())
UNWANTED = set("head title script style noscript template iframe object svg canvas nav menu footer aside form button select textarea input dialog noembed noframes xmp audio video map".split())
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTS = HEADINGS | {"p", "li", "dd", "dt", "blockquote", "pre", "td", "th", "figcaption", "caption", "summary"}
#: Open elements that a start tag ends, and the elements beyond which it ends none.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|breadcrumbs?|comments?|comment-?list|disqus|respond|cookies?|consent|footer|footnav|header|masthead|menus?|nav|navbar|navigation|notices?|alerts?|newsletter|subscribe|popup|modal|promos?|promotions?|sponsored|related|share|sharing|social|sidebars?|widgets?|toolbar|pagination|pager|skip-?link|login|signup)(?=$|[\s_-])", re.I)
#: What may stand around such a name, and names of content.
_AROUND = r"(?:site|page|post|article|entry|user|reader|top|bottom|social|main|in|inline)", r"(?:box|bar|list|link|button|wrap|wrapper|container|section|area|block|widget|unit|banner|form|thread|item|body|text|icon|post|article|stories|story|content|new|panel|inner|message)s?"
_NAMES = NAMES.pattern.split("(?:", 2)[2].rsplit(")(?=", 1)[0]
NAMED = re.compile(rf"(?:{_AROUND[0]}[-_])*(?:{_NAMES})(?:[-_](?:{_NAMES}|{_AROUND[1]}))*", re.I)
CONTENT = {"content", "text", "body", "article", "entry", "post", "story", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

#: Outside containers, lines of short items between bars, and copyright lines: they start no text.
_MENU = re.compile(r"(?:©|copyright\b|\(c\) ).{0,200}|(?:[^|·»]{1,24}[|·»])+[^|·»]{1,24}", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text else {}


def _named(attrs: dict[str, str], inside: bool) -> bool:
    names = [attrs.get("class", ""), attrs.get("id", "")]
    if not inside:
        return any(NAMES.search(x) for x in names)
    whole = [x.lower() for n in names for x in n.split()]
    return not CONTENT & set(whole) and any(NAMED.fullmatch(x) for x in whole)


def _unwanted(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in UNWANTED or tag == "header" and not inside or "hidden" in attrs or attrs.get("role", "").lower() in ROLES:
        return True
    return tag not in ("html", "body", "main") and _named(attrs, inside)


class Line(NamedTuple):
    """A block's text, its weight, its element (tag and number), the elements around that (-1 for the page itself) and its outermost container (0 if none)."""

    text: str
    weight: int
    tag: str
    element: int
    parent: int
    above: int
    container: int


def lines(page: str) -> Iterator[Line]:
    """The lines of a page in page order; every tag takes the same time, however deep it lies."""
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, whether unwanted, number
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a tag are
    blocks: list[int] = []  # where the open block elements are
    bad = links = inside = at = number = container = 0
    parts: list[str] = []
    linked = plain = 0

    def around(i: int) -> int:
        return stack[i][2] if i >= 0 and stack[i][0] not in ("body", "html") else -1

    def flush() -> Iterator[Line]:
        nonlocal linked, plain
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                worthless = not inside and (linked > 0 and not plain or bool(_MENU.fullmatch(text)))
                i = blocks[-1] if blocks else -1
                tag, _, element = stack[i] if i >= 0 else ("", False, -1)
                yield Line(text, 0 if worthless else len(text), tag, element, around(i - 1), around(i - 2), container if inside else 0)
        linked = plain = 0

    def pop() -> None:
        nonlocal bad, links, inside
        tag, was_bad, _ = stack.pop()
        places[tag].pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        bad -= was_bad
        links -= tag == "a"
        inside -= tag in CONTAINERS and not was_bad

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not bad:
            text = html.unescape(text)
            parts.append(text)
            if text.strip():
                linked, plain = linked + (links > 0), plain + (links == 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            yield from flush()
        if m[1]:
            if places[tag]:
                to = places[tag][-1]
                if tag not in BLOCKS and blocks and blocks[-1] > to:
                    yield from flush()
                while len(stack) > to:
                    pop()
            continue
        attrs = _attributes(m[3])
        if tag in BLOCKS and tag != "br" and places["p"] and blocks[-1] == places["p"][-1]:
            while len(stack) > blocks[-1] + 1:
                pop()
            pop()
        if tag in ENDS:
            ended, limits = ENDS[tag]
            to = last(ended)
            if to > last(limits):
                while len(stack) > to:
                    pop()
        if tag in VOID:
            continue
        worthless = _unwanted(tag, attrs, inside > 0)
        if tag in RAW:  # its content isn't markup
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            content = page[at : end.start() if end else len(page)]
            if not bad and not worthless:
                parts.append(html.unescape(content))
                plain += 1
            at = end.end() if end else len(page)
            if tag in BLOCKS:
                yield from flush()
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "span"):
            continue
        number += 1
        places[tag].append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append((tag, worthless, number))
        bad += worthless
        links += tag == "a"
        if tag in CONTAINERS and not worthless:
            inside += 1
            if inside == 1:
                container = number
    yield from flush()


def block_sums(weights: list[int]) -> list[int]:
    """Sums over windows of WINDOW lines; the first window holds the first line alone, the last one the last."""
    upto = [0, *accumulate(weights)]
    n = len(weights)
    return [upto[min(n, i + 1)] - upto[max(0, i + 1 - WINDOW)] for i in range(n + WINDOW - 1)]


def surges(weights: list[int], threshold: int) -> list[tuple[int, int]]:
    """(first line, last line + 1) of each text between a surge and its dive."""
    found, start = [], None
    for i, total in enumerate(block_sums(weights)):
        if start is None and total >= threshold:
            start = i
        elif start is not None and total < threshold:
            end = i - WINDOW + 1
            if end <= start:  # no line that enters and leaves: the lines of the last window, together
                start, end = max(i - WINDOW, found[-1][1] if found else 0), min(i, len(weights))
            found.append((start, end))
            start = None
    if start is not None:
        found.append((min(start, len(weights) - 1), len(weights)))
    return found


def _related(a: Line, b: Line) -> bool:
    """Whether both lie in one element below the page's body, or are text blocks of the body itself."""
    if a.parent == b.parent:
        return a.parent != -1 or a.tag in TEXTS and b.tag in TEXTS
    return a.above == b.above != -1 or a.parent == b.above != -1 or a.above == b.parent != -1


def _joined(page: list[Line], parts: list[tuple[int, int]], upto: list[int], chars: list[int]) -> list[tuple[int, int]]:
    """Texts that are parted by less text than they have and lie in one element are one."""
    out: list[tuple[int, int]] = []
    for i, j in parts:
        while out:
            before, end = out[-1]
            if not _related(page[end - 1], page[i]) or chars[i] - chars[end] > upto[end] - upto[before] + upto[j] - upto[i]:
                break
            out.pop()
            i = before
        out.append((i, j))
    return out


def _completed(page: list[Line], i: int, j: int) -> tuple[int, int]:
    """The text with the lines that belong to its ends."""

    def belongs(line: Line, to: Line) -> bool:
        return line.weight > 0 and (line.element == to.element or line.parent == to.parent and line.tag in TEXTS and to.tag in TEXTS)

    while i > 0 and (page[i - 1].weight and page[i - 1].tag in HEADINGS or belongs(page[i - 1], page[i])):
        i -= 1
    while j < len(page) and belongs(page[j], page[j - 1]):
        j += 1
    return i, j


def _trimmed(page: list[Line], i: int, j: int) -> tuple[int, int]:
    """A text of text blocks of the body itself without other lines of the body at its ends."""
    if 2 * sum(x.weight for x in page[i:j] if x.parent == -1 and x.tag in TEXTS) > sum(x.weight for x in page[i:j]):
        other = lambda x: x.parent == -1 and x.tag not in TEXTS
        while j > i + 1 and other(page[j - 1]):
            j -= 1
        while j > i + 1 and other(page[i]):
            i += 1
    return i, j


def _contained(page: list[Line], found: list[tuple[int, int]], threshold: float) -> list[Line]:
    """The lines of all texts found in containers, and the light ones next to them in the same container."""
    kept = [False] * len(page)
    for i, j in found:
        for k in range(i, j):
            kept[k] = page[k].container > 0
    held = [k for k, x in enumerate(page) if x.container]  # what lies between containers parts nothing
    for order in (held, held[::-1]):
        for a, b in zip(order, order[1:]):
            kept[b] = kept[b] or kept[a] and page[a].container == page[b].container and page[b].weight < threshold
    return [x for x, k in zip(page, kept) if k]


def main_text(html_text: str | None) -> str:
    """The lines of the main text, joined by a space; the first of equally heavy texts."""
    page = list(lines(html_text or ""))
    contained = any(x.container and x.weight for x in page)
    weights = [0 if contained and not x.container else x.weight for x in page]
    highest = max(block_sums(weights), default=0)
    threshold = max(LOWEST, min(HIGHEST, highest * PART))
    threshold = threshold if highest >= threshold else 1
    found = surges(weights, threshold)
    if not found:
        return " ".join(x.text for x in page) if len(page) == 1 else ""
    if contained:
        return " ".join(x.text for x in _contained(page, found, threshold))
    upto, chars = [0, *accumulate(weights)], [0, *accumulate(len(x.text) for x in page)]
    i, j = max(_joined(page, found, upto, chars), key=lambda s: upto[s[1]] - upto[s[0]])
    i, j = _completed(page, *_trimmed(page, i, j))
    return " ".join(x.text for x in page[i:j])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every row of `pages`.

    Null and empty html, and pages without text, give an empty text. Pages of any length and depth of nesting are
    read whole, in time linear in their length. Of equally heavy texts the first counts. Repeated rows each get
    their row; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = only(pages, "page_id", "url", "html")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
