"""One pass over a page's markup, linear in its length whatever it holds; used inside vectorized tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

_SPACE = " \t\n\r\f"
_NAME = re.compile(r"[^ \t\n\r\f/>]*")
#: Between attributes; an attribute's name; what parts it from its value; a value without quotes.
_GAP, _ATTRIBUTE, _IS, _BARE = re.compile(r"[ \t\n\r\f/]*"), re.compile(r"=?[^ \t\n\r\f/>=]*"), re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*"), re.compile(r"[^ \t\n\r\f>]*")
#: Elements whose text has no markup, and those among them whose character references count.
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")
DECODED = ("textarea", "title")
_ENDS = {t: re.compile(rf"</{t}(?=[ \t\n\r\f/>])", re.I) for t in RAW}
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)")

#: ("start", tag, attributes), ("end", tag, None) or ("text", text, None); tags and attribute names in lower case.
Token = tuple[str, str, dict[str, str] | None]


def unescape_closed(text: str) -> str:
    """Like `unescape`, but a named reference without its semicolon stays as it is, as in libxml2."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _attributes(html: str, at: int, wanted: bool, decode: Callable[[str], str]) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, of each name the first, and the place behind the tag; -1 if the tag never ends."""
    out: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return out, -1
        if html[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(html, at)
        name, at, value = m[0], m.end(), ""
        if m := _IS.match(html, at):
            at = m.end()
            if at < len(html) and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = html[at + 1 : end], end + 1
            else:
                m = _BARE.match(html, at)
                value, at = m[0], m.end()
        if wanted:
            out.setdefault(name.lower(), decode(value))


def tokens(html: str, decode: Callable[[str], str] = unescape) -> Iterator[Token]:
    """Tags and texts in order, character references replaced by `decode`. Comments and declarations are left out; what isn't a tag after `<` is text; a tag that never ends hides the rest."""
    at, size = 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            yield "text", decode(html[at:]), None
            return
        follows = html[low + 1 : low + 2]
        if not (follows.isascii() and follows.isalpha()) and follows not in ("/", "!", "?"):
            nxt = html.find("<", low + 1)  # a lone < belongs to the text
            nxt = size if nxt < 0 else nxt
            yield "text", decode(html[at:nxt]), None
            at = nxt
            continue
        if low > at:
            yield "text", decode(html[at:low]), None
        if html.startswith("<!--", low):
            if html.startswith("<!-->", low) or html.startswith("<!--->", low):
                at = html.index(">", low) + 1
                continue
            end = html.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        first = html[low + 2 : low + 3]
        if follows in "!?" or follows == "/" and not (first.isascii() and first.isalpha()):
            end = html.find(">", low)
            at = size if end < 0 else end + 1
            continue
        closing = follows == "/"
        m = _NAME.match(html, low + 1 + closing)
        tag = m[0].lower()
        attributes, at = _attributes(html, m.end(), not closing, decode)
        if at < 0:
            return
        if closing:
            yield "end", tag, None
            continue
        yield "start", tag, attributes
        if tag in _ENDS:
            m = _ENDS[tag].search(html, at)
            end = size if m is None else m.start()
            if end > at:
                yield "text", decode(html[at:end]) if tag in DECODED else html[at:end], None
            at = end
