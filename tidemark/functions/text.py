"""Text columns: word counts, tags, excerpts, hashes, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, in the order in which they are taken out.
SECRETS = [r"sk-ant-[a-zA-Z0-9_-]+", r"sk-[a-zA-Z0-9_-]{20,}", r"eyJ[a-zA-Z0-9_-]+\.eyJ", r"AIza[a-zA-Z0-9_-]{30,}"]


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` worked out once even where `body` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """EX-04: words parted by white space; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), ""))


def short_content(text: Column, least: int = 50) -> Column:
    return word_count(text) < least


def strip_tags(text: Column) -> Column:
    """EX-05: tags become spaces, ends are trimmed; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "), r"^\s+|\s+$", "")


def strip_tags_spaced(text: Column) -> Column:
    """EX-05: like `strip_tags`, with runs of white space as one space."""
    return F.trim(F.regexp_replace(strip_tags(text), r"\s+", " "))


def strip_highlight(text: Column) -> Column:
    """EX-05: span tags alone go."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"</?span[^>]*>", ""))


def visible_text_len(html: Column) -> Column:
    """URL-11: length of what scripts, styles and tags leave, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    return F.length(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def js_shell(status: Column, content_type: Column, html: Column) -> Column:
    return (status == "success") & (F.coalesce(html, F.lit("")) != "") & content_type.contains("html") & (visible_text_len(html) < 200)


def screening_excerpt(text: Column, terms: Column, head: int = 8000, window: int = 2000, most: int = 12500) -> Column:
    """EX-06: the head, and around the first of `terms` that first occurs beyond it a window of text."""
    low = F.lower(text)
    places = F.filter(F.transform(terms, lambda t: F.call_function("locate", F.lower(t), low)), lambda p: p > head + 1)
    at = F.get(places, F.lit(0)) - 1
    start = F.greatest(F.lit(0), at - window // 2)
    more = F.concat(F.substring(text, F.lit(1), F.lit(head)), F.lit("\n[...]\n"), F.substring(text, (start + 1).cast("int"), (F.least(F.length(text), at + window) - start).cast("int")))
    return F.when(F.length(text) <= head, text).otherwise(F.substring(F.when(at.isNull(), F.substring(text, F.lit(1), F.lit(head))).otherwise(more), 1, most))


def content_hash(text: Column) -> Column:
    """CD-01: 16 hex digits of SHA-256 over the full text; that of '' for null."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def redact(text: Column, mark: str = "[REDACTED]") -> Column:
    """SG-06: secrets become `mark`."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
    return text


def contains_any(text: Column, phrases: list[str]) -> Column:
    """KW-01, SR-01: any phrase occurs, whatever case."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out
