"""The markup tokenizer, and the time that links and texts of hostile pages take."""

from __future__ import annotations

import re
import time

import pytest

from tidemark.functions.markup import tokens
from tidemark.operators import extract, frontier


def test_tokens():
    html = "<!DOCTYPE html><P Class='a b' class=c data-x = \"1 > 0\" checked>1 &lt; 2 < 3 <b/>x</P ><!-- <a href=no> --><script>if (a<b) '</p>' </script><title>A &amp; <b></title></>z</ 5><? x ><!-->q<!--->&eacute"
    assert list(tokens(html)) == [
        ("start", "p", {"class": "a b", "data-x": "1 > 0", "checked": ""}), ("text", "1 < 2 < 3 ", None), ("start", "b", {}), ("text", "x", None), ("end", "p", None),
        ("start", "script", {}), ("text", "if (a<b) '</p>' ", None), ("end", "script", None), ("start", "title", {}), ("text", "A & <b>", None), ("end", "title", None),
        ("text", "z", None), ("text", "q", None), ("text", "é", None),
    ]
    assert list(tokens("")) == [] and list(tokens("a <")) == [("text", "a <", None)] and list(tokens("a<b c='x>")) == [("text", "a", None)]
    assert list(tokens("<style>p{}")) == [("start", "style", {}), ("text", "p{}", None)]
    assert list(tokens("<a =b href=x?a=1&amp;b=2/>t")) == [("start", "a", {"=b": "", "href": "x?a=1&b=2/"}), ("text", "t", None)]


HOSTILE = {
    "open tags": lambda n: "<a x " * (n // 5),
    "open quotes": lambda n: "<a href='" * (n // 9),
    "lone brackets": lambda n: "<" * n,
    "comments": lambda n: "<!-- " * (n // 5),
    "declarations": lambda n: "<!x " * (n // 4),
    "scripts": lambda n: "<script>" * (n // 8),
    "depth and stray ends": lambda n: "<div>" * (n // 16) + "</p>" * (n // 8) + "x",
    "closed depth": lambda n: "<div><p>" * (n // 16) + "</div>" * (n // 12),
    "references": lambda n: "&" * n,
    "equals": lambda n: "<a " + "= " * (n // 2),
    "names": lambda n: "<a " + "x" * n,
    "end tags": lambda n: "</a " * (n // 4),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    config = extract.Config()
    patterns, content = re.compile("|".join(config.remove_patterns), re.I), [re.compile(p, re.I) for p in config.content]
    page = HOSTILE[kind](1_000_000)
    began = time.process_time()
    sum(1 for _ in tokens(page))
    extract.extract_page(page, config, patterns, content)
    assert time.process_time() - began < 8  # what grows with the square takes minutes


def test_links_as_a_parser_gives_them(spark):
    html = """<a data-href="/no" HREF='/yes?a=1&amp;b=2&copy=3#top'>x</a><!-- <a href="/comment">--><script>"<a href='/script'>"</script>
    <a class="href=/no" href = /bare>y</a><A HREF="//other.org/x">z</A><a href="  /spaced ">w</a><a href>none</a><a href="mailto:x@y.z">m</a><style><a href="/style"></style>"""
    df = spark.createDataFrame([(1, "https://s.gov/d/p", html), (2, None, "<a href='/x'>"), (3, "https://s.gov/", None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.dst_url) for r in frontier.extract_links(df).collect())
    assert got == [(1, "https://s.gov/bare"), (1, "https://s.gov/d/p"), (1, "https://s.gov/spaced "), (1, "https://s.gov/yes?a=1&b=2©=3")]
