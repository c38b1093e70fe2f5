"""Legislative feeds: term filters, unions of search results, usable records and measure pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any
from .changes import first_rows


def matches_terms(columns: list[Column], terms: list[str]) -> Column:
    """SR-01: any term in any of the columns, whatever case; no terms match all."""
    return contains_any(F.concat_ws(" ", *columns), terms) if terms else F.lit(True)


def union_by_term(df: DataFrame, cap: int = 25) -> DataFrame:
    """SR-08: per source, results of each term in order (term_seq, seq), one per record_id, the first `cap`."""
    once = first_rows(df, ["source", "record_id"], [F.col("term_seq"), F.col("seq")])
    turn = F.row_number().over(W.partitionBy("source").orderBy("term_seq", "seq"))
    return once.withColumn("position", turn).filter(F.col("position") <= cap)


def usable_records(df: DataFrame, speech_chars: int = 60) -> DataFrame:
    """SR-09: records with an official link and content, speeches of `speech_chars` characters or more."""
    text = F.coalesce("body", F.lit(""))
    return df.filter((F.coalesce("official_url", F.lit("")) != "") & (F.trim(text) != "") & ((F.col("kind") != "speech") | (F.length(text) >= speech_chars)))


class _Elements(HTMLParser):
    """Headings, table rows and list items of a page in order: (kind, text, href of the first link)."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str, str]] = []
        self.heading: list[str] | None = None
        self.rows: list[list] = []
        self.link: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h2", "h3"):
            self.heading = []
        elif tag in ("tr", "li"):
            if self.rows and tag == self.rows[-1][0]:
                self.rows.pop()
            self.rows.append([tag, None])
            self.out.append(("row", "", ""))
            self.rows[-1][1] = len(self.out) - 1
        elif tag == "a" and dict(attrs).get("href") is not None:
            self.link = [dict(attrs)["href"], []]

    def handle_data(self, data: str) -> None:
        if self.heading is not None:
            self.heading.append(data)
        if self.link:
            self.link[1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h2", "h3") and self.heading is not None:
            text = "".join(x.strip() for x in self.heading)
            if text:
                self.out.append(("heading", text, ""))
            self.heading = None
        elif tag == "a" and self.link:
            for _, at in self.rows:
                if self.out[at][2] == "":
                    self.out[at] = ("row", "".join(x.strip() for x in self.link[1]), self.link[0])
            self.link = None
        elif tag in ("tr", "li") and any(r[0] == tag for r in self.rows):
            while self.rows.pop()[0] != tag:
                pass


def parse_measures(pages: DataFrame) -> DataFrame:
    """SR-11: (page_id, position, country, title, link) of national-measure pages (page_id, url, html).

    Elements come out in page order; the country is the last heading above, carried by a window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                parser = _Elements()
                parser.feed(html or "")
                parser.close()
                rows += [(page, i, kind, text, urljoin(url or "", href) if href else "") for i, (kind, text, href) in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "text", "href"])

    elements = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, position int, kind string, text string, href string")
    above = W.partitionBy("page_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    country = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(above)
    return elements.withColumn("country", country).filter("kind = 'row' and href <> '' and text <> '' and country is not null").select("page_id", "position", "country", F.col("text").alias("title"), F.col("href").alias("link"))


