"""The link graph of stored pages: links, sitemaps, page budgets and reach."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..durable import durable
from ..functions.markup import tokens
from ..functions.urls import netloc, path_allowed, same_site, url_priority

def extract_links(pages: DataFrame, extensions: tuple[str, ...] = (), blocked: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> DataFrame:
    """URL-05: (page_id, src_url, dst_url) of every a[href]: absolute, http(s), on the page's site, without fragment, each once a page.

    Hrefs are found and resolved in vectorized tasks, which drop repeats before rows are made. Comments, scripts and styles hold no links.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                seen = {}
                for kind, tag, attributes in tokens(html or ""):
                    if kind != "start" or tag != "a" or "href" not in attributes:
                        continue
                    try:
                        full = urlsplit(urljoin(url or "", attributes["href"]))
                    except ValueError:
                        continue
                    if full.scheme in ("http", "https"):
                        seen[f"{full.scheme}://{full.netloc}{full.path}" + (f"?{full.query}" if full.query else "")] = None
                rows += [(page, url, x) for x in seen]
            yield pd.DataFrame(rows, columns=["page_id", "src_url", "dst_url"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, src_url string, dst_url string")
    return found.filter(same_site(netloc(F.col("dst_url")), netloc(F.col("src_url"))) & path_allowed(F.col("dst_url"), extensions, blocked, allowed))


def sitemap_urls(sitemaps: DataFrame, max_urls: int = 200, max_nested: int = 5) -> DataFrame:
    """URL-06: (site, kind, loc, position) of sitemaps (site, seq, body): kind sitemap for .xml targets, the first `max_nested`, else url, the first `max_urls`."""
    rows = sitemaps.select("site", "seq", F.posexplode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("position", "loc"))
    rows = rows.withColumn("kind", F.when(F.lower("loc").endswith(".xml"), "sitemap").otherwise("url"))
    turn = F.row_number().over(W.partitionBy("site").orderBy("seq", "position"))
    # each kind with a limit of its own, so that tasks keep a site's first rows before the shuffle
    first = lambda kind, most: rows.filter(F.col("kind") == kind).withColumn("turn", turn).filter(F.col("turn") <= most)
    return first("url", max_urls).union(first("sitemap", max_nested)).select("site", "kind", "loc", F.col("turn").alias("position"))


def frontier_topk(urls: DataFrame, max_pages: int | Column = 200) -> DataFrame:
    """URL-07: per domain the URLs of highest priority, then first found, within the page budget.

    Spark keeps the best rows of a domain in each task before the shuffle (window group limit), so a domain
    that owns most URLs sends no more than its budget from each.
    """
    turn = F.row_number().over(W.partitionBy("domain").orderBy(F.col("priority").desc(), "seq"))
    return urls.withColumn("priority", url_priority(F.col("url"))).withColumn("turn", turn).filter(F.col("turn") <= max_pages)


#: A page is a hub if it has more than one in so many of all links; its links are dealt to so many parts.
HUB_SHARE, HUB_PARTS = 1000, 64
#: Rows of a level up to which it is given to all tasks.
SMALL_LEVEL = 100_000


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, small: int = SMALL_LEVEL) -> DataFrame:
    """URL-08: (url, depth): each URL within `max_depth` links of a seed, at its least depth; one join a level, each checkpointed.

    The links are made distinct and written once, however many levels are walked, those of a hub (there are fewer than HUB_SHARE) dealt to
    HUB_PARTS parts, each of which a hub in the level meets. A level of at most `small` rows, which are counted, is broadcast, so its links stay where they are.
    """
    links = durable(edges.select("src_url", "dst_url").filter("src_url is not null and dst_url is not null").distinct())
    total = links.count()
    hubs = durable(links.groupBy("src_url").count().filter(F.col("count") * HUB_SHARE > total).select(F.col("src_url").alias("_hub")))
    of_hub = F.col("_hub").isNotNull()
    part = F.when(of_hub, F.pmod(F.xxhash64("dst_url"), F.lit(HUB_PARTS))).otherwise(0).cast("int")
    links = durable(links.join(F.broadcast(hubs), F.col("src_url") == F.col("_hub"), "left").select("src_url", "dst_url", part.alias("part")))
    level = durable(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        if level.count() <= small:
            reached = links.join(F.broadcast(level), F.col("url") == F.col("src_url"), "left_semi")
        else:
            parts = F.when(of_hub, F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).otherwise(F.array(F.lit(0)))
            dealt = level.join(F.broadcast(hubs), F.col("url") == F.col("_hub"), "left").select("url", F.explode(parts).alias("_part"))
            reached = links.join(dealt, (F.col("url") == F.col("src_url")) & (F.col("part") == F.col("_part")), "left_semi")
        reached = reached.select(F.col("dst_url").alias("url")).distinct()
        level = durable(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(level)
    return seen
