"""News items, logs, events and limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..durable import durable
from ..graph import connected_components
from .changes import first_rows
from .store import add_leads

ARTICLES = "articles array<struct<title: string, url: string, sourcecountry: string>>"
LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}
WINDOW_US = 60_000_000


def parse_news_json(payloads: DataFrame) -> DataFrame:
    """SG-01: items (origin_query, title, url, snippet, jurisdiction_guess) of JSON payloads; bad JSON gives none."""
    rows = payloads.select("origin_query", "seq", F.posexplode(F.from_json("body", ARTICLES)["articles"]).alias("position", "a"))
    country = F.coalesce("a.sourcecountry", F.lit(""))
    return rows.filter("coalesce(a.url, '') <> '' and coalesce(a.title, '') <> ''").select("seq", "position", "origin_query", F.col("a.title").alias("title"), F.col("a.url").alias("url"), country.alias("snippet"), country.alias("jurisdiction_guess"))


def rss_field(block: Column, name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1), r"^\s+|\s+$", ""))


def parse_rss(payloads: DataFrame) -> DataFrame:
    """SG-02: items of RSS payloads that have a title and a link; snippets of 300 characters at most."""
    blocks = payloads.select("origin_query", "seq", F.posexplode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1))).alias("position", "block"))
    out = blocks.select("seq", "position", "origin_query", rss_field(F.col("block"), "title").alias("title"), rss_field(F.col("block"), "link").alias("url"), F.substring(rss_field(F.col("block"), "description"), 1, 300).alias("snippet"), F.lit("").alias("jurisdiction_guess"))
    return out.filter("title <> '' and url <> ''")


def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


#: Rounds of SG-03 before what is left is taken in order.
ROUNDS = 4


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of (group, seq) those whose url and title no kept row of the group has."""
    group, urls, titles = None, set(), set()
    for b in batches:
        kept = []
        for g, seq, url, title in zip(b["group"], b["seq"], b["url"], b["_title"]):
            if g != group:
                group, urls, titles = g, set(), set()
            if url not in urls and title not in titles:
                urls.add(url)
                titles.add(title)
                kept.append(seq)
        yield pd.DataFrame({"seq": pd.Series(kept, dtype="int64")})


def dedupe_items(items: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """SG-03: items kept in order of seq: one goes if an earlier kept item has its url or its title; null is a value like any other.

    Items with the same url and title as an earlier one are always repeats; they go first, by one aggregation. Then come a few
    rounds: an undecided item that is the first of both its url and its title stays, and all that share either with it go. They
    settle nearly all, also in large groups. What is left are chains of items that share url and title in turn: these are grouped by
    connected components, and each component is streamed in order once, so the number of jobs grows with the logarithm of a chain's
    length only. A task holds the urls and titles kept of one component's undecided items.
    """
    item = F.struct(F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNull().alias("n"))
    keyed = items.withColumn("_title", title_key(F.col("title"))).select("seq", F.xxhash64(item).alias("_u"), "url", F.xxhash64(F.lit("title"), F.coalesce("_title", F.lit("")), F.col("_title").isNull()).alias("_t"), "_title")
    open_ = durable(first_rows(keyed, ["url", "_title"], [F.col("seq")]))
    kept = open_.select("seq").limit(0)
    for _ in range(rounds):
        if open_.isEmpty():
            break
        least = lambda c: open_.groupBy(c).agg(F.min("seq").alias("seq"))
        stay = durable(open_.join(least("_u"), ["_u", "seq"], "left_semi").join(least("_t"), ["_t", "seq"], "left_semi").select("seq", "_u", "_t"))
        kept = kept.union(stay.select("seq"))
        open_ = durable(open_.join(stay.select("_u"), "_u", "left_anti").join(stay.select("_t"), "_t", "left_anti").select(*keyed.columns))
    if not open_.isEmpty():
        group = connected_components(open_.select(F.col("_u").alias("u"), F.col("_t").alias("v")))
        rows = open_.join(group, F.col("_u") == F.col("node")).select(F.col("root").alias("group"), "seq", "url", "_title")
        kept = kept.union(rows.repartition("group").sortWithinPartitions("group", "seq").mapInPandas(_greedy, "seq long"))
    return items.join(kept, "seq", "left_semi")


def triage_items(items: DataFrame, verdicts: DataFrame, cap: int = 50) -> DataFrame:
    """SG-04: the first `cap` items (by index) whose verdict is relevant, with the verdict's jurisdiction, if any, and name in front of the snippet: `name — snippet`."""
    v = verdicts.filter("relevant").select("index", F.col("jurisdiction").alias("_place"), F.col("policy_name").alias("_name"))
    name = F.coalesce("_name", F.lit(""))
    joined = items.join(v, "index").withColumn("jurisdiction_guess", F.coalesce(F.nullif("_place", F.lit("")), "jurisdiction_guess"))
    return joined.withColumn("snippet", F.when(name != "", F.concat(name, F.lit(" — "), F.coalesce("snippet", F.lit("")))).otherwise(F.col("snippet"))).drop("_place", "_name").orderBy("index").limit(cap)


def news_leads(items: DataFrame, verdicts: DataFrame | None, leads: DataFrame, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """SG-04: the new leads of a sweep and one row of counts (items_seen, items_kept, leads_added). `items` are (index, title, url, snippet,
    jurisdiction_guess); without verdicts all are kept, in both cases `cap` at most; what `leads` (source_url, snippet) has isn't added."""
    kept = items.orderBy("index").limit(cap) if verdicts is None else triage_items(items, verdicts, cap)
    batch = kept.select(F.col("index").alias("seq"), "title", F.col("url").alias("source_url"), "snippet", "jurisdiction_guess", F.lit("news").alias("origin"))
    added = durable(add_leads(leads, batch))
    counts = items.agg(F.count("*").alias("items_seen")).join(F.broadcast(kept.agg(F.count("*").alias("items_kept")))).join(F.broadcast(added.agg(F.count("*").alias("leads_added"))))
    return added, counts


def query_logs(df: DataFrame, level: str | None = None, scan_id: str | None = None, session_id: str | None = None, event: str | None = None, limit: int = 100) -> DataFrame:
    """SG-05: lines of a level or above, newest first."""
    if level:
        rank = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
        df = df.filter(F.coalesce(rank[F.lower("level")], F.lit(0)) >= LEVELS[level.lower()])
    for name, value in (("scan_id", scan_id), ("session_id", session_id), ("event", event)):
        if value:
            df = df.filter(F.col(name) == value)
    return df.orderBy(F.col("seq").desc()).limit(limit)


#: SG-07: what each type of event adds to a domain's progress.
COUNTERS = {"crawled": "view", "matched": "click", "policies": "purchase", "errors": "error"}


def progress(events: DataFrame, counters: dict[str, str] = COUNTERS) -> DataFrame:
    """SG-07: counters per scan and domain; the same expression for batch and stream."""
    return events.groupBy("scan_id", "domain_id").agg(F.count("*").alias("events"), *(F.count_if(F.col("type") == t).alias(n) for n, t in counters.items()))


def event_history(events: DataFrame, n: int = 1000) -> DataFrame:
    """SG-08: the first n events of each scan."""
    turn = F.row_number().over(W.partitionBy("scan_id").orderBy("ts", "event_id"))
    return events.withColumn("position", turn).filter(F.col("position") <= n)


def decide(times: list[int], recent: deque[int], per_minute: int) -> list[int | None]:
    """Microseconds to wait for each request of a key in order, None if it is allowed; `recent` is left with the allowed times still in the window."""
    out: list[int | None] = []
    for t in times:
        while recent and t - recent[0] > WINDOW_US:
            recent.popleft()
        if len(recent) >= per_minute:
            out.append(WINDOW_US - (t - recent[0]))
        else:
            recent.append(t)
            out.append(None)
    return out


def _limited(per_minute: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, deque()
        for b in batches:
            times, block, waits = b["_us"].to_numpy(), b["_block"].to_numpy(), []
            key = b["key"]
            same = (key == key.shift()) | (key.isna() & key.shift().isna())
            cuts = np.flatnonzero((~same.to_numpy()[1:]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(b)]):
                at = (None if pd.isna(key.iloc[low]) else key.iloc[low], block[low])
                if at != now:
                    now, recent = at, deque()
                waits += decide(times[low:high].tolist(), recent, per_minute)
            b = b.assign(wait_s=pd.Series([None if w is None else w / 1e6 for w in waits], index=b.index, dtype="float64"))
            yield b[b["_own"]].drop(columns=["_us", "_block", "_own"])

    return run


def rate_limit(requests: DataFrame, per_minute: int) -> DataFrame:
    """SG-09: adds wait_s (null if allowed) to requests (key, ts, request_id): fewer than `per_minute` allowed ones in the last 60 s.

    A request with fewer than `per_minute` requests of its key in the 60 s before it is allowed whatever came of those; counts tell that, minute by
    minute, so a hot key is spread over its minutes. Only minutes with another request are contested. Contested minutes without a
    free one between them are a block, whose requests are decided in order, after those of the free minute before it, of which all are allowed: at most
    `per_minute` times are held. So a key is one task's work only as long as it is over the limit without a pause. Null is a key of its own;
    a null ts is never over the limit.
    """
    if per_minute < 1:
        raise ValueError("per_minute is 1 at least")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.select("key", "ts", "request_id", us.alias("_us")).withColumn("_minute", F.floor(F.col("_us") / WINDOW_US))
    # each request in its minute, and as one that came before in the next
    spread = rows.select("key", "_us", "request_id", F.col("_minute").alias("_of"), F.explode(F.array("_minute", F.col("_minute") + 1)).alias("_minute"))
    earlier = F.lag("_us", per_minute).over(W.partitionBy("key", "_minute").orderBy("_us", "request_id"))
    busy = spread.withColumn("_earlier", earlier).filter((F.col("_of") == F.col("_minute")) & (F.col("_us") - F.col("_earlier") <= WINDOW_US))
    minutes = busy.select("key", "_minute").distinct()
    in_order = W.partitionBy("key").orderBy("_minute")
    opens = F.coalesce(F.col("_minute") - F.lag("_minute").over(in_order) > 1, F.lit(True))
    blocks = durable(minutes.withColumn("_opens", opens).withColumn("_block", F.max(F.when(F.col("_opens"), F.col("_minute"))).over(in_order)))
    before = blocks.filter("_opens").select("key", (F.col("_minute") - 1).alias("_minute"), "_block", F.lit(False).alias("_own"))
    wanted = blocks.select("key", "_minute", "_block", F.lit(True).alias("_own")).union(before).select(F.col("key").alias("_k"), F.col("_minute").alias("_m"), "_block", "_own")
    here = F.col("key").eqNullSafe(F.col("_k")) & (F.col("_minute") == F.col("_m"))
    columns = ["key", "ts", "request_id"]
    free = rows.join(wanted.filter("_own"), here, "left_anti").select(*columns, F.lit(None).cast("double").alias("wait_s"))
    contested = rows.join(wanted, here).select(*columns, "_us", "_block", "_own").repartition("key", "_block").sortWithinPartitions("key", "_block", "_us", "request_id")
    schema = T.StructType([*(requests.schema[c] for c in columns), T.StructField("wait_s", T.DoubleType())])
    return free.union(contested.mapInPandas(_limited(per_minute), schema))


def daily_usage(allowed: DataFrame, limit: int) -> DataFrame:
    """SG-10: used and remaining per day, over all keys."""
    return allowed.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def monthly_usage(calls: DataFrame, limit: int = 30000, run_cap: int = 1000) -> DataFrame:
    """SG-11: calls per month, what remains, and how many a run may make."""
    out = calls.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("queries").alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))
    return out.withColumn("run_cap", F.least(F.lit(run_cap), F.col("remaining")))
