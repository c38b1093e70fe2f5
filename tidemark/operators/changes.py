"""Change detection: content cache lookups and upserts, changed-record and new-only differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RELEVANT_DAYS, IRRELEVANT_DAYS = 30, 7


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by `order`; null keys are a key."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def expiry(text: Column) -> Column:
    """A stored expiry as a timestamp; null where it is missing or can't be read."""
    return F.try_to_timestamp(text)


def cache_lookup(pages: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """CD-02: adds `cache_state` (hit, miss, expired, content_changed) by url.

    A lookup without a hash doesn't look at content; an entry without a hash never matches one.
    """
    entry = cache.select(F.col("url").alias("_url"), F.col("content_hash").alias("_stored"), F.col("expires_date").alias("_expires"))
    end = expiry(F.col("_expires"))
    asked, stored = F.coalesce(F.col("content_hash"), F.lit("")), F.coalesce(F.col("_stored"), F.lit(""))
    state = (
        F.when(F.col("_url").isNull(), "miss")
        .when(end.isNull() | (now >= end), "expired")
        .when((asked != "") & ((stored == "") | (asked != stored)), "content_changed")
        .otherwise("hit")
    )
    return pages.join(entry, F.col("url") == F.col("_url"), "left").withColumn("cache_state", state).drop("_url", "_stored", "_expires")


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """CD-05: hits, misses (expired and changed entries included) and hit_rate, 0 where there were no lookups."""
    hit = F.count_if(F.col("cache_state") == "hit")
    out = looked_up.agg(hit.alias("hits"), F.count_if(F.col("cache_state") != "hit").alias("misses"), F.count_if(F.col("cache_state") == "expired").alias("expired"), F.count_if(F.col("cache_state") == "content_changed").alias("content_changed"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def cache_entries(verdicts: DataFrame, now: Column, days: int = RELEVANT_DAYS) -> DataFrame:
    """CD-03: cache rows of `verdicts` (url, seq, is_relevant, relevance_score, content_hash, policy_type), of each url the last one."""
    lifetime = F.when(F.col("is_relevant"), days).otherwise(min(days, IRRELEVANT_DAYS))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    last = first_rows(verdicts, ["url"], [F.col("seq").desc()])
    return last.select("url", "is_relevant", "relevance_score", "content_hash", stamp(now).alias("analyzed_date"), stamp(F.timestamp_add("DAY", lifetime, now)).alias("expires_date"), "policy_type")


def cache_upsert(cache: DataFrame, verdicts: DataFrame, now: Column, days: int = RELEVANT_DAYS) -> DataFrame:
    """CD-03: the cache with `verdicts` written into it; the last write wins. Gives the whole cache: `BucketedStore.upsert` of `cache_entries` writes only what changes."""
    new = cache_entries(verdicts, now, days)
    old = cache.select(*new.columns)
    return old.join(new.select(F.col("url").alias("_url")), F.col("url").eqNullSafe(F.col("_url")), "left_anti").union(new)


def cache_purge(cache: DataFrame, now: Column) -> DataFrame:
    """CD-04: entries that haven't expired; a missing or bad expiry counts as expired."""
    return cache.filter(F.coalesce(expiry(F.col("expires_date")) > now, F.lit(False)))


def changed_records(incoming: DataFrame, seen: DataFrame, key: str = "record_id", mark: str = "change_hash") -> DataFrame:
    """CD-06: records that are new or whose hash isn't the stored one."""
    old = seen.select(F.col(key).alias("_key"), F.col(mark).alias("_mark"), F.lit(True).alias("_known"))
    joined = incoming.join(old, F.col(key) == F.col("_key"), "left")
    return joined.filter(F.col("_known").isNull() | ~F.col(mark).eqNullSafe(F.col("_mark"))).drop("_key", "_mark", "_known")


def measure_key(country: Column, title: Column) -> Column:
    return F.sha2(F.concat(country, F.lit("|"), title), 256)


def new_measures(measures: DataFrame, seen: DataFrame, cap: int = 25) -> DataFrame:
    """CD-07: measures (seq, celex, country, title, link) unseen under their directive, of each link the first, `cap` at most."""
    keyed = measures.withColumn("key", measure_key(F.col("country"), F.col("title")))
    fresh = keyed.join(seen.select("celex", "key"), ["celex", "key"], "left_anti")
    once = first_rows(fresh, ["link"], [F.col("seq")])
    return once.orderBy("seq").limit(cap)


def mark_seen(seen: DataFrame, found: DataFrame) -> DataFrame:
    """CD-07: the seen-set (celex, key) after a run that took the measures `found`."""
    return seen.select("celex", "key").union(found.select("celex", "key")).distinct()
