"""Places: the alias index, free-text resolution, hierarchy rollups and filters.

The registry (slug, name, kind, iso_numeric, parent, members, aliases, seq) is joined with, never collected. Free texts
are resolved once per distinct text and joined back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from .changes import first_rows

LOCAL_KINDS = ("us_state", "subnational")

# Names of the same place, for matching questions with stored texts.
ALIAS_GROUPS = [
    ["us", "usa", "united states", "united states of america", "america"],
    ["uk", "united kingdom", "britain", "great britain"],
    ["eu", "european union"],
    ["uae", "united arab emirates"],
    ["south korea", "korea", "republic of korea"],
    ["czech republic", "czechia"],
]


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def alias_index(registry: DataFrame) -> DataFrame:
    """PL-01: alias -> slug; slugs, then names, then aliases; of one alias the first row of the registry wins. `collides` tells that others had it."""
    names = F.concat(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    long = registry.select("slug", "seq", F.posexplode(names).alias("position", "alias")).withColumn("alias", normal(F.col("alias"))).filter("alias <> ''")
    owners = long.groupBy("alias").agg(F.count_distinct("slug").alias("owners"))
    return first_rows(long, ["alias"], [F.col("seq"), F.col("position")]).join(owners, "alias").select("alias", "slug", "seq", (F.col("owners") > 1).alias("collides"))


def country_rollup(registry: DataFrame) -> DataFrame:
    """PL-03: slug -> country: the first country up the parents, however far; null beyond a cycle or a missing parent.

    Each round looks twice as far up as the one before, so as many are needed as the logarithm of the deepest level.
    """
    own = F.when(F.col("kind") == "country", F.col("slug"))
    now = durable(registry.select("slug", own.alias("country"), F.when(own.isNull(), F.col("parent")).alias("at")))
    open_ = F.col("country").isNull() & F.col("at").isNotNull()
    for _ in range(now.count().bit_length()):  # beyond that only cycles are left
        if now.filter(open_).isEmpty():
            break
        up = now.select(F.col("slug").alias("_slug"), F.col("country").alias("_country"), F.col("at").alias("_at"))
        now = durable(now.join(up, F.col("at") == F.col("_slug"), "left").select("slug", F.coalesce("country", "_country").alias("country"), F.when(F.coalesce("country", "_country").isNull(), F.col("_at")).alias("at")))
    return now.select("slug", "country")


def children_of(registry: DataFrame, rollup: DataFrame, slug: str) -> DataFrame:
    """PL-04: states and subnational places whose country is `slug`."""
    return registry.filter(F.col("kind").isin(*LOCAL_KINDS)).join(rollup.filter(F.col("country") == slug), "slug", "left_semi")


def members_of(registry: DataFrame, slug: str) -> DataFrame:
    """PL-05: leaf members of a group, each once, in depth-first order (`position`), however deep they lie."""
    rows = registry.select("slug", F.coalesce("members", F.array().cast("array<string>")).alias("members"))
    inner = durable(rows.select(F.col("slug").alias("_slug"), F.col("members").alias("_members")))
    now = rows.filter(F.col("slug") == slug).select(F.posexplode("members").alias("i", "slug"), F.array(F.lit(slug)).alias("path")).select("slug", F.array("i").alias("order"), "path")
    found = now.limit(0).select("slug", "order")
    while True:
        joined = durable(now.join(inner, F.col("slug") == F.col("_slug")).filter(~F.array_contains("path", F.col("slug"))))
        if joined.isEmpty():
            break
        found = found.union(joined.filter(F.size("_members") == 0).select("slug", "order"))
        now = joined.filter(F.size("_members") > 0).select("order", F.array_append("path", F.col("slug")).alias("path"), F.posexplode("_members").alias("i", "slug")).select("slug", F.array_append("order", F.col("i")).alias("order"), "path")
    return first_rows(found, ["slug"], [F.col("order")]).select("slug", F.col("order").alias("position"))


def holding(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs of rows of which `text` holds `name` as whole words. They meet by the word of the name that fewest names have, so
    no text is compared with all names; a name without any letter or digit is in no text."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(c, r"(?U)\W+"), ""))
    long = names.select(F.col(name).alias("_name"), F.explode(words(F.col(name))).alias("_word")).distinct()
    few = long.join(long.groupBy("_word").agg(F.count("*").alias("_n")), "_word").groupBy("_name").agg(F.min(F.struct("_n", "_word")).alias("_met"))
    keyed = names.join(few, F.col(name) == F.col("_name")).withColumn("_word", F.col("_met._word")).drop("_name", "_met")
    found = texts.withColumn("_word", F.explode(words(F.col(text)))).join(keyed, "_word")
    return found.filter(F.regexp(F.col(text), F.concat(F.lit(r"(?U)\b\Q"), F.col(name), F.lit(r"\E\b")))).drop("_word")


def find_places(probes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(probe, exact, slug) of distinct texts that are an alias (exact) or hold one: the longest, then the first of the registry."""
    whole = probes.join(aliases, F.col("probe") == F.col("alias")).select("probe", F.col("slug").alias("exact"), F.lit(None).cast("struct<o:int,seq:bigint,alias:string,slug:string>").alias("within"))
    part = holding(probes, aliases.withColumn("seq", F.col("seq").cast("long")), "probe", "alias")
    part = part.select("probe", F.lit(None).cast("string").alias("exact"), F.struct((-F.length("alias")).alias("o"), "seq", "alias", "slug").alias("within"))
    best = whole.union(part).groupBy("probe").agg(F.max("exact").alias("exact"), F.min("within").alias("within"))
    return best.select("probe", "exact", F.coalesce("exact", "within.slug").alias("slug"))


def resolve_places(df: DataFrame, registry: DataFrame, column: str = "jurisdiction") -> DataFrame:
    """PL-02: adds `slug`, null if nothing is found. A text that is an alias is that place; else a local place in parentheses
    whose country is that of the text outside; else what is outside: an alias, a local place and its country around a comma,
    the country, the local place, or the longest alias within.

    Each distinct text is looked up once, and each of its parts once for all texts, by joins with the alias index.
    """
    texts = df.select(F.col(column).alias("_text")).distinct().withColumn("low", normal(F.col("_text"))).filter("low <> ''")
    outside, inside = normal(F.regexp_replace("low", r"\([^)]*\)", " ")), normal(F.regexp_extract("low", r"\(([^)]*)\)", 1))
    texts = texts.withColumn("base", F.coalesce(F.nullif(outside, F.lit("")), F.col("low"))).withColumn("bare", outside == "").withColumn("inside", inside)
    at = F.instr("base", ",")
    probe = lambda role, text, i=None: F.struct(F.lit(role).alias("role"), (F.lit(0) if i is None else i + 1).alias("i"), normal(text).alias("probe"))
    parts = F.transform(F.split("inside", ","), lambda x, i: probe("inner", x, i))
    around = F.when(at > 0, F.array(probe("child", F.expr("left(base, instr(base, ',') - 1)")), probe("rest", F.expr("substr(base, instr(base, ',') + 1)"))))
    asked = F.concat(F.array(probe("text", F.col("low")), probe("base", F.col("base")), probe("inner", F.col("inside"))), parts, F.coalesce(around, F.array().cast("array<struct<role:string,i:int,probe:string>>")))
    rows = durable(texts.select("_text", "bare", F.inline(asked)).filter("probe <> ''"))  # read several times, so the input is not
    found = find_places(rows.select("probe").distinct(), durable(alias_index(registry)))
    told = lambda role, value: F.max(F.when(F.col("role") == role, F.col(value))).alias(f"{role}_{value}")
    inner = F.min(F.when((F.col("role") == "inner") & F.col("slug").isNotNull(), F.struct("i", "slug")))
    by_text = rows.join(found, "probe").groupBy("_text", "bare").agg(told("text", "exact"), told("base", "exact"), told("base", "slug"), told("child", "slug"), told("rest", "slug"), inner.alias("inner"))
    about = first_rows(registry, ["slug"], [F.col("seq")]).select("slug", "kind").join(country_rollup(registry).distinct(), "slug")
    for role, slug in (("inner", "inner.slug"), ("base", "base_slug"), ("child", "child_slug")):
        known = about.select(F.col("slug").alias("_slug"), F.col("kind").alias(f"{role}_kind"), F.col("country").alias(f"{role}_country"))
        by_text = by_text.join(known, F.col(slug) == F.col("_slug"), "left").drop("_slug")
    local = ~F.col("bare") & F.col("inner_kind").isin(*LOCAL_KINDS) & (F.col("inner_country") == F.col("base_country"))
    child = F.when(F.col("child_country") == F.col("rest_slug"), F.col("child_slug"))
    slug = F.coalesce("text_exact", F.when(local, F.col("inner.slug")), "base_exact", child, "rest_slug", "child_slug", "base_slug")
    known = by_text.select("_text", slug.alias("slug")).filter("slug is not null")
    return df.join(known, F.col(column) == F.col("_text"), "left").drop("_text")


def unresolved_report(resolved: DataFrame, column: str = "jurisdiction") -> DataFrame:
    """PL-06: texts that weren't resolved, with their rows."""
    return resolved.filter((F.col("slug").isNull()) & (F.trim(F.coalesce(column, F.lit(""))) != "")).groupBy(F.trim(column).alias("text")).agg(F.count("*").alias("hits"))


def unresolved_slugs(domains: DataFrame, registry: DataFrame) -> DataFrame:
    """PL-06: region tags of sources (id, region) that the registry doesn't have, with the sources that carry them."""
    tags = domains.select("id", F.explode("region").alias("slug")).filter("slug is not null").distinct()
    return tags.join(registry.select("slug").distinct(), "slug", "left_anti").groupBy("slug").agg(F.count("*").alias("sources"))


def filter_place(resolved: DataFrame, rollup: DataFrame, slug: str) -> DataFrame:
    """PL-07: rows of the place itself, and of all places of it if it is a country."""
    inside = rollup.filter((F.col("slug") == slug) | (F.col("country") == slug)).select("slug")
    return resolved.join(inside, "slug", "left_semi")


def jurisdiction_matches(query: str, stored: Column) -> Column:
    """PL-08: whether a stored text means the query's place: shared aliases, or either holding the other as a whole word."""
    q, s = query.strip().lower(), F.lower(F.trim(F.coalesce(stored, F.lit(""))))
    if not q:
        return F.lit(True)
    words = lambda needle, hay: re.search(rf"\b{re.escape(needle)}\b", hay) is not None
    asked = {q}.union(*(g for g in map(set, ALIAS_GROUPS) if any(words(m, q) for m in g)))
    held = lambda needle, hay: hay.rlike(rf"\b\Q{needle}\E\b")
    out = F.lit(False)
    for a in sorted(asked):
        out = out | held(a, s)
        out = out | F.regexp(F.lit(a), F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E\b")))
    for g in ALIAS_GROUPS:
        has = F.lit(False)
        for m in g:
            has = has | held(m, s)
        if any(words(x, y) for x in g for y in asked) or any(words(y, x) for x in g for y in asked):
            out = out | has
    return (s != "") & out


def split_jurisdiction(df: DataFrame, places: DataFrame, column: str = "jurisdiction") -> DataFrame:
    """PL-09: adds area, country and region. `places` (name, area, country, region, rank, broad) is a dimension of lower-case
    names; whole texts are looked up first (qualifiers taken off step by step), then narrow names within, by rank."""
    texts = df.select(F.trim(F.coalesce(column, F.lit(""))).alias("_raw")).distinct().filter("_raw <> ''")
    low = F.lower(F.trim(F.regexp_replace(F.translate("_raw", "_-", "  "), r"\s+", " ")))
    texts = texts.withColumn("_low", low)
    bare = F.trim(F.regexp_replace("_low", r"\s*\([^)]*\)\s*$", ""))
    off = lambda c: F.trim(F.regexp_replace(c, r"\bstate\b$", ""))
    tries = texts.select("_raw", "_low", F.posexplode(F.array(F.col("_low"), bare, off(F.col("_low")), off(bare))).alias("_try", "_name"))
    exact = tries.join(places, F.col("_name") == F.col("name")).select("_raw", F.struct(F.lit(0), F.col("_try"), "rank", "area", "country", "region").alias("hit"))
    within = holding(texts, places.filter(~F.col("broad")), "_low", "name").select("_raw", F.struct(F.lit(1), F.lit(0).alias("_try"), "rank", "area", "country", "region").alias("hit"))
    best = exact.union(within).groupBy("_raw").agg(F.min("hit").alias("hit"))
    raw = F.trim(F.coalesce(column, F.lit("")))
    out = df.withColumn("_key", raw).join(best, F.col("_key") == F.col("_raw"), "left")
    part = lambda n, other: F.coalesce(F.col(f"hit.{n}"), other).alias(n)
    return out.select(*df.columns, part("area", F.lit("")), part("country", F.col("_key")), part("region", F.lit("")))


def resolve_search_place(text: Column, tables: list[dict[str, tuple[str, str]]]) -> Column:
    """PL-10: struct(kind, key) of the first alias table that knows the text, without a trailing parenthesis or "countries"."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(normal(text), r"\s*\([^)]*\)$", ""), r"\s+countries$", ""))
    found = []
    for table in tables:
        for name, (kind, key) in table.items():
            found.append(F.when(plain == name, F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"))))
    return F.coalesce(*found)


def suggested_places(names: DataFrame, tables: list[dict[str, tuple[str, str]]], column: str = "name") -> DataFrame:
    """PL-10: suggestions of a search box (name): each of `names` that the search itself resolves, once; to be shown by lower case."""
    return names.select(F.col(column).alias("name")).filter(resolve_search_place(F.col("name"), tables).isNotNull()).distinct().orderBy(F.lower("name"), "name")
