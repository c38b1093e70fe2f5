"""Coverage of places: policies and distinct sources per country, off-map place and child; totals that add up.

Inputs: policies with `slug` (null if unresolved), sources as (id, slug), the registry and its rollup (all
small but the policies). Counts come from partial aggregation, so one large country is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..durable import durable
from .places import LOCAL_KINDS


def located(df: DataFrame, registry: DataFrame, rollup: DataFrame) -> DataFrame:
    """Adds kind, country, iso, place (country or off-map slug) and spot: country, offmap or unresolved."""
    dims = registry.select("slug", "kind").join(rollup, "slug").join(registry.select(F.col("slug").alias("country"), F.col("iso_numeric").alias("iso")), "country", "left")
    out = df.join(dims.select("slug", "kind", "country", "iso"), "slug", "left")
    spot = F.when(F.col("country").isNotNull() & F.col("iso").isNotNull(), "country").when(F.col("country").isNotNull() | F.col("kind").isin("supranational", "group"), "offmap").otherwise("unresolved")
    return out.withColumn("spot", spot).withColumn("place", F.coalesce("country", "slug"))


def top_names(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """CV-03: names of the k most relevant rows per key: by score descending, then name."""
    score, name = F.coalesce("relevance_score", F.lit(0)), F.coalesce("policy_name", F.lit(""))
    turn = F.row_number().over(W.partitionBy(key).orderBy(score.desc(), name, "seq"))
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_turn", name.alias("name")))).alias("t")).select(key, F.col("t.name").alias("top_policy_names"))


def coverage(policies: DataFrame, sources: DataFrame, registry: DataFrame, rollup: DataFrame) -> DataFrame:
    """CV-01, CV-02, CV-04: spot, place, its name and iso_numeric, policies, sources (distinct), children_with_data and top_policy_names per place with any.

    Group and supranational tags of sources give no place a source.
    """
    # read four times below: written once, with the few columns that are needed
    p = durable(located(policies, registry, rollup).filter("spot <> 'unresolved'").select("place", "spot", "kind", "slug", "seq", "relevance_score", "policy_name"))
    s = located(sources, registry, rollup).filter("country is not null").select("id", "slug", "kind", "place", "spot").distinct()
    local = F.col("kind").isin(*LOCAL_KINDS)
    counts = p.groupBy("place").agg(F.first("spot").alias("p_spot"), F.count("*").alias("policies"))
    tagged = s.select("place", "spot", "id").distinct().groupBy("place").agg(F.first("spot").alias("s_spot"), F.count("*").alias("sources"))
    children = p.filter(local).select("place", "slug").union(s.filter(local).select("place", "slug")).distinct().groupBy("place").agg(F.count("*").alias("children_with_data"))
    both = counts.join(tagged, "place", "full").join(children, "place", "left").join(top_names(p, "place"), "place", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    both = both.join(registry.select(F.col("slug").alias("place"), "name", "iso_numeric"), "place", "left")
    return both.select(F.coalesce("p_spot", "s_spot").alias("spot"), "place", F.coalesce("name", "place").alias("name"), "iso_numeric", zero("policies"), zero("sources"), zero("children_with_data"), F.coalesce("top_policy_names", F.array().cast("array<string>")).alias("top_policy_names"))


def coverage_countries(*args: DataFrame) -> DataFrame:
    """CV-01, in order of policies, then name."""
    return coverage(*args).filter("spot = 'country'").orderBy(F.col("policies").desc(), "name")


def coverage_offmap(*args: DataFrame) -> DataFrame:
    """CV-02, in order of policies, sources, then name."""
    return coverage(*args).filter("spot = 'offmap'").orderBy(F.col("policies").desc(), F.col("sources").desc(), "name")


def coverage_children(policies: DataFrame, sources: DataFrame, registry: DataFrame, rollup: DataFrame, country: str) -> DataFrame:
    """CV-05: one country: bucket `national` or a child's slug, nothing rolled up, empty ones left out; bucket `total` has distinct sources."""
    p, s = (located(df, registry, rollup).filter(F.col("country") == country) for df in (policies, sources))
    bucket = F.when(F.col("slug") == country, "national").otherwise(F.col("slug"))
    both = lambda c: F.explode(F.array(c, F.lit("total"))).alias("bucket")
    n = p.select(both(bucket)).groupBy("bucket").agg(F.count("*").alias("policies"))
    m = s.select("id", both(bucket)).distinct().groupBy("bucket").agg(F.count("*").alias("sources"))
    return n.join(m, "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("policies", "sources")))


def check_reconciles(policies: DataFrame, sources: DataFrame, registry: DataFrame, rollup: DataFrame) -> DataFrame:
    """CV-06: (check, place, parts, total): that the places' own counts and the unresolved policies are all policies, and that each country's national
    policies and those of its children are the country's."""
    by_place = durable(coverage(policies, sources, registry, rollup).select("place", "policies"))
    p = located(policies, registry, rollup)
    unresolved = p.agg(F.count_if(F.col("spot") == "unresolved").alias("unresolved"))
    shown = by_place.agg(F.coalesce(F.sum("policies"), F.lit(0)).alias("shown"))
    whole = policies.agg(F.count("*").alias("total")).join(F.broadcast(unresolved)).join(F.broadcast(shown)).select(F.lit("total").alias("check"), F.lit("").alias("place"), (F.col("shown") + F.col("unresolved")).alias("parts"), "total")
    spots = p.filter("country is not null").groupBy("country", "slug").agg(F.count("*").alias("n"))
    parts = spots.groupBy("country").agg((F.sum(F.when(F.col("slug") == F.col("country"), F.col("n")).otherwise(0)) + F.sum(F.when(F.col("slug") != F.col("country"), F.col("n")).otherwise(0))).alias("parts"))
    countries = rollup.select("country").filter("country is not null").distinct()
    each = countries.join(parts, "country", "left").join(by_place, F.col("country") == F.col("place"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return whole.union(each.select(F.lit("country"), "country", zero("parts"), zero("policies")))


def coverage_totals(policies: DataFrame, sources: DataFrame, registry: DataFrame, rollup: DataFrame) -> DataFrame:
    """CV-06: one row: policies, those on and off the map and unresolved, distinct sources, and whether all of `check_reconciles` add up."""
    p = located(policies, registry, rollup).agg(F.count("*").alias("policies"), *(F.count_if(F.col("spot") == x).alias(x) for x in ("country", "offmap", "unresolved")))
    n = sources.agg(F.count_distinct("id").alias("sources"))
    ok = check_reconciles(policies, sources, registry, rollup).agg(F.bool_and(F.col("parts") == F.col("total")).alias("reconciles"))
    return p.join(F.broadcast(n)).join(F.broadcast(ok))


def coverage_bin(policies: Column, tracked: Column) -> Column:
    """CV-07."""
    return F.when(~tracked, "untracked").when(policies == 0, "0").when(policies <= 5, "1-5").when(policies <= 15, "6-15").otherwise("16+")


def coverage_bins(places: DataFrame, covered: DataFrame) -> DataFrame:
    """CV-07: every place with its policies and bin; places nobody tracks are untracked."""
    joined = places.join(covered.select("place", "policies"), "place", "left")
    return joined.withColumn("bin", coverage_bin(F.col("policies"), F.col("policies").isNotNull())).withColumn("policies", F.coalesce("policies", F.lit(0).cast("long")))


def coverage_browse(*args: DataFrame) -> DataFrame:
    """CV-07: the browse list: countries and off-map places together, by policies, then name."""
    turn = F.row_number().over(W.orderBy(F.col("policies").desc(), "name", "place"))  # places: no more than the registry has
    return coverage(*args).select("place", "name", "spot", "policies").withColumn("position", turn)
