"""Source selection, search plans, scan funnels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .changes import first_rows

#: Estimates: pages of a domain's budget, pages that pass the keywords, screenings that lead to an analysis.
PAGE_SHARE, KEYWORD_SHARE, SCREEN_SHARE = 2, 0.10, 0.50
# Dollars per screening, analysis and audit; ceilings per structured document and website by cost level; documents of a structured source.
SCREEN_USD, ANALYSE_USD, AUDIT_USD = 0.0005625, 0.075, 0.045
DOCUMENT_USD, WEBSITE_USD, DOCUMENTS = {"low": 0.004, "standard": 0.012, "high": 0.06}, {"low": 0.05, "standard": 0.15, "high": 0.60}, 25
BROAD = ["us", "us_states", "eu", "nordic", "apac", "uk", "eu_central", "eu_west", "eu_south", "eu_east", "europe", "north_america", "south_america", "middle_east", "africa"]


def tagged(domains: DataFrame, *columns: str) -> DataFrame:
    """A row for each of a domain's region tags, as `tag`."""
    return domains.select(*columns, F.explode("region").alias("tag"))


def resolve_targets(domains: DataFrame, groups: DataFrame, targets: str) -> DataFrame:
    """SC-01: enabled domains of a comma list, each once, in order of the list: `all`, a group or region tag
    together, else a source file, else an id. A target that names nothing gives a row with `unknown` set."""
    asked = [t.strip() for t in targets.split(",") if t.strip()]
    want = domains.sparkSession.createDataFrame(list(enumerate(asked)), "target_seq int, target string")
    member = groups.select(F.col("group").alias("target"), F.explode("domain_ids").alias("id"))
    on = domains.filter("enabled")
    by = [
        on.select(F.lit("all").alias("target"), "id", F.lit(0).alias("rank")),
        member.select("target", "id", F.lit(1).alias("rank")),
        tagged(domains, "id").select(F.col("tag").alias("target"), "id", F.lit(1).alias("rank")),
        on.select(F.col("source_file").alias("target"), "id", F.lit(2).alias("rank")),
        on.select(F.col("id").alias("target"), "id", F.lit(3).alias("rank")),
    ]
    links = by[0]
    for more in by[1:]:
        links = links.unionByName(more)
    hit = F.broadcast(want).join(links, "target")  # the list asked for, not the links, is sent to all
    best = hit.withColumn("_best", F.min("rank").over(W.partitionBy("target_seq"))).filter("rank = _best").select("target_seq", "target", "id").distinct()
    known = best.join(on, "id")
    chosen = first_rows(known, ["id"], [F.col("target_seq")]).withColumn("unknown", F.lit(False))
    missing = want.join(best.select("target_seq").distinct(), "target_seq", "left_anti").withColumn("unknown", F.lit(True))
    return chosen.unionByName(missing, allowMissingColumns=True)


def filter_domains(df: DataFrame, category: str | None = None, tags: list[str] | None = None, policy_type: str | None = None, region: str | None = None, channel: str | None = None) -> DataFrame:
    """SC-02: enabled domains of a category, with one of the tags, of a policy type, in a region, of a channel."""
    df = df.filter("enabled")
    for name, value in (("category", category), ("channel", channel)):
        if value:
            df = df.filter(F.col(name) == value)
    for name, value in (("policy_types", policy_type), ("region", region)):
        if value:
            df = df.filter(F.array_contains(name, value))
    return df.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else df


def dispatch_order(df: DataFrame) -> DataFrame:
    """SC-03: structured sources first, otherwise as configured."""
    return df.orderBy(F.col("channel") == "crawl", "seq")


def validate_sources(domains: DataFrame, groups: DataFrame, regions: DataFrame) -> DataFrame:
    """SC-04: (problem, value): groups' unknown ids, enabled domains in no group, repeated ids, unknown regions."""
    member = groups.select(F.explode("domain_ids").alias("id")).distinct()
    row = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), F.col(c).alias("value"))
    out = row(member.join(domains, "id", "left_anti"), "unknown_id", "id")
    out = out.union(row(domains.filter("enabled").join(member, "id", "left_anti"), "ungrouped", "id"))
    out = out.union(row(domains.groupBy("id").count().filter("count > 1"), "repeated_id", "id"))
    return out.union(row(tagged(domains).select(F.col("tag").alias("region")).filter("region is not null").distinct().join(regions, "region", "left_anti"), "unknown_region", "region"))


def source_counts(domains: DataFrame, groups: DataFrame, local: DataFrame) -> DataFrame:
    """SC-05: (kind, name, sources): ids listed in each group but `all`, enabled sources of each region tag, which is broad, a
    state (in `local`, of one column `slug`) or a country, and enabled sources in all."""
    on = domains.filter("enabled")
    listed = groups.filter(F.col("group") != "all").select(F.lit("group").alias("kind"), F.col("group").alias("name"), F.coalesce(F.size("domain_ids"), F.lit(0)).cast("long").alias("sources"))
    per_tag = tagged(on, "id").groupBy("tag").agg(F.count("*").alias("sources"))
    told = per_tag.join(local.select(F.col("slug").alias("tag"), F.lit(True).alias("_local")).distinct(), "tag", "left")
    kind = F.when(F.col("tag").isin(*BROAD), "broad").when(F.col("_local"), "state").otherwise("country")
    return listed.union(told.select(kind.alias("kind"), F.col("tag").alias("name"), "sources")).union(on.agg(F.count("*").alias("sources")).select(F.lit("total"), F.lit(""), "sources"))


def outcomes(staged: DataFrame, blocked: Column, screening: Column) -> DataFrame:
    """SC-06: stages of pages with what came after the keywords: `error` for blocked ones, `screened_out` and `llm_skipped` for those that matched and whose
    `screening` is reject or skip."""
    matched = F.col("stage") == "matched"
    stage = F.when(blocked, "error").when(matched & (screening == "reject"), "screened_out").when(matched & (screening == "skip"), "llm_skipped").otherwise(F.col("stage"))
    return staged.withColumn("stage", stage)


def scan_funnel(staged: DataFrame, totals: bool = False) -> DataFrame:
    """SC-06: rows per (scan_id, domain_id) and stage, near misses among the dropped; with `totals` also per scan (domain_id null). Pages that
    screening turned down or that no model saw have matched too."""
    n = lambda s: F.count_if(F.col("stage") == s).alias(f"n_{s}")
    grouped = staged.rollup("scan_id", "domain_id") if totals else staged.groupBy("scan_id", "domain_id")
    out = grouped.agg(F.count("*").alias("crawled"), n("short"), n("excluded"), n("keyword_dropped"), F.count_if((F.col("stage") == "keyword_dropped") & F.col("near_miss")).alias("near_misses"), F.count_if(F.col("stage").isin("matched", "screened_out", "llm_skipped")).alias("n_matched"), n("screened_out"), F.count_if(F.col("stage") == "llm_skipped").alias("llm_skipped"), F.count_if(F.col("stage") == "error").alias("errors"), *((F.sum("policies").alias("policies"),) if "policies" in staged.columns else ()))
    return out.filter("scan_id is not null") if totals else out


def scan_report(funnel: DataFrame, cap: int = 50) -> DataFrame:
    """SC-07: per scan the domains that matched but gave no policies, and those that gave nothing, `cap` of each by domain."""
    kind = F.when((F.col("n_matched") > 0) & (F.col("policies") == 0), "matched_without_policy").when(F.col("n_matched") == 0, "nothing")
    rows = funnel.withColumn("finding", kind).filter("finding is not null")
    turn = F.row_number().over(W.partitionBy("scan_id", "finding").orderBy("domain_id"))
    return rows.withColumn("position", turn).filter(F.col("position") <= cap).select("scan_id", "finding", "domain_id", "position")


def flagged_list(policies: DataFrame, cap: int = 30) -> DataFrame:
    """SC-07: per scan the first `cap` policies with verification flags, by seq: scan_id, position, url, policy_name, verification_flags."""
    turn = F.row_number().over(W.partitionBy("scan_id").orderBy("seq"))
    return policies.filter(F.size(F.coalesce("verification_flags", F.array().cast("array<string>"))) > 0).withColumn("position", turn).filter(F.col("position") <= cap).select("scan_id", "position", "url", "policy_name", "verification_flags")


def estimate_cost(domains: DataFrame, max_pages: int = 200) -> DataFrame:
    """SC-08: domains, pages, screenings, analyses and cost of a scan of the enabled domains: half of `max_pages`, the page budget of
    a domain, for each; a tenth screened, half of these analysed, and one audit."""
    pages = domains.filter("enabled").agg(F.count("*").alias("domains")).withColumn("pages", F.col("domains") * (max_pages // PAGE_SHARE))
    out = pages.withColumn("screenings", F.floor(F.col("pages") * KEYWORD_SHARE).cast("long")).withColumn("analyses", F.floor(F.col("screenings") * SCREEN_SHARE).cast("long"))
    return out.withColumn("usd", F.round(F.col("screenings") * SCREEN_USD + F.col("analyses") * ANALYSE_USD + AUDIT_USD, 2))


def search_plan(domains: DataFrame, place: str, parents: list[str], transposition: bool = False) -> DataFrame:
    """SC-09: enabled sources for a place (id, name, kind, kind_rank), in order of kind_rank and name: websites tagged with the place itself,
    structured sources tagged with it or one of `parents`, and all transposition sources where the place is of the EU (`transposition`)."""
    kind = F.when(F.col("channel") == "crawl", "website").when(F.col("channel") == "transposition", "transposition").otherwise("law_api")
    on = domains.filter("enabled").withColumn("kind", kind)
    covers = F.when(F.col("kind") == "website", F.array_contains("region", place)).when(F.col("kind") == "transposition", F.lit(transposition)).otherwise(F.arrays_overlap("region", F.array(*map(F.lit, [place, *parents]))))
    rank = F.when(F.col("kind") == "law_api", 0).when(F.col("kind") == "transposition", 1).otherwise(2)
    return on.filter(covers).select("id", "name", "kind", rank.alias("kind_rank"))


def plan_ceiling(plan: DataFrame, level: str = "standard") -> DataFrame:
    """SC-09: a plan's sources and the most its model calls may cost, by cost level (an unknown level is the standard one)."""
    level = level if level in DOCUMENT_USD else "standard"
    counts = plan.agg(F.count("*").alias("sources"), F.count_if(F.col("kind") == "website").alias("websites"))
    usd = (F.col("sources") - F.col("websites")) * DOCUMENTS * DOCUMENT_USD[level] + F.col("websites") * WEBSITE_USD[level]
    return counts.withColumn("usd_ceiling", F.round(usd, 2))


def assign_groups(new: DataFrame, mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """SC-10: (group, id) that new domains' regions bring and that aren't listed yet."""
    listed = groups.select("group", F.explode("domain_ids").alias("id"))
    return tagged(new, "id").join(mapping.withColumnRenamed("region", "tag"), "tag").select("group", "id").distinct().join(listed, ["group", "id"], "left_anti")


def followup_urls(policies: DataFrame, pages: DataFrame, same: Column, cap: int = 20) -> DataFrame:
    """URL-09: links that policies (domain_id, base, seq, referenced_urls) cite: http(s), on the domain's site by
    `same` (a condition on link and base), not fetched yet, each once, the first `cap` of a domain."""
    cited = policies.select("domain_id", "base", "seq", F.posexplode("referenced_urls").alias("position", "link")).filter(F.col("link").rlike("(?i)^https?://")).filter(same)
    once = first_rows(cited, ["domain_id", "link"], [F.col("seq"), F.col("position")]).join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    turn = F.row_number().over(W.partitionBy("domain_id").orderBy("seq", "position"))
    return once.withColumn("turn", turn).filter(F.col("turn") <= cap).select("domain_id", "link", "turn")


def followup_counts(policies: DataFrame, pages: DataFrame, same: Column, cap: int = 20) -> DataFrame:
    """URL-09: per domain the cited links that are followed, that are over `cap`, and that lie on other sites: distinct ones, not fetched yet."""
    cited = policies.select("domain_id", "base", F.explode("referenced_urls").alias("link")).filter(F.col("link").rlike("(?i)^https?://"))
    once = cited.select("domain_id", "link", F.coalesce(same, F.lit(False)).alias("same")).groupBy("domain_id", "link").agg(F.max("same").alias("same"))
    new = once.join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_anti").groupBy("domain_id").agg(F.count_if("same").alias("n"), F.count_if(~F.col("same")).alias("cross_site"))
    return new.select("domain_id", F.least(F.col("n"), F.lit(cap)).alias("followed"), F.greatest(F.col("n") - cap, F.lit(0)).alias("over_cap"), "cross_site")
