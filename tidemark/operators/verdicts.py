"""Model verdicts to policies: JSON cuts, coercion, routing, expansion and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for nothing, words for yes, stages and types.
NULLS = ["null", "None", "N/A", "n/a", "", "unknown", "Unknown", "nicht verfügbar", "non disponible", "不明", "não disponível"]
YES = ["true", "yes", "1", "ja", "oui", "sí", "是", "да", "sim"]
STAGES = ["proposed", "consultation", "in_committee", "passed", "enacted", "amended", "unknown", "transposition_notified"]
TYPES = ["law", "regulation", "directive", "incentive", "tax_incentive", "grant", "plan", "requirement", "standard", "guidance", "matching_platform", "unknown"]
NO_EXPLANATION = "No explanation provided"
ONE = "is_relevant string, relevance_score string, policy_type string, policy_name string, jurisdiction string, summary string, key_requirements string, effective_date string, bill_number string, confidence string, lifecycle_stage string, referenced_policies string, referenced_urls string, relevance_explanation string, source_language string"
#: A reply: the fields of one policy, and the further ones that the page has.
ANALYSIS = f"{ONE}, additional_policies array<struct<{ONE}>>"


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text that begins with one; other texts as they are."""
    # pieces that begin with a brace; the object ends with the one that closes as many as were opened
    pieces = F.transform(F.split(text, r"(?=[{}])"), lambda p: F.struct(F.when(p.startswith("{"), 1).otherwise(-1).alias("step"), F.length(p).alias("size")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + p["step"]
        return F.when(a["end"] >= 0, a).otherwise(F.struct(depth.alias("depth"), (a["at"] + p["size"]).alias("at"), F.when(depth == 0, a["at"]).otherwise(-1).alias("end")))

    end = F.aggregate(pieces, start, step)["end"]
    simple = text.rlike(r"(?s)^\{[^{}]*\}$")  # nothing to look for: one object without others in it
    return F.when(~text.startswith("{") | simple, text).otherwise(F.when(end >= 0, F.substring(text, F.lit(1), end + 1)).otherwise(text))


def extract_json(raw: Column) -> Column:
    """PV-01: the JSON of a reply: what a json fence holds, else what a fence holds, else the first balanced object, else all."""
    raw = F.coalesce(raw, F.lit(""))
    fence = lambda mark: F.trim(F.regexp_replace(F.get(F.split(F.get(F.split(raw, mark), F.lit(1)), "```"), F.lit(0)), r"^\s+|\s+$", ""))
    return F.coalesce(F.when(raw.contains("```json"), fence("```json")), F.when(raw.contains("```"), fence("```")), first_object(F.regexp_replace(raw, r"^\s+|\s+$", "")))


def truth(text: Column) -> Column:
    """Words for yes, and numbers but 0."""
    return F.coalesce(F.lower(text).isin(*YES) | (text.rlike(r"^-?\d+(\.\d+)?$") & (text.try_cast("double") != 0)), F.lit(False))


def score(text: Column) -> Column:
    """"8/10" and "8 of ten" are 8; 0 to 10; 0 where it can't be read."""
    n = F.get(F.split(F.get(F.split(text, "/"), F.lit(0)), " "), F.lit(0)).try_cast("double")
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(n.cast("int"), F.lit(0))))


def no_null(text: Column, empty: Column) -> Column:
    return F.when(text.isNull() | text.isin(*NULLS), empty).otherwise(text)


def text_list(text: Column) -> Column:
    """A JSON list, or one text, as an array without null-like items."""
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | text.isin(*NULLS), none).otherwise(F.coalesce(F.filter(items, lambda x: x.isNotNull() & ~x.isin(*NULLS)), none))


def coerced(verdict: Column) -> Column:
    """One verdict, a struct of texts, with its values made regular."""
    c = lambda n: verdict[n]
    relevant, empty, none = truth(c("is_relevant")), F.lit(""), F.lit(None).cast("string")
    kind = no_null(c("policy_type"), F.when(relevant, "unknown").otherwise("not_relevant"))
    return F.struct(
        relevant.alias("is_relevant"), score(c("relevance_score")).alias("relevance_score"), kind.alias("policy_type"),
        *(no_null(c(n), empty).alias(n) for n in ("policy_name", "jurisdiction", "summary", "key_requirements")), no_null(c("relevance_explanation"), F.lit(NO_EXPLANATION)).alias("relevance_explanation"),
        *(no_null(c(n), none).alias(n) for n in ("effective_date", "bill_number")), F.coalesce(c("source_language"), F.lit("English")).alias("source_language"),
        F.when(c("lifecycle_stage").isin(*STAGES), c("lifecycle_stage")).otherwise("unknown").alias("lifecycle_stage"),
        text_list(c("referenced_policies")).alias("referenced_policies"), text_list(c("referenced_urls")).alias("referenced_urls"),
    )


def coerce_verdicts(df: DataFrame, column: str = "analysis") -> DataFrame:
    """PV-02: `column`, a struct of texts as ANALYSIS has them, made regular, and `additional`, its further policies by the same rules; none where these aren't a list of objects."""
    more = F.col(column)["additional_policies"]
    extras = F.transform(F.filter(F.coalesce(more, F.array().cast(f"array<struct<{ONE}>>")), lambda v: v.isNotNull()), coerced)
    return df.select(*(c for c in df.columns if c not in (column, "additional")), coerced(F.col(column)).alias(column), extras.alias("additional"))


def route_screening(df: DataFrame, min_confidence: int = 5) -> DataFrame:
    """PV-03: adds confidence (1 to 10) and route: a reject stands only if it is confident; what can't be read goes on."""
    confidence = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.col("confidence").try_cast("int"), F.lit(5))))
    relevant = F.coalesce(F.col("relevant"), F.lit(True))
    return df.withColumn("confidence", confidence).withColumn("route", F.when(relevant, "analyse").when(F.col("confidence") >= min_confidence, "reject").otherwise("escalate"))


def to_policies(df: DataFrame) -> DataFrame:
    """PV-04, PV-05: policies of coerced verdicts (url, seq, analysis, additional, source_stage): the primary one, then the additional ones, relevant ones only.

    The page's language, domain_id and scan_id go with each of its policies, where `df` has them.
    """
    own = [F.col(c) if c in df.columns else F.lit(other).alias(c) for c, other in (("language", None), ("domain_id", ""), ("scan_id", ""))]
    each = df.select("url", "seq", "source_stage", *own, F.posexplode(F.concat(F.array("analysis"), F.coalesce("additional", F.slice(F.array("analysis"), 1, 0)))).alias("position", "p")).filter("p.is_relevant")
    p = lambda n: F.coalesce(F.col(f"p.{n}"), F.lit(""))
    place = F.when(p("jurisdiction") == "", "Unknown jurisdiction").otherwise(p("jurisdiction"))
    kind = F.when(p("policy_type").isin("", "unknown", "not_relevant"), "policy").otherwise(p("policy_type"))
    name = F.when(p("policy_name") == "", F.concat(F.lit("Untitled "), kind, F.lit(" ("), place, F.lit(")"))).otherwise(p("policy_name"))
    day = F.when(p("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(p("effective_date")))
    return each.select(
        "url", "seq", "position", name.alias("policy_name"), F.when(p("jurisdiction") == "", "Unknown").otherwise(p("jurisdiction")).alias("jurisdiction"),
        F.when(p("policy_type").isin(*TYPES), p("policy_type")).otherwise("unknown").alias("policy_type"), p("summary").alias("summary"), F.col("p.relevance_score").alias("relevance_score"),
        day.alias("effective_date"), F.coalesce(F.nullif("source_stage", F.lit("")), p("lifecycle_stage")).alias("lifecycle_stage"), p("key_requirements").alias("key_requirements"),
        F.coalesce("language", p("source_language")).alias("source_language"), "domain_id", "scan_id", F.col("p.referenced_policies").alias("referenced_policies"), F.col("p.referenced_urls").alias("referenced_urls"),
    )


def llm_cost(calls: DataFrame) -> DataFrame:
    """PV-06: cost in dollars per scan_id of calls (scan_id, kind screening or analysis, input_tokens, output_tokens)."""
    n = calls.groupBy("scan_id").agg(F.count_if(F.col("kind") == "screening").alias("s"), F.count_if(F.col("kind") == "analysis").alias("a"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    share = F.when((F.col("s") > 0) & (F.col("a") > 0), F.col("s") / (F.col("s") + F.col("a"))).otherwise(F.lit(0.0))
    price = lambda small, large: share * small + (1 - share) * large
    return n.select("scan_id", F.round((F.col("i") * price(0.25, 3.0) + F.col("o") * price(1.25, 15.0)) / 1000000, 4).alias("total_usd"))
