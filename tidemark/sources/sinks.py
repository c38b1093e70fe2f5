"""Sinks: the staging layout and back, imports, appends, snapshots and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import scheme
from ..operators.changes import first_rows
from ..operators.places import split_jurisdiction
from ..operators.store import add_policies
from .bucketed import BucketedStore

# Headers of the staging layout, 13 of the master list and 15 extras.
MASTER = ["Geographical Area", "Country", "Region", "Name", "Incentive, Standard, or Enabler?", "Type (policy, legislation, regulation, grant, tax credit, voluntary initiative, etc.)", "Description", "Exclusive to Data Centers?", "Status", "Date Issued (newest version)", "Link", "Notes", "Person Who Added it to the Database"]
EXTRA = ["Relevance Score", "Lifecycle Stage", "Policy Type (raw)", "Key Requirements", "Bill Number", "Source Language", "Discovered At", "Crawl Status", "Review Status", "Verification Flags", "Referenced Policies", "Referenced URLs", "Scan ID", "Domain ID", "Error Details"]
HEADERS = MASTER + EXTRA


def _label(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(value == k, v) for k, v in labels.items()), F.lit("")) if labels else F.lit("")


def to_staging(df: DataFrame, places: DataFrame, type_labels: dict[str, str], status_labels: dict[str, str], added_by: str = "") -> DataFrame:
    """IO-05: policies in the 28 staging columns, all text; nulls are ''."""
    rows = split_jurisdiction(df.withColumnRenamed("region", "_region") if "region" in df.columns else df, places)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    blank = F.lit("")
    values = [
        F.col("area"), F.col("country"), F.col("region"), text("policy_name"), blank, _label(F.col("policy_type"), type_labels), text("summary"), blank, _label(F.col("lifecycle_stage"), status_labels), text("effective_date"), text("url"), blank, F.lit(added_by),
        text("relevance_score"), text("lifecycle_stage"), text("policy_type"), text("key_requirements"), text("bill_number"), text("source_language"), F.coalesce(F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss"), blank), text("crawl_status"), text("review_status"),
        F.concat_ws(", ", "verification_flags"), F.concat_ws("; ", "referenced_policies"), F.concat_ws("; ", "referenced_urls"), text("scan_id"), text("domain_id"), text("error_details"),
    ]
    return rows.select(*(v.alias(h) for h, v in zip(HEADERS, values)))


def from_staging(df: DataFrame) -> DataFrame:
    """IO-06: staging rows as policies; blanks take the defaults, a region wins over its country unless it is National or Regional."""
    g = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))
    other = lambda h, value: F.when(g(h) == "", F.lit(value)).otherwise(g(h))
    parts = lambda h, sep: F.filter(F.transform(F.split(g(h), sep), lambda x: F.trim(x)), lambda x: x != "")
    place = F.when((g("Region") != "") & ~g("Region").isin("National", "Regional"), g("Region")).otherwise(g("Country"))
    when = F.coalesce(F.try_to_timestamp(g("Discovered At"), F.lit("yyyy-MM-dd H:mm:ss")), F.try_to_timestamp(g("Discovered At")))
    keep = [F.col(c) for c in df.columns if c not in HEADERS]
    return df.select(
        *keep, g("Link").alias("url"), g("Name").alias("policy_name"), place.alias("jurisdiction"), other("Policy Type (raw)", "unknown").alias("policy_type"), g("Description").alias("summary"), other("Relevance Score", "0").alias("relevance_score"),
        F.nullif(g("Date Issued (newest version)"), F.lit("")).alias("effective_date"), other("Source Language", "English").alias("source_language"), F.nullif(g("Bill Number"), F.lit("")).alias("bill_number"), F.nullif(g("Key Requirements"), F.lit("")).alias("key_requirements"), when.alias("discovered_at"),
        other("Crawl Status", "success").alias("crawl_status"), F.nullif(g("Error Details"), F.lit("")).alias("error_details"), other("Review Status", "new").alias("review_status"), F.nullif(g("Scan ID"), F.lit("")).alias("scan_id"), F.nullif(g("Domain ID"), F.lit("")).alias("domain_id"),
        parts("Verification Flags", ",").alias("verification_flags"), parts("Referenced Policies", ";").alias("referenced_policies"), parts("Referenced URLs", ";").alias("referenced_urls"), other("Lifecycle Stage", "unknown").alias("lifecycle_stage"),
    )


def reject_reason(df: DataFrame) -> DataFrame:
    """IO-07: adds `reason`, null for rows that can be imported: the first thing wrong with a row."""
    reason = (
        F.when(F.coalesce("url", F.lit("")) == "", "missing url")
        .when(~scheme(F.col("url")).isin("http", "https"), "wrong scheme")
        .when(F.coalesce("policy_name", F.lit("")) == "", "missing name")
        .when(F.col("relevance_score").try_cast("int").isNull(), "bad score")
        .when(F.col("effective_date").isNotNull() & F.try_to_date("effective_date").isNull(), "bad date")
    )
    return df.withColumn("reason", reason)


def import_staging(rows: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO-07: new rows, a one-row summary (read, imported, duplicates, invalid), and the invalid rows (row, its number in the sheet, and reason), all of them.

    `rows` are staging rows with seq, counted from 0; the sheet's first row is its head.
    """
    judged = reject_reason(from_staging(rows))
    new = add_policies(store, judged.filter("reason is null").drop("reason"))
    counts = judged.agg(F.count("*").alias("read"), F.count_if(F.col("reason").isNotNull()).alias("invalid"))
    summary = counts.join(F.broadcast(new.agg(F.count("*").alias("imported")))).select("read", "imported", (F.col("read") - F.col("invalid") - F.col("imported")).alias("duplicates"), "invalid")
    return new, summary, judged.filter("reason is not null").select((F.col("seq") + 2).alias("row"), "reason")


def export_new(batch: DataFrame, exported: DataFrame) -> DataFrame:
    """IO-08: rows of the batch to append: of each url the first, none that is exported already."""
    return first_rows(batch, ["url"], [F.col("seq")]).join(exported.select("url").distinct(), "url", "left_anti")


def append_new(batch: DataFrame, exported: BucketedStore) -> None:
    """IO-08: appends to what is exported the rows of the batch that `export_new` gives. A batch that is appended again adds nothing."""
    exported.insert_new(first_rows(batch, ["url"], [F.col("seq")]))


def lead_outcome(outcome: Column, policy_url: Column, error: Column) -> Column:
    return F.when(outcome == "policy_found", F.concat(F.lit("Found: "), F.coalesce(policy_url, F.lit("")))).when(outcome == "no_policy", "Checked - nothing found").when(outcome == "fetch_failed", F.concat(F.lit("Fetch failed: "), F.coalesce(error, F.lit("")))).otherwise("")


def export_leads(leads: DataFrame) -> DataFrame:
    """IO-09: the lead queue as a snapshot: title or snippet, and what became of each."""
    title = F.coalesce(F.nullif("title", F.lit("")), "snippet")
    return leads.select("lead_id", title.alias("title"), "source_url", "status", lead_outcome(F.col("chase_outcome"), F.col("policy_url"), F.col("chase_error")).alias("outcome"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """IO-10: rows of two copies that differ: (key, problem): only_left, only_right or differs. Keys are taken to be unique."""
    others = [c for c in a.columns if c != key]
    left = a.select(F.col(key).alias("_k"), F.struct(*others).alias("_a"), F.lit(True).alias("_l"))
    right = b.select(F.col(key), F.struct(*others).alias("_b"), F.lit(True).alias("_r"))
    both = left.join(right, F.col("_k") == F.col(key), "full")
    problem = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(F.coalesce("_k", key).alias(key), problem.alias("problem")).filter("problem is not null")
