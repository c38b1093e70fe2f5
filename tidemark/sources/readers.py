"""Readers: pages, policy files, JSON-lines logs and configured dimensions, all with explicit schemas."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "page_id long, url string, status string, fetched_at timestamp, content string, content_type string, title string, language string, response_time_ms int, content_length int, error_message string, domain_id string, lifecycle_stage string, seq long"
POLICY = "url string, policy_name string, jurisdiction string, policy_type string, summary string, relevance_score int, effective_date date, source_language string, bill_number string, key_requirements string, discovered_at timestamp, crawl_status string, error_details string, review_status string, scan_id string, domain_id string, verification_flags array<string>, referenced_policies array<string>, referenced_urls array<string>, lifecycle_stage string"
LOG = "ts string, level string, event string, scan_id string, domain_id string, session_id string"
BLOCKED = ("paywall", "captcha", "login", "access_denied")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """IO-01."""
    return spark.read.schema(PAGE).format(fmt).load(path)


def usable_pages(df: DataFrame) -> DataFrame:
    """IO-01: fetched pages that have content."""
    return df.filter((F.col("status") == "success") & (F.coalesce("content", F.lit("")) != ""))


def page_errors(df: DataFrame) -> DataFrame:
    """IO-01: pages, usable ones and those blocked, per domain."""
    usable = (F.col("status") == "success") & (F.coalesce("content", F.lit("")) != "")
    return df.groupBy("domain_id").agg(F.count("*").alias("pages"), F.count_if(usable).alias("usable"), F.count_if(F.col("status").isin(*BLOCKED)).alias("errors"))


def read_policies_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO-02: policies of JSON array files; and the records that can't be read, as text, with their url if that can."""
    rows = spark.read.schema(POLICY + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null").select("url", "_corrupt")


def parse_log(lines: DataFrame) -> DataFrame:
    """IO-03: a column `value` of JSON lines as log rows with their raw text; blank and unreadable lines go. Batch and stream."""
    return lines.filter(F.trim("value") != "").withColumn("j", F.from_json("value", LOG)).filter("j is not null and coalesce(j.ts, j.level, j.event) is not null").select("j.*", F.col("value").alias("raw"))


def read_jsonl_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


# Source types that aren't law services.
CHANNELS = {"crawl": "crawl", "eurlex_nim": "transposition"}


def load_dims(spark: SparkSession, config_dir: str) -> dict[str, DataFrame]:
    """IO-04: keyword terms, exclusions, places, sources and groups of a folder of YAML files.

    Configuration is small and read on the driver. Source files are merged from all subfolders of
    `domains`; names that begin with _ are skipped, and the file's stem is kept as source_file.
    """
    import yaml

    root = Path(config_dir)
    load = lambda p: (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}
    words = load(root / "keywords.yaml")
    terms = [(c, float(v.get("weight", 1.0)), lang, str(t)) for c, v in (words.get("keywords") or {}).items() for lang, ts in (v.get("terms") or {}).items() for t in ts or []]
    places = load(root / "jurisdictions.yaml").get("jurisdictions") or []
    keys = ("slug", "name", "kind", "iso3", "iso_numeric", "code", "parent")
    registry = [(i, *(None if p.get(k) is None else str(p[k]) for k in keys), [str(x) for x in p.get("members") or []], [str(x) for x in p.get("aliases") or []]) for i, p in enumerate(places)]
    files = sorted(f for f in (root / "domains").rglob("*.yaml") if not f.name.startswith("_"))
    domains = [(str(d.get("id")), str(d.get("name") or ""), str(d.get("base_url") or ""), bool(d.get("enabled", True)), [str(r) for r in d.get("region") or []], str(d.get("category") or ""), [str(t) for t in d.get("tags") or []], [str(t) for t in d.get("policy_types") or []], CHANNELS.get(str(d.get("source_type") or "crawl"), "law_api"), None if d.get("max_pages") is None else int(d["max_pages"]), f.stem) for f in files for d in load(f).get("domains") or []]
    groups = [(str(g), [str(x) for x in (v.get("domains") if isinstance(v, dict) else v) or []]) for g, v in (load(root / "groups.yaml").get("groups") or {}).items()]
    make = spark.createDataFrame
    return {
        "terms": make(terms, "category string, weight double, lang string, term string"),
        "exclusions": make([(str(x),) for x in words.get("exclusions") or []], "phrase string"),
        "jurisdictions": make(registry, "seq long, slug string, name string, kind string, iso3 string, iso_numeric string, code string, parent string, members array<string>, aliases array<string>"),
        "domains": make(domains, "id string, name string, base_url string, enabled boolean, region array<string>, category string, tags array<string>, policy_types array<string>, channel string, max_pages int, source_file string"),
        "groups": make(groups, "group string, domain_ids array<string>"),
    }
