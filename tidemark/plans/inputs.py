"""The jobs' inputs, made from the driver's tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(columns: list[tuple[str, str]], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {a}" for e, a in columns) + f" FROM {source}"


def _select(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {a}" for e, a in columns))


#: Policies: orders with their customer's nation as free-text place; three orders in a row share a URL.
POLICY = [
    ("o_orderkey", "seq"),
    ("'https://' || CASE WHEN o_custkey % 5 = 0 THEN 'www.' ELSE '' END || 'site' || CAST(o_custkey % 50 AS STRING) || '.gov/' || CASE WHEN o_orderkey % 7 = 0 THEN 'about' ELSE 'bills' END || '/' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)", "url"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN 'Energy Law' WHEN o_orderkey % 13 = 0 THEN ' Directive ' ELSE 'Policy ' || CAST(o_orderkey AS STRING) END", "policy_name"),
    ("CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN 'Unknown' WHEN o_orderkey % 5 = 0 THEN n_name || ' (EU)' WHEN o_orderkey % 29 = 0 THEN 'Atlantis' ELSE n_name END", "jurisdiction"),
    ("n_nationkey", "nation_key"),
    ("CASE WHEN o_orderpriority LIKE '1%' THEN 'law' WHEN o_orderpriority LIKE '2%' THEN 'regulation' WHEN o_orderpriority LIKE '3%' THEN 'directive' WHEN o_orderpriority LIKE '4%' THEN 'grant' ELSE 'unknown' END", "policy_type"),
    ("'About ' || lower(o_orderpriority) || ' of status ' || o_orderstatus || ' for ' || lower(n_name)", "summary"),
    ("CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 50000) AS INT) END", "relevance_score"),
    ("CAST(o_orderdate AS DATE)", "effective_date"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN 'HB ' || CAST(o_orderkey AS STRING) END", "bill_number"),
    ("'Keep heat ' || CAST(o_orderkey % 9 AS STRING)", "key_requirements"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' WHEN o_orderkey % 4 = 1 THEN 'rejected' ELSE 'new' END", "review_status"),
    ("'scan' || CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) % 12 AS STRING)", "scan_id"),
    ("'src' || CAST(o_custkey % 20 AS STRING)", "domain_id"),
    ("CASE o_orderstatus WHEN 'F' THEN 'enacted' WHEN 'O' THEN 'proposed' ELSE 'consultation' END", "lifecycle_stage"),
    ("o_orderdate", "discovered_at"),
]
POLICY_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
POLICIES_SQL = _sql(POLICY, POLICY_FROM)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return _policies(t)


def _policies(t) -> DataFrame:
    orders, customer, nation = t("orders"), t("customer"), t("nation")
    return _select(orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey), POLICY)


#: Sources: suppliers, with a region tag of their nation and a channel.
DOMAIN = [
    ("s_suppkey", "seq"),
    ("'dom' || CAST(s_suppkey AS STRING)", "id"),
    ("s_name", "name"),
    ("s_suppkey % 6 <> 0", "enabled"),
    ("lower(n_name)", "region"),
    ("CASE WHEN s_suppkey % 3 = 0 THEN 'legislature' ELSE 'agency' END", "category"),
    ("CASE WHEN s_suppkey % 10 = 0 THEN 'law_api' WHEN s_suppkey % 10 = 1 THEN 'transposition' ELSE 'crawl' END", "channel"),
    ("'file' || CAST(s_nationkey % 4 AS STRING)", "source_file"),
    ("CASE WHEN s_suppkey % 8 = 0 THEN 2.5 END", "min_keyword_score"),
    ("CAST(50 + s_suppkey % 4 * 50 AS INT)", "max_pages"),
    ("r_name", "world_region"),
]
DOMAINS_SQL = _sql(DOMAIN, "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")


#: Region tags of a source: its nation, and for some its wider region.
TAGS_SQL = f"SELECT id, enabled, region AS tag, world_region, seq FROM ({DOMAINS_SQL}) UNION ALL SELECT id, enabled, lower(world_region), world_region, seq FROM ({DOMAINS_SQL}) WHERE seq % 5 = 0"


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    made = _select(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey), DOMAIN)
    return made.withColumn("region", F.expr("IF(seq % 5 = 0, array(region, lower(world_region)), array(region))"))
