"""Queries over changes, legislative records and model verdicts (CD, SR, PV), each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import shared_dir
from ..functions import records as R
from ..functions import text as X
from ..operators import changes, verdicts
from ..operators.records import matches_terms, union_by_term, usable_records
from ..sources.bucketed import BucketedStore
from .inputs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Documents as pages, and what an earlier run stored of most of them, some with other contents.
_PAGE = "SELECT doc_id, 'u' || CAST(doc_id AS STRING) AS url, CASE WHEN doc_id % 13 = 0 THEN '' ELSE left(sha256(coalesce(text, '')), 16) END AS content_hash, n_chars FROM documents"
_EXPIRES = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'soon' WHEN doc_id % 7 = 2 THEN '2023-12-31T10:00:00' ELSE '2024-02-0' || CAST(1 + doc_id % 9 AS STRING) || 'T00:00:00' END"


def page_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 13 == 0, "").otherwise(X.content_hash(F.col("text"))).alias("content_hash"))


def cache(spark, sf_dir):
    stored = "CASE WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN '' ELSE content_hash END AS content_hash"
    return page_hashes(spark, sf_dir).filter("doc_id % 3 <> 0").selectExpr("url", "doc_id % 2 = 0 AS is_relevant", "CAST(doc_id % 11 AS INT) AS relevance_score", stored, "'2024-01-01T00:00:00' AS analyzed_date", f"{_EXPIRES} AS expires_date", "'law' AS policy_type")


_CACHED = f"SELECT doc_id, url, doc_id % 2 = 0 AS is_relevant, CAST(doc_id % 11 AS INT) AS relevance_score, CASE WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN '' ELSE content_hash END AS content_hash, '2024-01-01T00:00:00' AS analyzed_date, {_EXPIRES} AS expires_date, 'law' AS policy_type FROM ({_PAGE}) WHERE doc_id % 3 <> 0"
_LOOKUP = f"""SELECT p.doc_id, CASE WHEN c.url IS NULL THEN 'miss' WHEN try_cast(c.expires_date AS TIMESTAMP) IS NULL OR try_cast(c.expires_date AS TIMESTAMP) <= TIMESTAMP '{NOW}' THEN 'expired'
WHEN p.content_hash <> '' AND (c.content_hash = '' OR c.content_hash <> p.content_hash) THEN 'content_changed' ELSE 'hit' END AS cache_state FROM ({_PAGE}) p LEFT JOIN ({_CACHED}) c ON p.url = c.url"""


def lookup(spark, sf_dir):
    return changes.cache_lookup(page_hashes(spark, sf_dir), cache(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS content_hash FROM documents")
def cd01_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(_LOOKUP)
def cd02_cache_lookup(spark, sf_dir):
    return lookup(spark, sf_dir).select("doc_id", "cache_state")


_UPSERTED = f"""
WITH v AS (SELECT 'u' || CAST(o_custkey AS STRING) AS url, o_orderkey AS seq, o_orderkey % 2 = 0 AS is_relevant, CAST(o_orderkey % 11 AS INT) AS relevance_score, 'h' || CAST(o_orderkey AS STRING) AS content_hash FROM orders),
n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM v) WHERE rn = 1)
SELECT url, is_relevant, relevance_score, content_hash, strftime(TIMESTAMP '{NOW}' + INTERVAL (CASE WHEN is_relevant THEN 30 ELSE 7 END) DAY, '%Y-%m-%dT%H:%M:%S') AS expires_date FROM n
UNION ALL SELECT url, is_relevant, relevance_score, content_hash, expires_date FROM ({_CACHED}) WHERE url NOT IN (SELECT url FROM n)"""


def new_verdicts(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("'u' || o_custkey AS url", "o_orderkey AS seq", "o_orderkey % 2 = 0 AS is_relevant", "CAST(o_orderkey % 11 AS INT) AS relevance_score", "'h' || o_orderkey AS content_hash", "'law' AS policy_type")


@query(_UPSERTED)
def cd03_cache_upsert(spark, sf_dir):
    return changes.cache_upsert(cache(spark, sf_dir), new_verdicts(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("url", "is_relevant", "relevance_score", "content_hash", "expires_date")


@query(_UPSERTED)
def cd03_cache_store(spark, sf_dir):
    """The cache as a store in folders by url: the verdicts rewrite theirs only."""
    stored = cache(spark, sf_dir)
    store = BucketedStore.like(stored, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", parts=8, buckets=4)
    store.insert_new(stored)
    store.upsert(changes.cache_entries(new_verdicts(spark, sf_dir), F.lit(NOW).cast("timestamp")))
    return store.read().select("url", "is_relevant", "relevance_score", "content_hash", "expires_date")


@query(f"SELECT url, expires_date FROM ({_CACHED}) WHERE try_cast(expires_date AS TIMESTAMP) > TIMESTAMP '{NOW}'")
def cd04_cache_purge(spark, sf_dir):
    return changes.cache_purge(cache(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("url", "expires_date")


@query(f"SELECT count(*) FILTER (cache_state = 'hit') AS hits, count(*) FILTER (cache_state <> 'hit') AS misses, count(*) FILTER (cache_state = 'expired') AS expired, count(*) FILTER (cache_state = 'content_changed') AS content_changed, round(count(*) FILTER (cache_state = 'hit') / count(*), 9) AS hit_rate FROM ({_LOOKUP})")
def cd05_cache_stats(spark, sf_dir):
    return changes.cache_stats(lookup(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 9))


_OLD = "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'old' ELSE o_orderstatus END AS change_hash FROM orders WHERE o_orderkey % 3 <> 1"


@query(f"WITH s AS ({_OLD}) SELECT o_orderkey AS record_id, o_orderstatus AS change_hash FROM orders LEFT JOIN s ON o_orderkey = record_id WHERE record_id IS NULL OR change_hash IS DISTINCT FROM o_orderstatus")
def cd06_changed_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seen = o.filter("o_orderkey % 3 <> 1").selectExpr("o_orderkey AS record_id", "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'old' ELSE o_orderstatus END AS change_hash")
    return changes.changed_records(o.selectExpr("o_orderkey AS record_id", "o_orderstatus AS change_hash"), seen)


_MEASURE = "SELECT l_orderkey * 10 + l_linenumber AS seq, 'C' || CAST(l_suppkey % 5 AS STRING) AS celex, 'N' || CAST(l_suppkey % 9 AS STRING) AS country, 'T' || CAST(l_partkey % 97 AS STRING) AS title, 'https://x.eu/' || CAST(l_partkey % 301 AS STRING) AS link FROM lineitem"


_NEW = f"""WITH m AS (SELECT *, sha256(country || '|' || title) AS key FROM ({_MEASURE})), s AS (SELECT DISTINCT celex, key FROM m WHERE seq % 4 = 0 AND seq < 2000),
f AS (SELECT m.* FROM m LEFT JOIN s ON m.celex = s.celex AND m.key = s.key WHERE s.key IS NULL), o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY seq) AS rn FROM f),
n AS (SELECT celex, key, seq, country, title, link FROM o WHERE rn = 1 ORDER BY seq LIMIT 200)"""


def measures(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS seq", "'C' || (l_suppkey % 5) AS celex", "'N' || (l_suppkey % 9) AS country", "'T' || (l_partkey % 97) AS title", "'https://x.eu/' || (l_partkey % 301) AS link")
    m = m.groupBy("seq", "celex", "country", "title", "link").agg(F.lit(1).alias("_one")).drop("_one")
    return m, m.filter("seq % 4 = 0 AND seq < 2000").select("celex", changes.measure_key(F.col("country"), F.col("title")).alias("key")).distinct()


@query(f"{_NEW} SELECT * FROM n")
def cd07_new_measures(spark, sf_dir):
    return changes.new_measures(*measures(spark, sf_dir), 200)


@query(f"{_NEW} SELECT celex, key FROM s UNION SELECT celex, key FROM n")
def cd07_seen(spark, sf_dir):
    m, seen = measures(spark, sf_dir)
    return changes.mark_seen(seen, changes.new_measures(m, seen, 200))


@query("SELECT doc_id, contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), 'thing') OR contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), 'de ') AS hit FROM documents")
def sr01_term_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", matches_terms([F.col("lang"), F.col("text")], ["Thing", "de "]).alias("hit"))


_STATUS = "CASE o_orderkey % 14 WHEN 0 THEN 'Signed by Governor' WHEN 1 THEN 'In Committee' WHEN 2 THEN 'Passed House' WHEN 3 THEN 'Introduced' WHEN 4 THEN 'Verkündet' WHEN 5 THEN 'im Ausschuss' WHEN 6 THEN 'Transformado em Norma' WHEN 7 THEN 'Arquivada' WHEN 8 THEN 'sfs' WHEN 9 THEN 'open_consultation' WHEN 10 THEN 'bill' WHEN 11 THEN 'Enacted' WHEN 12 THEN '' END"
_STAGE = "CASE o_orderkey % 5 WHEN 0 THEN 'Royal Assent' WHEN 1 THEN 'Committee stage' WHEN 2 THEN 'current' WHEN 3 THEN 'in_force' END"
_SOURCES = list(R.STAGES)
_A, _B = "lower(coalesce(a, ''))", "coalesce(b, '')"
_SR02 = f"""CASE s
WHEN 'us' THEN CASE WHEN regexp_matches({_A} || ' ' || lower({_B}), 'signed|enacted|chaptered') THEN 'enacted' WHEN contains({_A} || ' ' || lower({_B}), 'committee') THEN 'in_committee' WHEN contains({_A} || ' ' || lower({_B}), 'passed') THEN 'passed' ELSE 'proposed' END
WHEN 'us_federal' THEN 'proposed' WHEN 'dk' THEN 'proposed' WHEN 'at' THEN 'enacted' WHEN 'eu' THEN 'transposition_notified'
WHEN 'de' THEN CASE WHEN regexp_matches({_A}, 'verkündet|abgeschlossen') THEN 'enacted' WHEN contains({_A}, 'ausschuss') THEN 'in_committee' ELSE 'proposed' END
WHEN 'ca' THEN CASE WHEN contains({_B}, 'Royal Assent') THEN 'enacted' WHEN contains({_B}, 'Committee') THEN 'in_committee' ELSE 'proposed' END
WHEN 'uk' THEN CASE WHEN contains({_B}, 'Royal Assent') THEN 'enacted' WHEN contains({_B}, 'Committee') THEN 'in_committee' ELSE 'proposed' END
WHEN 'ie' THEN CASE WHEN {_A} = 'enacted' THEN 'enacted' WHEN contains(lower({_B}), 'committee') THEN 'in_committee' ELSE 'proposed' END
WHEN 'br' THEN CASE WHEN {_A} = '' THEN NULL WHEN regexp_matches({_A}, 'transformad[oa] em') THEN 'enacted' WHEN contains({_A}, 'arquivad') THEN NULL ELSE 'proposed' END
WHEN 'se' THEN CASE a WHEN 'mot' THEN 'proposed' WHEN 'prop' THEN 'proposed' WHEN 'sfs' THEN 'enacted' WHEN 'bet' THEN 'in_committee' END
WHEN 'gov_uk' THEN CASE WHEN a IN ('open_consultation', 'open_call_for_evidence') THEN 'consultation' ELSE 'proposed' END
WHEN 'nz' THEN CASE WHEN a = 'bill' THEN CASE b WHEN 'current' THEN 'proposed' WHEN 'enacted' THEN 'enacted' END WHEN b = 'in_force' THEN 'enacted' END
WHEN 'pl' THEN CASE WHEN {_B} = '' THEN 'proposed' WHEN f THEN 'passed' END
WHEN 'no' THEN CASE WHEN NOT f THEN 'proposed' END WHEN 'nl' THEN CASE WHEN NOT f THEN 'proposed' END END"""


@query(f"SELECT k AS o_orderkey, s AS source, {_SR02} AS stage FROM (SELECT o_orderkey AS k, ['{"', '".join(_SOURCES)}'][CAST(o_custkey % {len(_SOURCES)} AS INT) + 1] AS s, {_STATUS} AS a, {_STAGE} AS b, o_orderkey % 3 = 0 AS f FROM orders)")
def sr02_lifecycle(spark, sf_dir):
    source = F.get(F.array(*map(F.lit, _SOURCES)), (F.col("o_custkey") % len(_SOURCES)).cast("int"))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{_STATUS} AS a", f"{_STAGE} AS b", "o_orderkey % 3 = 0 AS f").withColumn("source", source)
    return o.select("o_orderkey", "source", R.lifecycle_stage(F.col("source"), F.col("a"), F.col("b"), F.col("f")).alias("stage"))


_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'comment_days' WHEN 1 THEN 'comment_time' ELSE 'enforcement' END"
_DEADLINE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'later' ELSE left(CAST(o_orderdate AS STRING), 10) END"
_SR03_NOW = "1998-06-15 00:00:00"


@query(f"""
WITH d AS (SELECT o_orderkey, {_KIND} AS k, try_cast({_DEADLINE} AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 'comment_days' THEN CASE WHEN d >= DATE '1998-06-15' THEN 'consultation' END WHEN 'comment_time' THEN CASE WHEN d > DATE '1998-06-15' THEN 'consultation' ELSE 'proposed' END ELSE CASE WHEN d > DATE '1998-06-15' THEN 'passed' ELSE 'enacted' END END AS stage FROM d""")
def sr03_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_KIND} AS k", f"{_DEADLINE} AS d")
    return o.select("o_orderkey", R.window_stage(F.col("k"), F.col("d"), F.lit(_SR03_NOW).cast("timestamp")).alias("stage"))


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS is_open,
CASE WHEN o_orderkey % 5 = 0 THEN 'c' WHEN o_orderkey % 3 = 0 THEN 'b' WHEN o_orderkey % 4 <> 0 THEN 'a' ELSE 'b' END AS start,
CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'z' WHEN o_orderkey % 3 = 0 THEN 'y' WHEN o_orderkey % 4 <> 0 THEN 'x' ELSE 'y' END AS "end" FROM orders""")
def sr04_feedback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    statuses = F.expr("array(named_struct('state', 'CLOSED', 'start', IF(o_orderkey % 4 <> 0, 'a', ''), 'end', IF(o_orderkey % 4 <> 0, 'x', NULL)), named_struct('state', IF(o_orderkey % 3 = 0, 'OPEN', 'CLOSED'), 'start', 'b', 'end', 'y'), named_struct('state', IF(o_orderkey % 5 = 0, 'OPEN', NULL), 'start', 'c', 'end', IF(o_orderkey % 2 = 0, 'z', '')))")
    return o.select("o_orderkey", R.feedback_window(statuses).alias("w")).select("o_orderkey", "w.*")


@query("SELECT o_orderkey, 'consultation' AS lifecycle_stage, o_orderkey % 5 = 0 AS late FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def sr04_open(spark, sf_dir):
    """Initiatives whose feedback is open."""
    statuses = "array(named_struct('state', IF(o_orderkey % 3 = 0, 'OPEN', 'CLOSED'), 'start', 'b', 'end', 'y'), named_struct('state', IF(o_orderkey % 5 = 0, 'OPEN', NULL), 'start', 'c', 'end', 'z'))"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{statuses} AS statuses")
    return R.open_initiatives(o).select("o_orderkey", "lifecycle_stage", (F.col("window.start") == "c").alias("late"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'consultation' ELSE 'proposed' END AS lifecycle_stage FROM orders")
def sr04_stages(spark, sf_dir):
    statuses = "array(named_struct('state', IF(o_orderkey % 3 = 0, 'OPEN', 'CLOSED'), 'start', 'b', 'end', 'y'))"
    return R.open_initiatives(table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{statuses} AS statuses"), open_only=False).select("o_orderkey", "lifecycle_stage")




@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL (CASE o_orderkey % 3 WHEN 0 THEN 120 WHEN 1 THEN -330 ELSE 0 END) MINUTE, '%Y-%m-%d') END AS wcf,
CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS epoch FROM orders""")
def sr05_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    wcf = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.concat(F.lit("/Date("), ms.cast("string"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '+0200' WHEN 1 THEN '-0530' ELSE '' END"), F.lit(")/")))
    return o.select("o_orderkey", R.parse_wcf_date(wcf).alias("wcf"), R.epoch_ms_date(F.when(F.col("o_orderkey") % 8 != 0, ms)).alias("epoch"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'h2' WHEN o_orderkey % 3 <> 0 THEN 'p1' WHEN o_orderkey % 2 <> 0 THEN 'x1' ELSE '' END AS best, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'p1' ELSE 'p2' END AS pdf FROM orders""")
def sr06_best_links(spark, sf_dir):
    formats = F.expr("array(named_struct('type', 'xml', 'url', IF(o_orderkey % 2 <> 0, 'x1', NULL)), named_struct('type', 'html', 'url', IF(o_orderkey % 5 <> 0, 'h1', '')), named_struct('type', 'pdf', 'url', IF(o_orderkey % 3 <> 0, 'p1', NULL)), named_struct('type', 'html', 'url', IF(o_orderkey % 5 <> 0, 'h2', NULL)))")
    files = F.expr("array(named_struct('extension', 'asice', 'access', 'PUBLIC', 'url', 'a'), named_struct('extension', 'PDF', 'access', IF(o_orderkey % 4 = 0, 'PUBLIC', 'CLOSED'), 'url', IF(o_orderkey % 3 = 0, '', 'p1')), named_struct('extension', 'pdf', 'access', 'PUBLIC', 'url', IF(o_orderkey % 3 = 0, NULL, 'p2')))")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.best_format_url(formats).alias("best"), R.public_pdf_url(files).alias("pdf"))


_FETCHED = "CASE WHEN doc_id % 3 = 0 THEN left(text, 150) WHEN doc_id % 3 = 1 THEN text END"


@query(f"""
WITH p AS (SELECT doc_id, coalesce({_FETCHED}, '') AS f, 'Title ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || left(text, 180) ELSE '' END AS m FROM documents)
SELECT doc_id, CASE WHEN length(f) < 200 AND length(m) > length(f) THEN m ELSE f END AS content FROM p""")
def sr07_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = F.array(F.concat(F.lit("Title "), F.col("lang")), F.lit(" "), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 180)))
    return d.select("doc_id", R.assemble_content(parts, F.expr(_FETCHED)).alias("content"))


@query("""
WITH r AS (SELECT 'src' || CAST(l_suppkey % 23 AS STRING) AS source, 'r' || CAST(l_partkey % 400 AS STRING) AS record_id, CAST(l_linenumber AS INT) AS term_seq, l_orderkey * 100000 + l_partkey AS seq FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY source, record_id ORDER BY term_seq, seq) AS rn FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY term_seq, seq) AS position FROM o WHERE rn = 1)
SELECT source, record_id, term_seq, seq, CAST(position AS INT) AS position FROM p WHERE position <= 25""")
def sr08_union_by_term(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").selectExpr("'src' || (l_suppkey % 23) AS source", "'r' || (l_partkey % 400) AS record_id", "l_linenumber AS term_seq", "l_orderkey * 100000 + l_partkey AS seq")
    return union_by_term(r)


@query("SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 AND trim(coalesce(text, '')) <> '' AND (doc_id % 2 = 0 OR length(text) >= 60)")
def sr09_usable(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS body", "IF(doc_id % 9 = 0, '', 'https://x') AS official_url", "IF(doc_id % 2 = 0, 'bill', 'speech') AS kind")
    return usable_records(d).select("doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'https://none' ELSE 'https://www.parl.ca/legisinfo/en/bill/44-' || CAST(o_custkey % 3 AS STRING) || '/c-' || CAST(o_orderkey AS STRING) END AS url, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS id FROM orders")
def sr10_citations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")))
    raw = F.when(F.col("o_orderkey") % 6 == 0, "none").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")))
    return o.select("o_orderkey", R.citation_url(F.lit(44), F.col("o_custkey") % 3, number, "https://none").alias("url"), R.plain_id(raw).alias("id"))


# Replies: a JSON object with an order's values, fenced, bare, or followed by more text.
# A kind of each sort, one that isn't known, and one that says nothing.
_SORTS = ["law", "regulation", "directive", "incentive", "tax_incentive", "grant", "plan", "requirement", "standard", "guidance", "matching_platform", "unknown", "treaty", "N/A"]
_KINDS = "CASE o_orderkey % 14 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SORTS)) + " END"
_OBJECT = "'{\"is_relevant\": \"' || CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'Ja' WHEN 2 THEN 'no' ELSE 'true' END || '\", \"relevance_score\": \"' || CASE o_orderkey % 6 WHEN 0 THEN '8/10' WHEN 1 THEN '15' WHEN 2 THEN '-5' WHEN 3 THEN 'high' WHEN 4 THEN '7.9 of 10' ELSE CAST(o_orderkey % 11 AS STRING) END || '\", \"policy_name\": \"' || CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE 'Act ' || CAST(o_orderkey AS STRING) END || '\", \"jurisdiction\": \"' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE 'N' || CAST(o_custkey % 25 AS STRING) END || '\", \"policy_type\": \"' || [kinds] || '\", \"effective_date\": \"' || CASE WHEN o_orderkey % 8 = 0 THEN 'soon' WHEN o_orderkey % 8 = 1 THEN 'unknown' ELSE left(CAST(o_orderdate AS STRING), 10) END || '\", \"lifecycle_stage\": \"' || CASE WHEN o_orderkey % 2 = 0 THEN 'enacted' ELSE 'dead' END || '\", \"summary\": \"a {b} c\", ' || CASE o_orderkey % 4 WHEN 0 THEN '\"relevance_explanation\": \"since heat\", ' WHEN 1 THEN '\"relevance_explanation\": \"N/A\", ' WHEN 2 THEN '\"relevance_explanation\": null, ' ELSE '' END || '\"referenced_urls\": \"' || CASE WHEN o_orderkey % 3 = 0 THEN 'https://r/' ELSE 'None' END || '\", \"additional_policies\": ' || CASE WHEN o_orderkey % 9 = 0 THEN '[{\"is_relevant\": \"yes\", \"relevance_score\": \"6/10\", \"policy_name\": \"null\", \"jurisdiction\": \"Q\", \"policy_type\": \"standard\", \"effective_date\": \"2020-02-30\", \"key_requirements\": \"k\", \"referenced_urls\": \"https://q/\"}, {\"is_relevant\": \"0\"}]' WHEN o_orderkey % 9 = 1 THEN '\"none\"' ELSE '[]' END || '}'".replace("[kinds]", _KINDS)
_RAW = f"CASE o_orderkey % 3 WHEN 0 THEN 'Here: ```json' || chr(10) || {_OBJECT} || chr(10) || '``` done' WHEN 1 THEN ' ' || {_OBJECT} || ' and {{ more' ELSE '```' || {_OBJECT} || '```' END"


def analyses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW} AS raw")
    parsed = o.withColumn("json", verdicts.extract_json(F.col("raw"))).withColumn("analysis", F.from_json("json", verdicts.ANALYSIS))
    return verdicts.coerce_verdicts(parsed)


@query(f"SELECT o_orderkey, {_OBJECT} AS json FROM orders")
def pv01_extract_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW} AS raw")
    return o.select("o_orderkey", verdicts.extract_json(F.col("raw")).alias("json"))


_REL = "o_orderkey % 4 <> 2"
_SCORE = "CAST(CASE o_orderkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 7 ELSE o_orderkey % 11 END AS INT)"
_PLACE = "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'N' || CAST(o_custkey % 25 AS STRING) END"
_TYPE = f"CASE WHEN o_orderkey % 14 NOT IN (11, 13) THEN {_KINDS} WHEN {_REL} THEN 'unknown' ELSE 'not_relevant' END"


@query(f"""SELECT o_orderkey, {_REL} AS is_relevant, {_SCORE} AS relevance_score, {_TYPE} AS policy_type, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Act ' || CAST(o_orderkey AS STRING) END AS policy_name, {_PLACE} AS jurisdiction,
CASE WHEN o_orderkey % 8 = 0 THEN 'soon' WHEN o_orderkey % 8 = 1 THEN NULL ELSE left(CAST(o_orderdate AS STRING), 10) END AS effective_date, CASE WHEN o_orderkey % 2 = 0 THEN 'enacted' ELSE 'unknown' END AS lifecycle_stage, CASE o_orderkey % 4 WHEN 0 THEN 'since heat' ELSE 'No explanation provided' END AS relevance_explanation, CASE WHEN o_orderkey % 3 = 0 THEN 'https://r/' ELSE '' END AS referenced_urls, CASE WHEN o_orderkey % 9 = 0 THEN 'standard true 6,not_relevant false 0' ELSE '' END AS further FROM orders""")
def pv02_coerce(spark, sf_dir):
    a = analyses(spark, sf_dir)
    return a.select("o_orderkey", *(f"analysis.{c}" for c in ("is_relevant", "relevance_score", "policy_type", "policy_name", "jurisdiction", "effective_date", "lifecycle_stage", "relevance_explanation")), F.array_join("analysis.referenced_urls", ",").alias("referenced_urls"), F.array_join(F.transform("additional", lambda v: F.concat_ws(" ", v["policy_type"], v["is_relevant"].cast("string"), v["relevance_score"].cast("string"))), ",").alias("further"))


@query("""
WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN TRUE WHEN doc_id % 5 = 0 THEN NULL ELSE FALSE END AS r, CAST(greatest(1, least(10, CASE WHEN doc_id % 6 = 0 THEN 5 ELSE doc_id % 14 END)) AS INT) AS confidence FROM labels)
SELECT doc_id, confidence, CASE WHEN coalesce(r, TRUE) THEN 'analyse' WHEN confidence >= 5 THEN 'reject' ELSE 'escalate' END AS route FROM v""")
def pv03_routing(spark, sf_dir):
    v = table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN quality = 1 THEN TRUE WHEN doc_id % 5 = 0 THEN NULL ELSE FALSE END AS relevant", "IF(doc_id % 6 = 0, 'sure', CAST(doc_id % 14 AS STRING)) AS confidence")
    return verdicts.route_screening(v).select("doc_id", "confidence", "route")


@query(f"""
WITH a AS (SELECT o_orderkey AS seq, 0 AS position, {_REL} AS rel, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Act ' || CAST(o_orderkey AS STRING) END AS n, {_PLACE} AS j, {_TYPE} AS t, try_cast(CASE WHEN o_orderkey % 8 > 1 THEN left(CAST(o_orderdate AS STRING), 10) END AS DATE) AS d, {_SCORE} AS s, CASE WHEN o_orderkey % 10 = 0 THEN 'passed' WHEN o_orderkey % 2 = 0 THEN 'enacted' ELSE 'unknown' END AS l FROM orders),
b AS (SELECT *, '' AS k, CASE WHEN seq % 3 = 0 THEN 'https://r/' ELSE '' END AS u FROM a UNION ALL SELECT seq, 1, TRUE, '', 'Q', 'standard', NULL, 6, CASE WHEN seq % 10 = 0 THEN 'passed' ELSE 'unknown' END, 'k', 'https://q/' FROM a WHERE seq % 9 = 0)
SELECT seq, CAST(position AS INT) AS position, CASE WHEN n = '' THEN 'Untitled ' || CASE WHEN t IN ('unknown', 'not_relevant') THEN 'policy' ELSE t END || ' (' || CASE WHEN j = '' THEN 'Unknown jurisdiction' ELSE j END || ')' ELSE n END AS policy_name,
CASE WHEN j = '' THEN 'Unknown' ELSE j END AS jurisdiction, CASE WHEN t = 'treaty' THEN 'unknown' ELSE t END AS policy_type, CAST(s AS INT) AS relevance_score, d AS effective_date, l AS lifecycle_stage,
k AS key_requirements, u AS referenced_urls, CASE WHEN seq % 2 = 0 THEN 'Swedish' ELSE 'English' END AS source_language, 'd' || CAST(seq % 12 AS STRING) AS domain_id, 's1' AS scan_id FROM b WHERE rel""")
def pv04_to_policies(spark, sf_dir):
    a = analyses(spark, sf_dir)
    source = F.when(F.col("o_orderkey") % 10 == 0, "passed").when(F.col("o_orderkey") % 4 == 0, "").alias("source_stage")
    page = [F.expr("IF(o_orderkey % 2 = 0, 'Swedish', NULL)").alias("language"), F.expr("'d' || (o_orderkey % 12)").alias("domain_id"), F.lit("s1").alias("scan_id")]
    rows = a.select(F.col("raw").alias("url"), F.col("o_orderkey").alias("seq"), source, "analysis", "additional", *page)
    return verdicts.to_policies(rows).withColumn("referenced_urls", F.array_join("referenced_urls", ",")).drop("url", "summary", "referenced_policies")


@query("""
WITH c AS (SELECT strftime(ts, '%H') || CAST(user_id % 9 AS STRING) AS scan_id, count(*) FILTER (event_type IN ('view', 'click')) AS s, count(*) FILTER (event_type = 'purchase') AS a, sum(event_id % 5000) AS i, sum(event_id % 700) AS o FROM events GROUP BY 1)
SELECT scan_id, round((i * (0.25::DOUBLE * f + 3.0::DOUBLE * (1 - f)) + o * (1.25::DOUBLE * f + 15.0::DOUBLE * (1 - f))) / 1000000, 4) AS total_usd FROM (SELECT *, CASE WHEN s > 0 AND a > 0 THEN s / (s + a) ELSE 0.0::DOUBLE END AS f FROM c)""")
def pv06_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "events").selectExpr("date_format(ts, 'HH') || (user_id % 9) AS scan_id", "CASE WHEN event_type IN ('view', 'click') THEN 'screening' WHEN event_type = 'purchase' THEN 'analysis' ELSE 'other' END AS kind", "event_id % 5000 AS input_tokens", "event_id % 700 AS output_tokens")
    return verdicts.llm_cost(calls)
