"""Queries over policies, places, sources, scans, signals and sinks (VF, PL, ST, CV, SC, SG, IO), each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import shared_dir
from ..functions import text as X
from ..functions import urls as U
from ..operators import coverage, places, scans, search_index, signals, store, verify
from ..operators.changes import first_rows
from ..sources import bucketed, readers, sinks
from ..sources.bucketed import BucketedStore
from .inputs import DOMAINS_SQL, POLICIES_SQL, TAGS_SQL, domains, policies, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "1999-06-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


P = f"p AS ({POLICIES_SQL})"
_GENERIC = ", ".join(f"'{n}'" for n in verify.GENERIC_NAMES)
_PATH = f"lower(regexp_extract(url, '{U.SPLIT}', 3))"
WORDS = {"a": ["nation_1", "nation_2"], "b": ["nation_3"], "c": ["nation_"]}
_REGIONS = "CASE nation_key % 4 WHEN 0 THEN array('a') WHEN 1 THEN array('b', 'zz') WHEN 2 THEN array('zz') ELSE array('a', 'b') END"
_KNOWN = "nation_key % 4 <> 2"
_FOUND = "(nation_key % 4 IN (0, 3) AND (contains(lower(jurisdiction), 'nation_1') OR contains(lower(jurisdiction), 'nation_2')) OR nation_key % 4 IN (1, 3) AND contains(lower(jurisdiction), 'nation_3'))"
_FLAGS = [
    ("duplicate_url", "row_number() OVER (PARTITION BY scan_id, url ORDER BY seq) > 1"),
    ("jurisdiction_mismatch", f"coalesce(jurisdiction, '') NOT IN ('', 'Unknown') AND {_KNOWN} AND NOT {_FOUND}"),
    ("future_date", f"effective_date > DATE '{TODAY}' + 730"),
    ("generic_name", f"lower(trim(policy_name)) IN ({_GENERIC}) AND coalesce(bill_number, '') = ''"),
    ("low_confidence_high_score", f"relevance_score >= 9 AND ({' OR '.join(f"contains({_PATH}, '{x}')" for x in verify.STAFF_PATHS)})"),
]
_VERIFIED = f"SELECT *, " + ", ".join(f"coalesce({sql}, FALSE) AS f{i}" for i, (_, sql) in enumerate(_FLAGS)) + " FROM p"


def verified(spark, sf_dir):
    return verify.verify(policies(spark, sf_dir), F.lit(TODAY).cast("date"), F.expr(_REGIONS), WORDS)


@query(f"WITH {P}, v AS ({_VERIFIED}) SELECT seq, " + " || ".join(f"CASE WHEN f{i} THEN '{n};' ELSE '' END" for i, (n, _) in enumerate(_FLAGS)) + " AS flags FROM v")
def vf04_verify(spark, sf_dir):
    return verified(spark, sf_dir).select("seq", F.array_join(F.transform("verification_flags", lambda x: F.concat(x, F.lit(";"))), "").alias("flags"))


@query(f"WITH {P}, v AS ({_VERIFIED}), l AS (" + " UNION ALL ".join(f"SELECT scan_id, '{n}' AS flag FROM v WHERE f{i}" for i, (n, _) in enumerate(_FLAGS)) + f" UNION ALL SELECT scan_id, CASE WHEN {' OR '.join(f'f{i}' for i in range(5))} THEN 'flagged' ELSE 'passed' END FROM v) SELECT scan_id, flag, count(*) AS n FROM l GROUP BY scan_id, flag")
def vf05_summary(spark, sf_dir):
    return verify.verification_summary(verified(spark, sf_dir))


# Registry: nations as countries, every ninth off the map, regions as groups of them, suppliers as local places.
def registry(spark, sf_dir):
    nation, region, supplier = (table(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    none = "CAST(NULL AS STRING)"
    countries = nation.selectExpr("CAST(n_nationkey AS BIGINT) AS seq", "lower(n_name) AS slug", "n_name AS name", "'country' AS kind", "IF(n_nationkey % 9 = 0, NULL, lpad(CAST(n_nationkey AS STRING), 3, '0')) AS iso_numeric", f"{none} AS parent", "array() AS members", "array('Land ' || n_nationkey) AS aliases")
    groups = region.join(nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("m")), region.r_regionkey == nation.n_regionkey).selectExpr("CAST(100 + r_regionkey AS BIGINT)", "lower(r_name)", "r_name", "'group'", none, none, "m", "array(r_name || ' states')")
    world = region.groupBy().agg(F.lit(200).cast("long"), F.lit("world"), F.lit("World"), F.lit("group"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.array_sort(F.collect_list(F.lower("r_name"))), F.array().cast("array<string>"))
    local = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).selectExpr("1000 + s_suppkey", "'town' || s_suppkey", "'Town ' || s_suppkey", "'subnational'", none, "IF(s_suppkey % 5 = 4, 'town' || (s_suppkey - 1), lower(n_name))", "array()", "array()")
    return countries.union(groups).union(world).union(local)


_REGISTRY = """SELECT CAST(n_nationkey AS BIGINT) AS seq, lower(n_name) AS slug, n_name AS name, 'country' AS kind, CASE WHEN n_nationkey % 9 <> 0 THEN lpad(CAST(n_nationkey AS STRING), 3, '0') END AS iso_numeric, NULL AS parent, 'Land ' || CAST(n_nationkey AS STRING) AS alias FROM nation
UNION ALL SELECT 100 + r_regionkey, lower(r_name), r_name, 'group', NULL, NULL, r_name || ' states' FROM region UNION ALL SELECT 200, 'world', 'World', 'group', NULL, NULL, NULL
UNION ALL SELECT 1000 + s_suppkey, 'town' || CAST(s_suppkey AS STRING), 'Town ' || CAST(s_suppkey AS STRING), 'subnational', NULL, CASE WHEN s_suppkey % 5 = 4 THEN 'town' || CAST(s_suppkey - 1 AS STRING) ELSE lower(n_name) END, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_ROLLUP = "SELECT r.slug, r.kind, r.iso_numeric, CASE WHEN r.kind = 'country' THEN r.slug WHEN a.kind = 'country' THEN a.slug WHEN b.kind = 'country' THEN b.slug END AS country FROM r LEFT JOIN r a ON r.parent = a.slug LEFT JOIN r b ON a.parent = b.slug"
# What an order's place text says, with towns and groups among them.
_TEXT = "CASE WHEN seq % 6 = 0 THEN 'Town ' || CAST(seq % 90 AS STRING) || ', ' || 'x' WHEN seq % 14 = 1 THEN ' AMERICA States ' WHEN seq % 21 = 2 THEN 'Land ' || CAST(nation_key AS STRING) || ' (Federal)' ELSE jurisdiction END"
_SLUG = f"CASE WHEN seq % 6 = 0 THEN CASE WHEN seq % 90 IN (SELECT s_suppkey FROM supplier) THEN 'town' || CAST(seq % 90 AS STRING) END WHEN seq % 14 = 1 THEN 'america' WHEN seq % 21 = 2 THEN 'nation_' || CAST(nation_key AS STRING) WHEN coalesce(jurisdiction, '') IN ('', 'Unknown', 'Atlantis') THEN NULL ELSE 'nation_' || CAST(nation_key AS STRING) END"
_RESOLVED = f"SELECT *, {_TEXT} AS place_text, {_SLUG} AS slug FROM p"


def resolved(spark, sf_dir):
    return places.resolve_places(policies(spark, sf_dir).withColumn("place_text", F.expr(_TEXT)), registry(spark, sf_dir), "place_text")


@query(f"WITH r AS ({_REGISTRY}), a AS (SELECT slug AS alias, slug, seq FROM r UNION SELECT lower(name), slug, seq FROM r UNION SELECT lower(alias), slug, seq FROM r WHERE alias IS NOT NULL) SELECT alias, arg_min(slug, seq) AS slug, count(DISTINCT slug) > 1 AS collides FROM a GROUP BY alias")
def pl01_alias_index(spark, sf_dir):
    return places.alias_index(registry(spark, sf_dir)).select("alias", "slug", "collides")


@query(f"WITH {P} SELECT seq, {_SLUG} AS slug FROM p")
def pl02_resolve(spark, sf_dir):
    return resolved(spark, sf_dir).select("seq", "slug")


@query(f"WITH r AS ({_REGISTRY}) SELECT slug, country FROM ({_ROLLUP})")
def pl03_country_rollup(spark, sf_dir):
    return places.country_rollup(registry(spark, sf_dir))


@query(f"WITH r AS ({_REGISTRY}) SELECT slug FROM ({_ROLLUP}) WHERE kind = 'subnational' AND country = 'nation_3'")
def pl04_children(spark, sf_dir):
    r = registry(spark, sf_dir)
    return places.children_of(r, places.country_rollup(r), "nation_3").select("slug")


@query("SELECT lower(n_name) AS slug, row_number() OVER (ORDER BY lower(r_name), lower(n_name)) AS position FROM nation JOIN region ON n_regionkey = r_regionkey")
def pl05_members(spark, sf_dir):
    members = places.members_of(registry(spark, sf_dir), "world")
    from pyspark.sql import Window as W

    return members.select("slug", F.row_number().over(W.orderBy("position")).cast("long").alias("position"))


@query(f"WITH {P}, v AS ({_RESOLVED}) SELECT trim(place_text) AS text, count(*) AS hits FROM v WHERE slug IS NULL AND trim(coalesce(place_text, '')) <> '' GROUP BY 1")
def pl06_unresolved(spark, sf_dir):
    return places.unresolved_report(resolved(spark, sf_dir), "place_text")


@query(f"SELECT tag AS slug, count(DISTINCT id) AS sources FROM ({TAGS_SQL}) WHERE tag NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 6 <> 4) GROUP BY tag")
def pl06_slugs(spark, sf_dir):
    known = registry(spark, sf_dir).filter("kind = 'country' AND seq % 6 <> 4")
    return places.unresolved_slugs(domains(spark, sf_dir), known)


@query(f"WITH {P}, v AS ({_RESOLVED}), r AS ({_REGISTRY}) SELECT seq FROM v WHERE slug IN (SELECT slug FROM ({_ROLLUP}) WHERE slug = 'nation_7' OR country = 'nation_7')")
def pl07_filter_place(spark, sf_dir):
    return places.filter_place(resolved(spark, sf_dir), places.country_rollup(registry(spark, sf_dir)), "nation_7").select("seq")


_STORED = "CASE o_custkey % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'Belarus' WHEN 2 THEN 'United States (Federal)' WHEN 3 THEN '' WHEN 4 THEN 'Sweden (EU)' WHEN 5 THEN 'South America' WHEN 6 THEN NULL ELSE 'Latin usage' END"


@query("SELECT o_orderkey, o_custkey % 8 IN (0, 2, 5) AS hit FROM orders")
def pl08_alias_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_STORED} AS s").select("o_orderkey", places.jurisdiction_matches("United States", F.col("s")).alias("hit"))


def place_names(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey)
    # names as normalised texts write them, with spaces for underscores
    return rows.selectExpr("replace(lower(n_name), '_', ' ') AS name", "r_name AS area", "n_name AS country", "'National' AS region", "n_nationkey AS rank", "FALSE AS broad").union(spark.createDataFrame([("eu", "Europe", "EU Member States", "Regional", 900, True)], "name string, area string, country string, region string, rank int, broad boolean"))


_SPLIT_TEXT = "CASE WHEN seq % 8 = 0 THEN 'City, ' || jurisdiction WHEN seq % 8 = 1 THEN 'EU (all)' WHEN seq % 8 = 2 THEN jurisdiction || ' State' ELSE jurisdiction END"
_SPLIT_KNOWN = "coalesce(jurisdiction, '') NOT IN ('', 'Unknown', 'Atlantis')"


@query(f"""
WITH {P}, t AS (SELECT *, trim(coalesce({_SPLIT_TEXT}, '')) AS raw FROM p)
SELECT seq, CASE WHEN seq % 8 = 1 THEN 'Europe' WHEN {_SPLIT_KNOWN} THEN r_name ELSE '' END AS area, CASE WHEN seq % 8 = 1 THEN 'EU Member States' WHEN {_SPLIT_KNOWN} THEN n_name ELSE raw END AS country, CASE WHEN seq % 8 = 1 THEN 'Regional' WHEN {_SPLIT_KNOWN} THEN 'National' ELSE '' END AS region
FROM t JOIN nation ON nation_key = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def pl09_split(spark, sf_dir):
    p = policies(spark, sf_dir).select("seq", F.expr(_SPLIT_TEXT).alias("place_text"))
    return places.split_jurisdiction(p, place_names(spark, sf_dir), "place_text").select("seq", "area", "country", "region")


PLACE_TABLES = [{"usa": ("country", "us"), "uk": ("country", "uk")}, {"texas": ("state", "tx"), "nordic": ("group", "nordic")}]


@query("SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'country' WHEN 1 THEN 'state' WHEN 2 THEN 'group' WHEN 3 THEN 'country' END AS kind, CASE o_custkey % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'tx' WHEN 2 THEN 'nordic' WHEN 3 THEN 'uk' END AS key FROM orders")
def pl10_search_place(spark, sf_dir):
    text = F.expr("CASE o_custkey % 5 WHEN 0 THEN ' USA (federal)' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Nordic  countries' WHEN 3 THEN 'uk' ELSE 'Mars' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", places.resolve_search_place(text, PLACE_TABLES).alias("p")).select("o_orderkey", "p.kind", "p.key")


@query("SELECT DISTINCT CASE n_nationkey % 4 WHEN 2 THEN 'Nordic countries' ELSE 'Texas' END AS name FROM nation WHERE n_nationkey % 4 > 1")
def pl10_suggestions(spark, sf_dir):
    """Of names of all sorts those that the search resolves."""
    names = table(spark, sf_dir, "nation").selectExpr("CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'US state governments' WHEN 2 THEN 'Nordic countries' ELSE 'Texas' END AS name")
    return places.suggested_places(names, PLACE_TABLES)


_INSERTED = f"WITH {P}, b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM p WHERE seq % 5 <> 0) SELECT seq, url FROM b WHERE rn = 1 AND url NOT IN (SELECT url FROM p WHERE seq % 5 = 0)"


def policy_store(spark, first):
    """A store of policies (seq, url) in folders by url, with `first` in it, of each url the first."""
    rows = first_rows(first.select("seq", "url"), ["url"], [F.col("seq")])
    made = BucketedStore.like(rows, f"{shared_dir(spark)}/policies-{uuid.uuid4().hex}", parts=8, buckets=4)
    made.insert_new(rows)
    return made


@query(_INSERTED)
def st01_insert(spark, sf_dir):
    p = policies(spark, sf_dir)
    return store.add_policies(p.filter("seq % 5 = 0"), p.filter("seq % 5 <> 0")).select("seq", "url")


@query(_INSERTED.replace("SELECT seq, url FROM b WHERE rn = 1", "SELECT min(seq) AS seq, url FROM p WHERE seq % 5 = 0 GROUP BY url UNION ALL SELECT seq, url FROM b WHERE rn = 1"))
def st01_store(spark, sf_dir):
    """The stored policies and the new ones, added to the store's folders without rewriting a file."""
    p = policies(spark, sf_dir)
    made = policy_store(spark, p.filter("seq % 5 = 0"))
    store.insert_policies(made, p.filter("seq % 5 <> 0").select("seq", "url"))
    return made.read()


_UPDATES = "SELECT CASE WHEN seq % 7 = 0 THEN 'https://none/' || CAST(seq AS STRING) ELSE url END AS url, seq, CASE WHEN seq % 2 = 0 THEN 'needs_review' ELSE 'confirmed' END AS review_status FROM p WHERE seq % 4 = 0"


def updates(spark, sf_dir):
    return policies(spark, sf_dir).filter("seq % 4 = 0").selectExpr("IF(seq % 7 = 0, 'https://none/' || seq, url) AS url", "seq", "IF(seq % 2 = 0, 'needs_review', 'confirmed') AS review_status")


@query(f"WITH {P}, u AS (SELECT url, arg_max(review_status, seq) AS s FROM ({_UPDATES}) GROUP BY url) SELECT seq, coalesce(s, review_status) AS review_status FROM p LEFT JOIN u ON p.url = u.url")
def st02_review(spark, sf_dir):
    return store.update_review(policies(spark, sf_dir), updates(spark, sf_dir)).select("seq", "review_status")


@query(f"WITH {P} SELECT seq, url FROM ({_UPDATES}) WHERE url NOT IN (SELECT url FROM p)")
def st02_review_misses(spark, sf_dir):
    return store.unknown_updates(policies(spark, sf_dir), updates(spark, sf_dir)).select("seq", "url")


@query(f"WITH {P} SELECT seq FROM p WHERE contains(lower(jurisdiction), 'nation_1') AND policy_type = 'law' AND coalesce(relevance_score, 0) >= 3")
def st03_search(spark, sf_dir):
    return store.search(policies(spark, sf_dir), jurisdiction="Nation_1", policy_type="law", min_score=3).select("seq")


_TOKENS = {f: f"list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')" for f in store.TEXT_FIELDS}
_TF = lambda test: " + ".join(f"{w} * len(list_filter({_TOKENS[f]}, lambda x: {test}))" for f, w in zip(store.TEXT_FIELDS, (10, 1, 1, 1)))


@query(f"""
WITH {P}, c AS (SELECT seq, CAST({_TF("x = 'policy'")} AS DOUBLE) AS t0, CAST({_TF("starts_with(x, 'urg')")} AS DOUBLE) AS t1, {' + '.join(f'len({_TOKENS[f]})' for f in store.TEXT_FIELDS)} AS n FROM p),
f AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT seq, round({' + '.join(f'greatest(ln((d - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m))' for i in (0, 1))}, 6) AS rank_score FROM c, f WHERE t0 > 0 AND t1 > 0 ORDER BY rank_score DESC, seq LIMIT 100""")
def st04_ranked_search(spark, sf_dir):
    return store.search_text(policies(spark, sf_dir), "policy urg", 1000).select("seq", F.round("rank_score", 6).alias("rank_score"))


#: Policies with names in other scripts, and with a third of them changed by a second batch of the index, which also takes some out.
_NAMED = "CASE WHEN seq % 7 = 3 THEN 'Énergie-verte ' || CAST(seq % 50 AS STRING) WHEN seq % 7 = 5 THEN 'Miasto ŁÓDŹ ' || policy_name ELSE policy_name END"
_CHANGED = "CASE WHEN seq % 3 = 1 THEN 'Revised ' || name ELSE name END"
_INDEXED = f"x AS (SELECT * EXCLUDE (policy_name, name), {_CHANGED} AS policy_name FROM (SELECT *, {_NAMED} AS name FROM p) WHERE seq % 10 <> 9)"
_FOLDED = {f: f"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({f}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')" for f in store.TEXT_FIELDS}


def _bm25_sql(phrases: list[list[str]], limit: int = 100, where: str = "TRUE") -> str:
    """BM25 by a scan of all indexed rows: phrases of words, the last word of the last one a prefix."""
    counts = []
    for i, p in enumerate(phrases):
        tests = [f"starts_with(w[k + {n}], '{x}')" if i == len(phrases) - 1 and n == len(p) - 1 else f"w[k + {n}] = '{x}'" for n, x in enumerate(p)]
        each = [f"{w} * len(list_filter(range(1, len(f{k}) + 1), lambda k: coalesce({' AND '.join(tests).replace('w[', f'f{k}[')}, FALSE)))" for k, w in enumerate((10, 1, 1, 1))]
        counts.append(f"CAST({' + '.join(each)} AS DOUBLE) AS t{i}")
    score = " + ".join(f"greatest(ln((d - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m))" for i in range(len(phrases)))
    return f"""WITH {P}, {_INDEXED}, w AS (SELECT *, {', '.join(f'{_FOLDED[f]} AS f{k}' for k, f in enumerate(store.TEXT_FIELDS))} FROM x),
    c AS (SELECT *, {', '.join(counts)}, len(f0) + len(f1) + len(f2) + len(f3) AS n FROM w),
    f AS (SELECT count(*) AS d, avg(n) AS m, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(phrases)))} FROM c)
    SELECT seq, round({score}, 6) AS rank_score FROM c, f WHERE {' AND '.join(f't{i} > 0' for i in range(len(phrases)))} AND {where} ORDER BY rank_score DESC, seq LIMIT {limit}"""


def indexed(spark, sf_dir):
    """The policies as they are now, and the folder of their index: a batch of all, and one that replaces a third and takes a tenth out."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    first = policies(spark, sf_dir).withColumn("policy_name", F.expr(_NAMED))
    now = first.filter("seq % 10 <> 9").withColumn("policy_name", F.expr("IF(seq % 3 = 1, 'Revised ' || policy_name, policy_name)"))
    search_index.add_batch(first, path, 0)
    search_index.add_batch(now.filter("seq % 3 = 1"), path, 1, gone=first.filter("seq % 3 = 1 OR seq % 10 = 9").select("seq"))
    return now, path


def _ranked(spark, sf_dir, text: str, limit: int = 1000, **filters):
    now, path = indexed(spark, sf_dir)
    return search_index.search_index(now, path, text, limit, **filters).select("seq", F.round("rank_score", 6).alias("rank_score"))


@query(_bm25_sql([["energie"]]))
def st04_index_accents(spark, sf_dir):
    return _ranked(spark, sf_dir, "énergie")


@query(_bm25_sql([["łodz"], ["policy"]]))
def st04_index_other_letters(spark, sf_dir):
    return _ranked(spark, sf_dir, "Łódź POLICY")


@query(_bm25_sql([["energie", "verte"], ["status", "o"]]))
def st04_index_phrase(spark, sf_dir):
    return _ranked(spark, sf_dir, "ÉNERGIE-verte status/O")


@query(_bm25_sql([["revised"], ["urg"]], where="contains(lower(jurisdiction), 'nation_1') AND policy_type = 'law'"))
def st04_index_prefix_filtered(spark, sf_dir):
    return _ranked(spark, sf_dir, "revised urg", jurisdiction="Nation_1", policy_type="law")


@query(f"WITH {P} SELECT seq FROM p WHERE {' AND '.join('(' + ' OR '.join(f"contains(lower(coalesce({f}, '')), '{t}')" for f in store.TEXT_FIELDS) + ')' for t in ('energ', 'heat 3'.split()[0], '_1'))} ORDER BY seq LIMIT 100")
def st05_substring_search(spark, sf_dir):
    return store.search_like(policies(spark, sf_dir), "Energ heat _1", 500).select("seq")


_BAND = "CASE WHEN coalesce(relevance_score, 0) >= 9 THEN '9-10' WHEN coalesce(relevance_score, 0) >= 7 THEN '7-8' WHEN coalesce(relevance_score, 0) >= 4 THEN '4-6' ELSE '1-3' END"


@query(f"""
WITH {P}, v AS ({_VERIFIED}), s AS (SELECT 'total' AS kind, '' AS value, count(*) AS n FROM v UNION ALL SELECT 'flagged', '', count(*) FILTER ({' OR '.join(f'f{i}' for i in range(5))}) FROM v
UNION ALL SELECT 'jurisdiction', CASE WHEN coalesce(jurisdiction, '') = '' THEN 'Unknown' ELSE jurisdiction END, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'policy_type', policy_type, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'score', b, count(x) FROM (VALUES ('1-3'), ('4-6'), ('7-8'), ('9-10')) t(b) LEFT JOIN (SELECT {_BAND} AS x FROM v) ON b = x GROUP BY 2) SELECT kind, value, n FROM s""")
def st06_statistics(spark, sf_dir):
    return store.policy_stats(verified(spark, sf_dir))


@query(f"WITH {P}, m AS (SELECT seq, url, seq % 3 <> 0 AS live FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY live, seq) AS rn FROM m) SELECT seq, url FROM r WHERE rn = 1")
def st07_merge(spark, sf_dir):
    p = policies(spark, sf_dir)
    return store.merge_policies(p.filter("seq % 3 = 0"), p.filter("seq % 3 <> 0")).select("seq", "url")


# Leads: events with a URL, or a note alone.
_LEAD = "SELECT event_id AS seq, 'l' || CAST(event_id AS STRING) AS lead_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'https://n/' || CAST(event_id % 4001 AS STRING) END AS source_url, 'note ' || CAST(event_id % 2003 AS STRING) AS snippet, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'T' || CAST(event_id AS STRING) END AS title, CASE WHEN event_id % 5 = 0 THEN 'dismissed' ELSE 'new' END AS status, ts AS found_at FROM events"
_LEAD_KEY = "CASE WHEN coalesce(source_url, '') <> '' THEN source_url ELSE 'note:' || sha256(snippet) END"


def leads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS seq", "'l' || event_id AS lead_id", "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'https://n/' || (event_id % 4001) END AS source_url", "'note ' || (event_id % 2003) AS snippet", "IF(event_id % 4 = 0, '', 'T' || event_id) AS title", "IF(event_id % 5 = 0, 'dismissed', 'new') AS status", "ts AS found_at", "CAST(NULL AS STRING) AS policy_url", "CAST(NULL AS STRING) AS chase_outcome", "CAST(NULL AS STRING) AS chase_error", "CAST(NULL AS TIMESTAMP) AS chased_at")


@query(f"WITH l AS (SELECT *, {_LEAD_KEY} AS key FROM ({_LEAD})), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM l WHERE seq % 10 > 0) SELECT lead_id, key AS dedupe_key FROM b WHERE rn = 1 AND key NOT IN (SELECT key FROM l WHERE seq % 10 = 0)")
def st08_add_leads(spark, sf_dir):
    all_leads = leads(spark, sf_dir)
    return store.add_leads(all_leads.filter("seq % 10 = 0"), all_leads.filter("seq % 10 > 0")).select("lead_id", "dedupe_key")


@query(f"SELECT lead_id, found_at FROM ({_LEAD}) WHERE status = 'dismissed'")
def st09_list_leads(spark, sf_dir):
    return store.list_leads(leads(spark, sf_dir), "dismissed").select("lead_id", "found_at")


_OUTCOME = "SELECT 'l' || CAST(user_id * 7 AS STRING) AS lead_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'fetch_failed' WHEN 'purchase' THEN 'policy_found' ELSE 'no_policy' END AS outcome, CASE WHEN event_type = 'purchase' THEN 'https://p/' || CAST(event_id AS STRING) ELSE '' END AS policy_url, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM events"
_CHASED = f"SELECT l.lead_id, l.title, l.snippet, l.source_url, CASE WHEN o.outcome IN ('policy_found', 'no_policy') THEN 'chased' ELSE l.status END AS status, CASE WHEN o.policy_url <> '' THEN o.policy_url END AS policy_url, o.outcome AS chase_outcome, o.error AS chase_error FROM ({_LEAD}) l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY seq DESC) AS rn FROM ({_OUTCOME})) WHERE rn = 1) o ON l.lead_id = o.lead_id"


def chased(spark, sf_dir):
    outcomes = table(spark, sf_dir, "events").selectExpr("'l' || (user_id * 7) AS lead_id", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'fetch_failed' WHEN 'purchase' THEN 'policy_found' ELSE 'no_policy' END AS outcome", "IF(event_type = 'purchase', 'https://p/' || event_id, '') AS policy_url", "IF(event_type = 'error', 'timeout', NULL) AS error", "ts AS at")
    return store.apply_chases(leads(spark, sf_dir), outcomes)


@query(f"SELECT lead_id, status, policy_url, chase_outcome, chase_error FROM ({_CHASED})")
def st10_chases(spark, sf_dir):
    return chased(spark, sf_dir).select("lead_id", "status", "policy_url", "chase_outcome", "chase_error")


@query(f"WITH {P} SELECT seq FROM p WHERE lifecycle_stage IN ('proposed', 'consultation') AND seq % 3 = 0 AND jurisdiction IN ('NATION_2', 'NATION_4')")
def st11_view(spark, sf_dir):
    p = policies(spark, sf_dir).withColumn("tags", F.expr("IF(seq % 3 = 0, array('heat', 'grid'), array('grid'))"))
    return store.policy_view(p, "upcoming", ["heat", "grid"], ["NATION_2", "NATION_4"], "name").select("seq")


_SOURCE = f"SELECT id, CASE WHEN seq % 4 = 0 THEN 'town' || CAST(seq AS STRING) WHEN seq % 9 = 1 THEN lower(world_region) WHEN seq % 13 = 2 THEN 'nowhere' ELSE region END AS slug FROM ({DOMAINS_SQL})"


def place_sources(spark, sf_dir):
    return domains(spark, sf_dir).selectExpr("id", "CASE WHEN seq % 4 = 0 THEN 'town' || seq WHEN seq % 9 = 1 THEN lower(world_region) WHEN seq % 13 = 2 THEN 'nowhere' ELSE region[0] END AS slug")


_COVER = f"""WITH {P}, v AS ({_RESOLVED}), r AS ({_REGISTRY}), u AS ({_ROLLUP}), w AS (SELECT u.*, c.iso_numeric AS iso FROM u LEFT JOIN r c ON u.country = c.slug),
lp AS (SELECT v.*, w.kind, w.country, coalesce(w.country, v.slug) AS place, CASE WHEN w.country IS NOT NULL AND iso IS NOT NULL THEN 'country' WHEN w.country IS NOT NULL OR w.kind = 'group' THEN 'offmap' ELSE 'unresolved' END AS spot FROM v LEFT JOIN w ON v.slug = w.slug),
ls AS (SELECT DISTINCT s.id, s.slug, w.kind, w.country AS place, CASE WHEN iso IS NOT NULL THEN 'country' ELSE 'offmap' END AS spot FROM ({_SOURCE}) s JOIN w ON s.slug = w.slug WHERE w.country IS NOT NULL)"""
_PLACES = f"""{_COVER}, a AS (SELECT place, spot, count(*) AS policies, 0 AS sources FROM lp WHERE spot <> 'unresolved' GROUP BY 1, 2 UNION ALL SELECT place, spot, 0, count(DISTINCT id) FROM ls GROUP BY 1, 2),
c AS (SELECT place, count(DISTINCT slug) AS n FROM (SELECT place, slug FROM lp WHERE kind = 'subnational' UNION SELECT place, slug FROM ls WHERE kind = 'subnational') GROUP BY 1),
t AS (SELECT place, string_agg(policy_name, '|' ORDER BY rn) AS top FROM (SELECT place, policy_name, row_number() OVER (PARTITION BY place ORDER BY coalesce(relevance_score, 0) DESC, policy_name, seq) AS rn FROM lp WHERE spot <> 'unresolved') WHERE rn <= 3 GROUP BY 1),
g AS (SELECT a.spot, a.place, CAST(sum(policies) AS BIGINT) AS policies, CAST(sum(sources) AS BIGINT) AS sources FROM a GROUP BY 1, 2)
SELECT g.place, r.name, coalesce(r.iso_numeric, '') AS iso_numeric, g.policies, g.sources, coalesce(c.n, 0) AS children_with_data, coalesce(t.top, '') AS top_policy_names FROM g JOIN r ON r.slug = g.place LEFT JOIN c ON g.place = c.place LEFT JOIN t ON g.place = t.place WHERE g.spot = """


def cover_inputs(spark, sf_dir):
    r = registry(spark, sf_dir)
    return resolved(spark, sf_dir), place_sources(spark, sf_dir), r, places.country_rollup(r)


def _shown(df):
    return df.select("place", "name", F.coalesce("iso_numeric", F.lit("")).alias("iso_numeric"), "policies", "sources", "children_with_data", F.array_join("top_policy_names", "|").alias("top_policy_names"))


@query(_PLACES + "'country'")
def cv01_countries(spark, sf_dir):
    return _shown(coverage.coverage_countries(*cover_inputs(spark, sf_dir)))


@query(_PLACES + "'offmap'")
def cv02_offmap(spark, sf_dir):
    return _shown(coverage.coverage_offmap(*cover_inputs(spark, sf_dir)))


@query(f"""{_COVER}, x AS (SELECT 'p' AS k, CASE WHEN slug = 'nation_3' THEN 'national' ELSE slug END AS bucket, '' AS id FROM lp WHERE country = 'nation_3' UNION ALL SELECT DISTINCT 's', CASE WHEN slug = 'nation_3' THEN 'national' ELSE slug END, id FROM ls WHERE place = 'nation_3')
SELECT bucket, count(*) FILTER (k = 'p') AS policies, count(DISTINCT id) FILTER (k = 's') AS sources FROM (SELECT k, bucket, id FROM x UNION ALL SELECT k, 'total', id FROM x) GROUP BY bucket""")
def cv05_children(spark, sf_dir):
    return coverage.coverage_children(*cover_inputs(spark, sf_dir), "nation_3")


@query(f"{_COVER} SELECT count(*) AS policies, count(*) FILTER (spot = 'country') AS country, count(*) FILTER (spot = 'offmap') AS offmap, count(*) FILTER (spot = 'unresolved') AS unresolved, (SELECT count(DISTINCT id) FROM ({_SOURCE})) AS sources, TRUE AS reconciles FROM lp")
def cv06_totals(spark, sf_dir):
    return coverage.coverage_totals(*cover_inputs(spark, sf_dir))


@query(f"""{_COVER}, n AS (SELECT place, count(*) AS p FROM lp WHERE spot = 'country' GROUP BY 1 UNION ALL SELECT DISTINCT place, 0 FROM ls WHERE spot = 'country' AND place NOT IN (SELECT place FROM lp WHERE spot = 'country'))
SELECT lower(n_name) AS place, coalesce(p, 0) AS policies, CASE WHEN p IS NULL THEN 'untracked' WHEN p = 0 THEN '0' WHEN p <= 5 THEN '1-5' WHEN p <= 15 THEN '6-15' ELSE '16+' END AS bin FROM nation LEFT JOIN n ON lower(n_name) = place""")
def cv07_bins(spark, sf_dir):
    covered = coverage.coverage(*cover_inputs(spark, sf_dir)).filter("spot = 'country'")
    return coverage.coverage_bins(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("place")), covered).select("place", "policies", "bin")


@query(f"""{_COVER}, o AS (SELECT place, count(*) AS n FROM lp WHERE spot <> 'unresolved' GROUP BY 1), k AS (SELECT v.slug, u.country, count(*) AS n FROM v JOIN u ON v.slug = u.slug WHERE u.country IS NOT NULL GROUP BY ALL)
SELECT 'total' AS "check", '' AS place, (SELECT count(*) FROM lp) AS parts, (SELECT count(*) FROM v) AS total
UNION ALL SELECT 'country', c.slug, CAST(coalesce((SELECT sum(n) FROM k WHERE k.country = c.slug), 0) AS BIGINT), coalesce(o.n, 0) FROM (SELECT DISTINCT country AS slug FROM u WHERE country IS NOT NULL) c LEFT JOIN o ON o.place = c.slug""")
def cv06_checks(spark, sf_dir):
    return coverage.check_reconciles(*cover_inputs(spark, sf_dir))


@query(f"""{_COVER}, n AS (SELECT place, spot, count(*) AS p FROM lp WHERE spot <> 'unresolved' GROUP BY ALL), a AS (SELECT place, spot, p FROM n UNION ALL SELECT DISTINCT place, spot, 0 FROM ls WHERE place NOT IN (SELECT place FROM n)),
b AS (SELECT a.place, coalesce(r.name, a.place) AS name, spot, p AS policies FROM a LEFT JOIN r ON r.slug = a.place)
SELECT *, CAST(row_number() OVER (ORDER BY policies DESC, name, place) AS INT) AS position FROM b""")
def cv07_browse(spark, sf_dir):
    return coverage.coverage_browse(*cover_inputs(spark, sf_dir))


D = f"d AS ({DOMAINS_SQL}), tags AS ({TAGS_SQL})"


def groups(spark, sf_dir):
    d = domains(spark, sf_dir)
    made = d.groupBy(F.expr("'g' || (seq % 7)").alias("group")).agg(F.array_sort(F.collect_list("id")).alias("domain_ids"))
    return made.filter("group <> 'g6'").withColumn("domain_ids", F.when(F.col("group") == "g1", F.array_append("domain_ids", F.lit("ghost"))).otherwise(F.col("domain_ids")))


@query(f"""
WITH {D}, t(i, target) AS (VALUES (0, 'dom7'), (1, 'nation_2'), (2, 'g3'), (3, 'file1'), (4, 'zzz'), (5, 'asia'), (6, 'dom6')),
h AS (SELECT i, id, 1 AS rank FROM t JOIN d ON target = 'g3' AND seq % 7 = 3 UNION SELECT i, id, 1 FROM t JOIN tags ON target = tag
UNION SELECT i, id, CASE WHEN target = source_file THEN 2 ELSE 3 END FROM t JOIN d ON enabled AND (target = source_file OR target = id)),
b AS (SELECT i, id FROM (SELECT *, min(rank) OVER (PARTITION BY i) AS best FROM h) WHERE rank = best)
SELECT min(i) AS target_seq, id, FALSE AS unknown FROM b WHERE id IN (SELECT id FROM d WHERE enabled) GROUP BY id UNION ALL SELECT i, NULL, TRUE FROM t WHERE i NOT IN (SELECT i FROM h)""")
def sc01_targets(spark, sf_dir):
    return scans.resolve_targets(domains(spark, sf_dir), groups(spark, sf_dir), "dom7, nation_2,g3,file1,,zzz,asia,dom6").select("target_seq", "id", "unknown")


@query(f"WITH {D} SELECT 'tag' AS filter, id FROM d WHERE enabled AND category = 'agency' AND channel = 'crawl' AND seq % 2 = 0 UNION ALL SELECT 'type', id FROM d WHERE enabled AND seq % 3 = 1 UNION ALL SELECT 'region', id FROM tags WHERE enabled AND tag = 'europe'")
def sc02_filter(spark, sf_dir):
    d = domains(spark, sf_dir).withColumn("tags", F.expr("IF(seq % 2 = 0, array('x', 'y'), array('z'))")).withColumn("policy_types", F.expr("IF(seq % 3 = 1, array('law', 'grant'), array('plan'))"))
    by = {"tag": scans.filter_domains(d, category="agency", tags=["x", "q"], channel="crawl"), "type": scans.filter_domains(d, policy_type="grant"), "region": scans.filter_domains(d, region="europe")}
    tag, kind, region = (v.select(F.lit(k).alias("filter"), "id") for k, v in by.items())
    return tag.union(kind).union(region)


@query(f"WITH {D} SELECT id, row_number() OVER (ORDER BY channel = 'crawl', seq) AS position FROM d")
def sc03_order(spark, sf_dir):
    from pyspark.sql import Window as W

    d = domains(spark, sf_dir)
    return d.select("id", F.row_number().over(W.orderBy(F.col("channel") == "crawl", "seq")).cast("long").alias("position"))


@query(f"WITH {D} SELECT 'unknown_id' AS problem, 'ghost' AS value UNION ALL SELECT 'ungrouped', id FROM d WHERE enabled AND seq % 7 = 6 UNION ALL SELECT DISTINCT 'unknown_region', tag FROM tags WHERE tag NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 10 <> 4)")
def sc04_audit(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").filter("n_nationkey % 10 <> 4").select(F.lower("n_name").alias("region"))
    return scans.validate_sources(domains(spark, sf_dir), groups(spark, sf_dir), regions)


@query(f"""WITH {D} SELECT 'group' AS kind, 'g' || CAST(seq % 7 AS STRING) AS name, count(*) + CASE WHEN seq % 7 = 1 THEN 1 ELSE 0 END AS sources FROM d WHERE seq % 7 <> 6 GROUP BY seq % 7
UNION ALL SELECT CASE WHEN tag = 'europe' OR tag = 'africa' THEN 'broad' WHEN tag IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 = 1) THEN 'state' ELSE 'country' END, tag, count(*) FROM tags WHERE enabled GROUP BY tag
UNION ALL SELECT 'total', '', count(*) FROM d WHERE enabled""")
def sc05_counts(spark, sf_dir):
    local = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 1").select(F.lower("n_name").alias("slug"))
    return scans.source_counts(domains(spark, sf_dir), groups(spark, sf_dir), local)


_FUNNEL = f"WITH {P} SELECT scan_id, domain_id, count(*) AS crawled, count(*) FILTER (seq % 4 = 0 AND seq % 80 >= 40) AS n_matched, CAST(sum(CASE WHEN seq % 4 = 0 AND seq % 80 >= 40 AND seq % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS policies FROM p GROUP BY scan_id, domain_id"


@query(f"SELECT scan_id, finding, domain_id, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, finding ORDER BY domain_id) AS position FROM (SELECT scan_id, domain_id, CASE WHEN n_matched > 0 AND policies = 0 THEN 'matched_without_policy' WHEN n_matched = 0 THEN 'nothing' END AS finding FROM ({_FUNNEL})) WHERE finding IS NOT NULL) WHERE position <= 50")
def sc07_report(spark, sf_dir):
    hit = "seq % 4 = 0 AND seq % 80 >= 40"
    staged = policies(spark, sf_dir).selectExpr("scan_id", "domain_id", f"IF({hit}, 'matched', 'keyword_dropped') AS stage", "FALSE AS near_miss", f"IF({hit} AND seq % 3 = 0, 1L, 0L) AS policies")
    return scans.scan_report(scans.scan_funnel(staged))


@query(f"WITH {P}, v AS ({_VERIFIED}), f AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS position FROM v WHERE {' OR '.join(f'f{i}' for i in range(5))}) SELECT scan_id, CAST(position AS INT) AS position, url, policy_name FROM f WHERE position <= 30")
def sc07_flagged(spark, sf_dir):
    return scans.flagged_list(verified(spark, sf_dir)).select("scan_id", "position", "url", "policy_name")


# A scan's estimate: 100 pages a domain; a screening reads 2000 tokens and writes 50, an analysis 20000 and 1000, the audit 5000 and 2000.
@query(f"""WITH {D}, a AS (SELECT count(*) AS domains, count(*) * 100 AS pages FROM d WHERE enabled), b AS (SELECT *, CAST(floor(pages * 0.1::DOUBLE) AS BIGINT) AS screenings FROM a), c AS (SELECT *, CAST(floor(screenings * 0.5::DOUBLE) AS BIGINT) AS analyses FROM b)
SELECT *, round((screenings * (2000 * 0.25::DOUBLE + 50 * 1.25::DOUBLE) + analyses * (20000 * 3.0::DOUBLE + 1000 * 15.0::DOUBLE) + 5000 * 3.0::DOUBLE + 2000 * 15.0::DOUBLE) / 1000000, 2) AS usd FROM c""")
def sc08_cost(spark, sf_dir):
    return scans.estimate_cost(domains(spark, sf_dir))


_PLAN = f"""WITH {D}, r AS (SELECT id, name, 'website' AS kind, 2 AS kind_rank FROM d WHERE enabled AND channel = 'crawl' AND id IN (SELECT id FROM tags WHERE tag = 'nation_3')
UNION ALL SELECT id, name, 'law_api', 0 FROM d WHERE enabled AND channel = 'law_api' AND id IN (SELECT id FROM tags WHERE tag IN ('nation_3', 'asia', 'europe')) UNION ALL SELECT id, name, 'transposition', 1 FROM d WHERE enabled AND channel = 'transposition')"""


@query(f"{_PLAN} SELECT id, kind, kind_rank FROM r")
def sc09_plan(spark, sf_dir):
    return scans.search_plan(domains(spark, sf_dir), "nation_3", ["asia", "europe"], transposition=True).select("id", "kind", "kind_rank")


@query(f"{_PLAN} SELECT count(*) AS sources, count(*) FILTER (kind = 'website') AS websites, round(count(*) FILTER (kind <> 'website') * 25 * 0.012::DOUBLE + count(*) FILTER (kind = 'website') * 0.15::DOUBLE, 2) AS usd_ceiling FROM r")
def sc09_ceiling(spark, sf_dir):
    return scans.plan_ceiling(scans.search_plan(domains(spark, sf_dir), "nation_3", ["asia", "europe"], transposition=True))


@query(f"WITH {D} SELECT DISTINCT CASE x WHEN 0 THEN 'g1' ELSE 't_' || tag END AS \"group\", id FROM tags, (VALUES (0), (1)) t(x) WHERE NOT (x = 0 AND seq % 7 = 1)")
def sc10_assign(spark, sf_dir):
    d = domains(spark, sf_dir)
    mapping = scans.tagged(d).select(F.col("tag").alias("region"), F.explode(F.array(F.lit("g1"), F.concat(F.lit("t_"), "tag"))).alias("group")).distinct()
    return scans.assign_groups(d, mapping, groups(spark, sf_dir))


# News: JSON payloads and feeds made of documents and events.
@query("SELECT doc_id AS seq, 'Item ' || lang AS title, 'https://n/' || source || '/' || CAST(doc_id % 50 AS STRING) AS url, lang AS snippet FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def sg01_news_json(spark, sf_dir):
    body = F.expr("IF(doc_id % 7 = 0, '{bad', to_json(struct(array(struct('Item ' || lang AS title, IF(doc_id % 5 = 0, '', 'https://n/' || source || '/' || (doc_id % 50)) AS url, lang AS sourcecountry)) AS articles)))")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("q").alias("origin_query"), body.alias("body"))
    return signals.parse_news_json(d).select("seq", "title", "url", "snippet")


@query("SELECT doc_id AS seq, CAST(i AS INT) AS position, 'T' || CAST(i AS STRING) || ' ' || source AS title, 'https://r/' || CAST(doc_id % 40 AS STRING) AS url, CASE i WHEN 0 THEN left(trim(regexp_replace(text, '[<>&\\s]+', ' ', 'g')), 300) ELSE '' END AS snippet FROM documents, (VALUES (0), (2)) t(i)")
def sg02_rss(spark, sf_dir):
    body = F.expr(r"concat('<rss><item><title><![CDATA[ T0 ', source, ']]></title><link>https://r/', doc_id % 40, '</link><description>', regexp_replace(text, '[<>&\\s]+', ' '), '</description></item><ITEM><title></title><link>x</link></ITEM><item><title>T2 ', source, '</title><link> https://r/', doc_id % 40, '</link></item></rss>')")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("q").alias("origin_query"), body.alias("body"))
    return signals.parse_rss(d).select("seq", "position", "title", "url", "snippet")


@query("""
WITH RECURSIVE e AS (SELECT event_id AS seq, 'https://n/' || CAST(user_id * 7 % 83 AS STRING) AS url, event_id % 61 AS title FROM events),
i AS (SELECT min(seq) AS seq, url, title FROM e GROUP BY url, title),
-- the next kept item is the first one whose url and title no kept item has
k(seq, urls, titles) AS (SELECT seq, [url], [title] FROM i WHERE seq = (SELECT min(seq) FROM i)
      UNION ALL SELECT min(i.seq), list_append(any_value(k.urls), arg_min(i.url, i.seq)), list_append(any_value(k.titles), arg_min(i.title, i.seq))
      FROM k JOIN i ON i.seq > k.seq AND NOT list_contains(k.urls, i.url) AND NOT list_contains(k.titles, i.title) HAVING count(*) > 0)
SELECT k.seq, url, 'Title  ' || CAST(title AS STRING) AS title FROM k JOIN e ON k.seq = e.seq""")
def sg03_dedupe(spark, sf_dir):
    items = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "'https://n/' || (user_id * 7 % 83) AS url", "'Title  ' || (event_id % 61) AS title")
    return signals.dedupe_items(items)


@query("SELECT event_id AS index, CASE WHEN event_id % 3 = 0 THEN 'P' ELSE 'G' END AS jurisdiction_guess, CASE WHEN event_id % 4 = 0 THEN props ELSE 'N — ' || props END AS snippet FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50")
def sg04_triage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdicts = e.selectExpr("event_id AS index", "event_type = 'click' AS relevant", "IF(event_id % 3 = 0, 'P', '') AS jurisdiction", "IF(event_id % 4 = 0, NULL, 'N') AS policy_name")
    return signals.triage_items(e.selectExpr("event_id AS index", "'G' AS jurisdiction_guess", "props AS snippet"), verdicts).select("index", "jurisdiction_guess", "snippet")


@query("""
WITH t AS (SELECT *, row_number() OVER (ORDER BY event_id) AS turn FROM events WHERE event_type = 'click'), k AS (SELECT *, 'https://n/' || CAST(user_id AS STRING) AS url FROM t WHERE turn <= 50)
SELECT (SELECT count(*) FROM events) AS items_seen, count(*) AS items_kept, count(DISTINCT url) FILTER (user_id % 4 <> 0) AS leads_added FROM k""")
def sg04_leads(spark, sf_dir):
    """A sweep of all items: of those that triage keeps the first fifty, and of these the ones that no lead has yet."""
    e = table(spark, sf_dir, "events")
    items = e.selectExpr("event_id AS index", "'T' AS title", "'https://n/' || user_id AS url", "'G' AS jurisdiction_guess", "props AS snippet")
    verdicts = e.selectExpr("event_id AS index", "event_type = 'click' AS relevant", "'' AS jurisdiction", "'N' AS policy_name")
    stored = e.filter("user_id % 4 = 0").selectExpr("'https://n/' || user_id AS source_url", "'' AS snippet").distinct()
    return signals.news_leads(items, verdicts, stored)[1]


_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'warning' ELSE 'debug' END"


@query(f"SELECT event_id AS seq, {_LEVEL} AS level FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 5 = 2 ORDER BY event_id DESC LIMIT 100")
def sg05_logs(spark, sf_dir):
    logs = table(spark, sf_dir, "events").selectExpr("event_id AS seq", f"{_LEVEL} AS level", "'s' || (user_id % 5) AS scan_id")
    return signals.query_logs(logs, level="Warning", scan_id="s2").select("seq", "level")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'key [REDACTED] end' WHEN 1 THEN 'key [REDACTED]xyz' WHEN 2 THEN 'key [REDACTED]' ELSE 'key sk-short ' || props END AS line FROM events")
def sg06_redact(spark, sf_dir):
    line = F.expr("CASE event_id % 4 WHEN 0 THEN concat('key sk', '-ant-', 'a1_b', event_id, ' end') WHEN 1 THEN 'key eyJabc_1.eyJxyz' WHEN 2 THEN concat('key AI', 'za', repeat('x', 31)) ELSE concat('key sk-short ', props) END")
    return table(spark, sf_dir, "events").select("event_id", X.redact(line).alias("line"))


def scan_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type AS type", "date_format(ts, 'dd') AS scan_id", "'d' || (user_id % 12) AS domain_id")


@query("SELECT strftime(ts, '%d') AS scan_id, 'd' || CAST(user_id % 12 AS STRING) AS domain_id, count(*) AS events, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {n}" for n, t in signals.COUNTERS.items()) + " FROM events GROUP BY 1, 2")
def sg07_progress(spark, sf_dir):
    return signals.progress(scan_events(spark, sf_dir))


@query("SELECT event_id, scan_id, CAST(position AS INT) AS position FROM (SELECT event_id, strftime(ts, '%d') AS scan_id, row_number() OVER (PARTITION BY strftime(ts, '%d') ORDER BY ts, event_id) AS position FROM events) WHERE position <= 100")
def sg08_history(spark, sf_dir):
    return signals.event_history(scan_events(spark, sf_dir), 100).select("event_id", "scan_id", "position")


#: Requests every three seconds or so, a third of them of one key, of which the limit allows four a minute.
_REQUESTS = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 20 END AS key, event_id AS request_id, 1704067200 + event_id * 3 + event_id * event_id % 7 AS second"
PER_MINUTE = 4
SG09_SQL = f"""
WITH RECURSIVE r AS (SELECT {_REQUESTS} FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY second, request_id) AS n FROM r),
w(key, n, request_id, wait_s, recent) AS (SELECT key, n, request_id, NULL::DOUBLE, [second] FROM o WHERE n = 1
      UNION ALL SELECT key, n, request_id, CASE WHEN len(held) >= {PER_MINUTE} THEN 60.0::DOUBLE - (second - held[1]) END, CASE WHEN len(held) >= {PER_MINUTE} THEN held ELSE list_append(held, second) END
      FROM (SELECT o.*, list_filter(w.recent, lambda t: o.second - t <= 60) AS held FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1))
SELECT key, request_id, wait_s FROM w"""


def limited_requests(events):
    return events.selectExpr(*_REQUESTS.split(", ")).selectExpr("key", "timestamp_seconds(second) AS ts", "request_id")


@query(SG09_SQL)
def sg09_rate_limit(spark, sf_dir):
    return signals.rate_limit(limited_requests(table(spark, sf_dir, "events")), PER_MINUTE).select("key", "request_id", "wait_s")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS used, greatest(0, 300 - count(*)) AS remaining FROM events WHERE event_type <> 'error' GROUP BY 1")
def sg10_daily(spark, sf_dir):
    return signals.daily_usage(table(spark, sf_dir, "events").filter("event_type <> 'error'"), 300)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(o_orderkey % 400) AS BIGINT) AS used, CAST(greatest(0, 30000 - sum(o_orderkey % 400)) AS BIGINT) AS remaining, CAST(least(1000, greatest(0, 30000 - sum(o_orderkey % 400))) AS BIGINT) AS run_cap FROM orders GROUP BY 1")
def sg11_monthly(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").selectExpr("o_orderdate AS ts", "o_orderkey % 400 AS queries")
    return signals.monthly_usage(calls)


@query("SELECT event_type AS domain_id, count(*) AS pages, count(*) FILTER (event_id % 4 = 0 AND event_id % 3 <> 0) AS usable, count(*) FILTER (event_id % 4 IN (1, 2)) AS errors FROM events GROUP BY 1")
def io01_pages(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_type AS domain_id", "CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'captcha' WHEN 2 THEN 'paywall' ELSE 'not_found' END AS status", "IF(event_id % 3 = 0, '', props) AS content")
    return readers.page_errors(p)


@query("SELECT strftime(ts, '%Y') AS ts, event_type AS event, CAST(user_id AS STRING) AS scan_id FROM events WHERE event_id % 5 NOT IN (0, 1)")
def io03_logs(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '{not json' ELSE to_json(struct(date_format(ts, 'yyyy') AS ts, event_type AS event, CAST(user_id AS STRING) AS scan_id, 1 AS other)) END AS value")
    return readers.parse_log(lines).select("ts", "event", "scan_id")


def staging(spark, sf_dir):
    p = policies(spark, sf_dir).selectExpr("*", "'English' AS source_language", "'success' AS crawl_status", "CAST(NULL AS STRING) AS error_details", "IF(seq % 3 = 0, array('duplicate_url', 'future_date'), array()) AS verification_flags", "array('A; ', 'B') AS referenced_policies", "CAST(NULL AS ARRAY<STRING>) AS referenced_urls")
    return sinks.to_staging(p, place_names(spark, sf_dir), {"law": "Legislation", "grant": "Grant"}, {"enacted": "In force"}, "bot")


@query(f"""
WITH {P} SELECT url AS Link, policy_name AS Name, CASE policy_type WHEN 'law' THEN 'Legislation' WHEN 'grant' THEN 'Grant' ELSE '' END AS kind, CASE lifecycle_stage WHEN 'enacted' THEN 'In force' ELSE '' END AS Status, CAST(effective_date AS STRING) AS day,
coalesce(CAST(relevance_score AS STRING), '') AS score, coalesce(bill_number, '') AS bill, CASE WHEN seq % 3 = 0 THEN 'duplicate_url, future_date' ELSE '' END AS flags, 'A; ; B' AS refs, CASE WHEN coalesce(jurisdiction, '') IN ('', 'Unknown', 'Atlantis') THEN '' ELSE r_name END AS area FROM p JOIN nation ON nation_key = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def io05_staging(spark, sf_dir):
    s = staging(spark, sf_dir)
    names = {"Link": "Link", "Name": "Name", sinks.MASTER[5]: "kind", "Status": "Status", sinks.MASTER[9]: "day", "Relevance Score": "score", "Bill Number": "bill", "Verification Flags": "flags", "Referenced Policies": "refs", "Geographical Area": "area"}
    return s.select(*(F.col(f"`{k}`").alias(v) for k, v in names.items()))


@query(f"""
WITH {P} SELECT url, trim(policy_name) AS policy_name, CASE WHEN coalesce(jurisdiction, '') = '' THEN '' WHEN jurisdiction IN ('Unknown', 'Atlantis') THEN jurisdiction ELSE n_name END AS jurisdiction, coalesce(CAST(relevance_score AS STRING), '0') AS relevance_score, CAST(effective_date AS STRING) AS effective_date, discovered_at, bill_number,
CASE WHEN seq % 3 = 0 THEN 'duplicate_url|future_date' ELSE '' END AS flags, 'A|B' AS refs FROM p JOIN nation ON nation_key = n_nationkey""")
def io06_from_staging(spark, sf_dir):
    d = sinks.from_staging(staging(spark, sf_dir))
    return d.select("url", "policy_name", "jurisdiction", "relevance_score", "effective_date", F.col("discovered_at").cast("timestamp_ntz").alias("discovered_at"), "bill_number", F.array_join("verification_flags", "|").alias("flags"), F.array_join("referenced_policies", "|").alias("refs"))


@query(f"""
WITH {P}, b AS (SELECT seq, CASE WHEN seq % 41 = 0 THEN 'missing url' WHEN seq % 43 = 0 THEN 'wrong scheme' WHEN seq % 47 = 0 THEN 'missing name' END AS reason, url FROM p),
n AS (SELECT count(DISTINCT url) AS k FROM b WHERE reason IS NULL AND url NOT IN (SELECT url FROM p WHERE seq % 9 = 0)), i AS (SELECT count(*) AS read, count(*) FILTER (reason IS NOT NULL) AS invalid FROM b)
SELECT read, k AS imported, read - invalid - k AS duplicates, invalid FROM i, n""")
def io07_import(spark, sf_dir):
    return imported(spark, sf_dir)[1]


def imported(spark, sf_dir):
    p = policies(spark, sf_dir)
    rows = p.withColumn("url", F.expr("CASE WHEN seq % 41 = 0 THEN ' ' WHEN seq % 43 = 0 THEN 'ftp://x' ELSE url END")).withColumn("policy_name", F.expr("IF(seq % 47 = 0, '', policy_name)"))
    blank = [F.lit("").alias(h) for h in sinks.HEADERS if h not in ("Link", "Name", "Relevance Score")]
    sheet = rows.select("seq", F.col("url").alias("Link"), F.col("policy_name").alias("Name"), F.coalesce(F.col("relevance_score").cast("string"), F.lit("")).alias("Relevance Score"), *blank)
    return sinks.import_staging(sheet, p.filter("seq % 9 = 0"))


@query(f"WITH {P} SELECT seq + 2 AS \"row\", CASE WHEN seq % 41 = 0 THEN 'missing url' WHEN seq % 43 = 0 THEN 'wrong scheme' ELSE 'missing name' END AS reason FROM p WHERE seq % 41 = 0 OR seq % 43 = 0 OR seq % 47 = 0")
def io07_invalid_rows(spark, sf_dir):
    return imported(spark, sf_dir)[2]


@query(f"WITH {P}, b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM p) SELECT seq, url FROM b WHERE rn = 1 AND url NOT IN (SELECT url FROM p WHERE seq % 6 = 1)")
def io08_export(spark, sf_dir):
    p = policies(spark, sf_dir)
    return sinks.export_new(p, p.filter("seq % 6 = 1")).select("seq", "url")


@query(f"WITH {P}, e AS (SELECT min(seq) AS seq, url FROM p WHERE seq % 6 = 1 GROUP BY url) SELECT * FROM e UNION ALL SELECT min(seq), url FROM p WHERE url NOT IN (SELECT url FROM e) GROUP BY url")
def io08_append(spark, sf_dir):
    """What is exported once a batch has been appended, twice, to what was."""
    p = policies(spark, sf_dir)
    exported = policy_store(spark, p.filter("seq % 6 = 1"))
    for _ in range(2):
        sinks.append_new(p.select("seq", "url"), exported)
    return exported.read()


_SNAPSHOT = f"SELECT lead_id, CASE WHEN title <> '' THEN title ELSE snippet END AS title, CASE chase_outcome WHEN 'policy_found' THEN 'Found: ' || coalesce(policy_url, '') WHEN 'no_policy' THEN 'Checked - nothing found' WHEN 'fetch_failed' THEN 'Fetch failed: ' || coalesce(chase_error, '') ELSE '' END AS outcome FROM ({_CHASED})"


@query(_SNAPSHOT)
def io09_lead_snapshot(spark, sf_dir):
    return sinks.export_leads(chased(spark, sf_dir)).select("lead_id", "title", "outcome")


@query(_SNAPSHOT)
def io09_switch(spark, sf_dir):
    """The queue as a reader finds it after an empty snapshot was replaced."""
    at = f"{shared_dir(spark)}/leads-{uuid.uuid4().hex}"
    leads = sinks.export_leads(chased(spark, sf_dir)).select("lead_id", "title", "outcome")
    bucketed.write_snapshot(leads.limit(0), at)
    bucketed.write_snapshot(leads, at)
    return bucketed.read_snapshot(spark, at)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'only_left' WHEN o_orderkey % 50 = 1 THEN 'only_right' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 50 IN (0, 1, 2)")
def io10_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = o.filter("o_orderkey % 50 <> 0").withColumn("o_orderstatus", F.expr("IF(o_orderkey % 50 = 2, NULL, o_orderstatus)"))
    return sinks.reconcile(o.filter("o_orderkey % 50 <> 1"), other, "o_orderkey")
