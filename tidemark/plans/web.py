"""Queries over pages, their URLs and texts (URL, EX, KW), each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import extract, frontier, keywords, language
from ..operators.scans import followup_counts, followup_urls, outcomes, scan_funnel
from .inputs import POLICIES_SQL, policies, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


S = "'" + U.SPLIT.replace("'", "''") + "'"
NETLOC, PATH = f"regexp_extract(url, {S}, 2)", f"regexp_extract(url, {S}, 3)"
HOST = rf"regexp_replace(lower({NETLOC}), '^www\.', '')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, {HOST} = 'example.net' OR ends_with({HOST}, '.example.net') AS same FROM pages")
def url01_same_site(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.same_site(U.netloc(F.col("url")), F.lit("www.Example.net")).alias("same"))


@query(rf"SELECT page_id, contains(lower({PATH}), '/en/1') OR contains(lower({PATH}), '/fr/') OR regexp_matches({PATH}, '/\d\d$|[?&]page=\d+') AS skip FROM pages")
def url02_skip_rules(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.should_skip_url(F.col("url"), ["/en/1", "/fr/"], [r"/\d\d$", r"[?&]page=\d+"]).alias("skip"))


@query(f"SELECT page_id, NOT ends_with(lower({PATH}), '.html') AND NOT regexp_matches(lower({PATH}), '^/de/.*5.*$') AND regexp_matches(lower({PATH}), '^(/en/.*|/de/.*|/es/..)$') AS allowed FROM pages")
def url03_path_allowed(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.path_allowed(F.col("url"), [".html"], ["/de/*5*"], ["/en/*", "/DE/*", "/es/??"]).alias("allowed"))


@query("SELECT page_id, CAST(" + " + ".join(f"contains(lower(url), '{t}')::INT" for t in U.PRIORITY_TERMS) + " + 2 * ends_with(lower(url), '.pdf')::INT AS INT) AS priority FROM pages")
def url04_priority(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_priority(F.col("url")).alias("priority"))


@query(f"""
WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages)
SELECT DISTINCT page_id, url AS src_url, regexp_extract(url, {S}, 1) || '://' || {NETLOC} || regexp_replace(replace(href, '&amp;', '&'), '#.*', '') AS dst_url FROM h
WHERE NOT ends_with(lower(regexp_replace(replace(href, '&amp;', '&'), '[#?].*', '')), '.pdf')""")
def url05_links(spark, sf_dir):
    return frontier.extract_links(pages(spark, sf_dir), extensions=(".pdf",))


_MAPS = f"""SELECT {NETLOC} AS site, page_id AS seq, '<urlset><url><loc> ' || url || ' </loc></url><url><LOC>https://' || {NETLOC} || '/map' || CAST(page_id AS STRING) || '.xml</LOC></url></urlset>' AS body FROM pages"""


@query(f"""
WITH m AS ({_MAPS}), l AS (SELECT site, seq, trim(unnest(regexp_extract_all(body, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1))) AS loc, generate_subscripts(regexp_extract_all(body, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1), 1) AS i FROM m),
k AS (SELECT *, CASE WHEN ends_with(lower(loc), '.xml') THEN 'sitemap' ELSE 'url' END AS kind FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY seq, i) AS position FROM k)
SELECT site, kind, loc, CAST(position AS INT) AS position FROM r WHERE position <= CASE kind WHEN 'url' THEN 20 ELSE 5 END""")
def url06_sitemaps(spark, sf_dir):
    body = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc></url><url><LOC>https://"), U.netloc(F.col("url")), F.lit("/map"), F.col("page_id").cast("string"), F.lit(".xml</LOC></url></urlset>"))
    return frontier.sitemap_urls(pages(spark, sf_dir).select(U.netloc(F.col("url")).alias("site"), F.col("page_id").alias("seq"), body.alias("body")), max_urls=20)


@query(f"""
WITH p AS (SELECT page_id AS seq, url, {HOST} AS domain, {' + '.join(f"contains(lower(url), '{t}')::INT" for t in U.PRIORITY_TERMS)} + 2 * ends_with(lower(url), '.pdf')::INT AS priority FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, seq) AS turn FROM p)
SELECT domain, url, CAST(priority AS INT) AS priority, CAST(turn AS INT) AS turn FROM r WHERE turn <= 20""")
def url07_frontier(spark, sf_dir):
    urls = pages(spark, sf_dir).select(F.col("page_id").alias("seq"), "url", U.bare_host(U.netloc(F.col("url"))).alias("domain"))
    return frontier.frontier_topk(urls, 20).select("domain", "url", "priority", "turn")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'u' || CAST(o_custkey AS STRING) AS s, 'u' || CAST(CAST(floor(o_orderkey / 40) AS BIGINT) AS STRING) AS d FROM orders),
b(url, depth) AS (SELECT 'u' || CAST(x AS STRING), 0 FROM (VALUES (1), (2), (3)) t(x) UNION SELECT e.d, b.depth + 1 FROM b JOIN e ON b.url = e.s WHERE b.depth < 3)
SELECT url, CAST(min(depth) AS INT) AS depth FROM b GROUP BY url""")
def url08_reach(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").selectExpr("'u' || o_custkey AS src_url", "'u' || CAST(floor(o_orderkey / 40) AS BIGINT) AS dst_url")
    return frontier.bfs_depth(edges, spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string"))


@query(f"""
WITH p AS ({POLICIES_SQL}), l AS (SELECT domain_id, seq, unnest(['https://docs.site1.gov/r/' || CAST(seq % 40 AS STRING), 'ftp://site1.gov/x', 'https://other.org/' || CAST(seq AS STRING), 'https://site1.gov/bills/' || CAST(CAST(floor(seq / 3) AS BIGINT) AS STRING)]) AS link, unnest([0, 1, 2, 3]) AS i FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY domain_id, link ORDER BY seq, i) AS first FROM l WHERE regexp_matches(link, '^https?://(docs\\.)?site1\\.gov')),
n AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY seq, i) AS turn FROM f WHERE first = 1 AND link NOT IN (SELECT url FROM p))
SELECT domain_id, link, CAST(turn AS INT) AS turn FROM n WHERE turn <= 20""")
def url09_followups(spark, sf_dir):
    return followup_urls(cited_links(spark, sf_dir), policies(spark, sf_dir), on_site())


@query(f"""
WITH p AS ({POLICIES_SQL}), l AS (SELECT DISTINCT domain_id, unnest(['https://docs.site1.gov/r/' || CAST(seq % 40 AS STRING), 'https://other.org/' || CAST(seq AS STRING), 'https://site1.gov/bills/' || CAST(CAST(floor(seq / 3) AS BIGINT) AS STRING)]) AS link FROM p),
n AS (SELECT domain_id, count(*) FILTER (NOT contains(link, 'other.org')) AS n, count(*) FILTER (contains(link, 'other.org')) AS cross_site FROM l WHERE link NOT IN (SELECT url FROM p) GROUP BY 1)
SELECT domain_id, least(n, 20) AS followed, greatest(n - 20, 0) AS over_cap, cross_site FROM n""")
def url09_counts(spark, sf_dir):
    return followup_counts(cited_links(spark, sf_dir), policies(spark, sf_dir), on_site())


def cited_links(spark, sf_dir):
    return policies(spark, sf_dir).selectExpr("domain_id", "'site1.gov' AS base", "seq", "array('https://docs.site1.gov/r/' || (seq % 40), 'ftp://site1.gov/x', 'https://other.org/' || seq, 'https://site1.gov/bills/' || CAST(floor(seq / 3) AS BIGINT)) AS referenced_urls")


def on_site():
    return U.same_site(U.netloc(F.col("link")), F.col("base"))


_CODE = "CAST(CASE event_type WHEN 'error' THEN 403 + event_id % 30 WHEN 'click' THEN 500 ELSE 200 END AS INT)"
_SERVER = "CASE WHEN event_id % 11 = 0 THEN 'CloudFlare' WHEN event_id % 13 = 0 THEN 'AkamaiGHost' END"
_BODY = "CASE WHEN event_id % 5 = 0 THEN 'Access Denied: rate limit ' || props WHEN event_id % 7 = 0 THEN 'please LOGIN REQUIRED' ELSE props END"


@query(f"""
WITH r AS (SELECT event_id, {_CODE} AS code, lower(coalesce({_SERVER}, '')) AS server, lower(left({_BODY}, 2000)) AS body FROM events)
SELECT event_id, CASE WHEN code = 403 THEN 'access_denied' WHEN code = 404 THEN 'not_found' WHEN code = 429 THEN 'rate_limited' WHEN code >= 400 THEN 'unknown_error' ELSE 'success' END AS status,
'HTTP ' || CAST(code AS STRING) || CASE WHEN server LIKE '%cloudflare%' THEN ' -- Cloudflare bot protection' WHEN server LIKE '%akamaighost%' THEN ' -- Akamai WAF' {' '.join(f"WHEN contains(body, '{k}') THEN ' -- {v}'" for k, v in U.DENIALS)} ELSE '' END AS reason FROM r""")
def url10_responses(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("event_id", f"{_CODE} AS code", f"{_SERVER} AS server", f"{_BODY} AS body")
    return r.select("event_id", U.response_status(F.col("code")).alias("status"), U.denial_reason(F.col("code"), F.col("server"), F.col("body")).alias("reason"))


@query(r"""SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS INT) AS visible FROM pages""")
def url11_visible_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.visible_text_len(F.col("html")).alias("visible"))


@query(f"SELECT page_id, page_id % 9 = 0 OR ends_with(lower(regexp_extract(u, {S}, 3)), '.pdf') AS pdf FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {PATH} || '.PDF?x=1' ELSE url END AS u FROM pages)")
def url12_pdf(spark, sf_dir):
    p = pages(spark, sf_dir)
    url = F.when(F.col("page_id") % 4 == 0, F.concat(U.path(F.col("url")), F.lit(".PDF?x=1"))).otherwise(F.col("url"))
    return p.select("page_id", U.looks_like_pdf(url, F.when(F.col("page_id") % 9 == 0, "Application/PDF; q=1")).alias("pdf"))


_TLDS = [".gov.uk", ".gov", ".virginia.gov", ".gouv.fr", ".de", ".com", ".sejm.gov.pl", ".co.jp", ".west-virginia.gov"]
_SITE = "element_at(split(regexp_extract(url, '" + U.SPLIT + r"', 2), '\\.'), -3) || array(" + ", ".join(f"'{t}'" for t in _TLDS) + ")[CAST(page_id % 9 AS INT)]"
_SITE_SQL = f"list_extract(string_split({NETLOC}, '.'), -3) || ['" + "', '".join(_TLDS) + "'][CAST(page_id % 9 AS INT) + 1]"
_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(h, '{s}') OR h = '{s[1:]}' THEN '{s}'" for s in sorted(U.SUFFIX_REGIONS, key=len, reverse=True)) + " END"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tld = F.get(F.array(*map(F.lit, _TLDS)), (F.col("page_id") % 9).cast("int"))
    return pages(spark, sf_dir).select("page_id", F.concat(F.element_at(F.split(U.netloc(F.col("url")), r"\."), -3), tld).alias("host"))


@query(f"""
WITH h AS (SELECT page_id, {_SITE_SQL} AS h FROM pages), s AS (SELECT *, {_SUFFIX} AS suffix FROM h)
SELECT page_id, coalesce(CASE WHEN suffix = '.gov' AND len(string_split(h, '.')) >= 3 THEN 'us us_states ' || replace(list_extract(string_split(h, '.'), -2), '-', '_') WHEN suffix = '.gov' THEN 'us' {' '.join(f"WHEN suffix = '{k}' THEN '{' '.join(v)}'" for k, v in U.SUFFIX_REGIONS.items() if v)} END, '') AS regions FROM s""")
def url13_regions(spark, sf_dir):
    return hosts(spark, sf_dir).select("page_id", F.array_join(U.detect_region(F.col("host")), " ").alias("regions"))


@query(f"""
WITH h AS (SELECT page_id, {_SITE_SQL} AS h FROM pages), s AS (SELECT *, {_SUFFIX} AS suffix, string_split(h, '.') AS p FROM h)
SELECT page_id, left(CASE WHEN suffix = '.gov' AND len(p) >= 3 THEN CASE list_extract(p, -2) WHEN 'virginia' THEN 'va' WHEN 'west-virginia' THEN 'wv' ELSE left(list_extract(p, -2), 2) END || '_' || p[1]
WHEN suffix = '.gov' THEN 'us_' || p[1] WHEN suffix = '.gov.uk' THEN 'uk_' || replace(left(h, length(h) - 7), '.', '_')
ELSE regexp_replace(regexp_replace(regexp_replace(CASE WHEN suffix IS NOT NULL THEN left(h, length(h) - length(suffix)) ELSE h END, '[.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') END, 30) AS id FROM s""")
def url14_domain_ids(spark, sf_dir):
    return hosts(spark, sf_dir).select("page_id", U.domain_id(F.col("host")).alias("id"))


_ADDRESS = "CASE WHEN event_id % 17 = 0 THEN 'ftp://' ELSE 'http://' END || CASE WHEN event_id % 3 = 0 THEN 'host' || CAST(event_id AS STRING) || '.org' ELSE CAST(event_id % 256 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 7 AS STRING) || '.1:80' END || '/x'"


@query(f"""
WITH a AS (SELECT event_id, {_ADDRESS} AS url FROM events), p AS (SELECT event_id, url, string_split(regexp_replace({NETLOC}, ':\\d*$', ''), '.') AS o, regexp_matches({NETLOC}, '^\\d+\\.\\d+') AS ip FROM a),
n AS (SELECT *, try_cast(o[1] AS INT) AS a, try_cast(o[2] AS INT) AS b, try_cast(o[3] AS INT) AS c FROM p)
SELECT event_id, starts_with(url, 'http:') AND NOT (ip AND (a IN (0, 10, 127) OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b IN (18, 19) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113 OR a >= 224)) AS public FROM n""")
def url15_public_hosts(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_ADDRESS} AS url").select("event_id", U.is_public_url(F.col("url")).alias("public"))


_ARTICLE = r"""list_filter(list_transform(string_split(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]+>', chr(10), 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""


@query(f"""SELECT page_id, array_to_string({_ARTICLE}, chr(10)) AS text, trim(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&amp;', '&')) AS title, regexp_extract(html, '<html lang="(..)', 1) AS language FROM pages""")
def ex01_extract(spark, sf_dir):
    return extract.extract_content(pages(spark, sf_dir)).select("page_id", "text", "title", "language")


PROFILES = {"de": ["der", "und", "die", "von", "den"], "en": ["the", "of", "and", "is", "with"], "es": ["que", "el", "los", "con", "para"], "fr": ["le", "les", "des", "est", "une"]}


@query("""
WITH w AS (SELECT doc_id, length(text) AS n, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents),
c AS (SELECT doc_id, n, """ + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(p) for p in words)}))) AS {lang}" for lang, words in PROFILES.items()) + """ FROM w)
SELECT doc_id, CASE WHEN n <= 50 OR greatest(de, en, es, fr) = 0 THEN NULL WHEN fr = greatest(de, en, es, fr) THEN 'fr' WHEN es = greatest(de, en, es, fr) THEN 'es' WHEN en = greatest(de, en, es, fr) THEN 'en' ELSE 'de' END AS language FROM c""")
def ex03_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extract.detect_language(F.col("text"), PROFILES).alias("language"))


#: n-grams of all texts by number, the model of four texts in five, and every language's score of every text.
_GRAMS = """
c AS (SELECT doc_id, lang, [unicode(x)::BIGINT FOR x IN string_split(text, '')] AS c FROM documents WHERE text IS NOT NULL AND text <> ''),
g AS (SELECT doc_id, lang, unnest(list_concat([x * 3 % 4096 FOR x IN c], list_concat([((c[i] * 31 + c[i + 1]) * 3 + 1) % 4096 FOR i IN range(1, len(c))], [(((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) * 3 + 2) % 4096 FOR i IN range(1, len(c) - 1)]))) AS feature FROM c),
t AS (SELECT doc_id, lang, feature, count(*) AS n FROM g GROUP BY ALL),
l AS (SELECT DISTINCT lang FROM c WHERE lang IS NOT NULL AND doc_id % 5 <> 0),
k AS (SELECT l.lang, f.feature, coalesce(n, 0) + 1 AS n FROM l CROSS JOIN range(4096) f(feature) LEFT JOIN (SELECT lang, feature, sum(n) AS n FROM t WHERE doc_id % 5 <> 0 GROUP BY ALL) x ON x.lang = l.lang AND x.feature = f.feature),
m AS (SELECT lang, feature, ln(n::DOUBLE / sum(n) OVER (PARTITION BY lang)) AS share FROM k),
s AS (SELECT doc_id, m.lang AS language, sum(t.n * share) / sum(t.n) AS score FROM t JOIN m ON t.feature = m.feature GROUP BY doc_id, m.lang),
b AS (SELECT doc_id, language, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1)"""


def language_model(spark, sf_dir):
    return language.fit(table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0"))


@query(f"WITH {_GRAMS} SELECT d.doc_id, CASE WHEN length(text) > 50 THEN language END AS language, round(score, 6) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id")
def ex03_ngram_language(spark, sf_dir):
    found = language.score_rows(table(spark, sf_dir, "documents").select("doc_id", "text", (F.length("text") > 50).alias("told")), language_model(spark, sf_dir))
    return found.select("doc_id", F.when(F.col("told"), F.col("language")).alias("language"), F.round("score", 6).alias("score"))


@query(f"WITH {_GRAMS} SELECT lang, count(*) AS n, count(*) FILTER (language = lang) AS correct FROM documents d JOIN b ON b.doc_id = d.doc_id WHERE d.doc_id % 5 = 0 AND length(text) > 50 AND lang IS NOT NULL GROUP BY lang")
def ex03_held_out(spark, sf_dir):
    """The fifth of the documents that the model hasn't seen, by their declared language."""
    held = table(spark, sf_dir, "documents").filter("doc_id % 5 = 0 AND length(text) > 50 AND lang IS NOT NULL")
    found = language.score_rows(held.select("lang", "text"), language_model(spark, sf_dir))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("correct"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS words, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 50 AS short FROM documents")
def ex04_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.short_content(F.col("text")).alias("short"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def ex05_strip_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.strip_tags_spaced(F.col("html")).alias("text"))


@query("""
WITH p AS (SELECT doc_id, text, list_filter([instr(lower(text), 'xqzt'), instr(lower(text), 'benchwh'), instr(lower(text), 'thstthe')], lambda x: x > 8001)[1] - 1 AS pos FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE left(CASE WHEN pos IS NULL THEN left(text, 8000) ELSE left(text, 8000) || chr(10) || '[...]' || chr(10) || substr(text, greatest(0, pos - 1000) + 1, least(length(text), pos + 2000) - greatest(0, pos - 1000)) END, 12500) END AS excerpt FROM p""")
def ex06_excerpt(spark, sf_dir):
    terms = F.array(*map(F.lit, ["xqzt", "Benchwh", "thstthe"]))
    return table(spark, sf_dir, "documents").select("doc_id", X.screening_excerpt(F.col("text"), terms).alias("excerpt"))


T = keywords.Term
TERMS = [T("subject", 3.0, "en", "the"), T("subject", 3.0, "en", "thing"), T("subject", 3.0, "fr", "leaux"), T("policy_type", 1.5, "en", "with"), T("policy_type", 1.5, "de", "ung"), T("context", 2.0, "fr", "dans"), T("context", 2.0, "es", "para"), T("context", 2.0, "en", "thing"), T("energy", 2.0, "de", "keit"), T("energy", 2.0, "en", "heon")]
RULES = keywords.Rules(boost=("ing", "que"), penalty=("from", "sur"), exclusions=("job opening", "Licensed under CC"), pairs=(("context", "subject"), ("subject", "policy_type"), ("energy", "policy_type")))
_EDGE = r"[^\p{L}\p{N}_]"


def _whole(word: str) -> str:
    return f"regexp_matches(text, '(?i)(^|{_EDGE}){word}({_EDGE}|$)')"


def _hit(t: keywords.Term) -> str:
    return f"contains(lower(text), '{t.term}')" if t.lang in keywords.COMPOUND_LANGS else _whole(t.term)


_OUT = "(" + " OR ".join(f"contains(lower(text), '{x.lower()}')" for x in RULES.exclusions) + ")"
_SCORED = f"""SELECT doc_id, source, lang, text, {_OUT} AS excluded, {', '.join(f"(NOT {_OUT} AND {_hit(t)})::INT AS k{i}" for i, t in enumerate(TERMS))},
CASE WHEN {_OUT} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {' + '.join(f'{t.weight} * ({_hit(t)})::INT' for t in TERMS)} + 3.0 * ({' + '.join(f'({_whole(w)})::INT' for w in RULES.boost)}) - 2.0 * ({' + '.join(f'({_whole(w)})::INT' for w in RULES.penalty)})) END AS score FROM documents"""
_COUNT = " + ".join(f"k{i}" for i in range(len(TERMS)))
_CAT = lambda c: "(" + " + ".join(f"k{i}" for i, t in enumerate(TERMS) if t.category == c) + " > 0)"
_PASS = f"(NOT excluded AND score >= least AND {_COUNT} >= 2 AND ({' OR '.join(f'{_CAT(a)} AND {_CAT(b)}' for a, b in RULES.pairs)}))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return keywords.score_keywords(keywords.match_keywords(docs, TERMS), RULES)


@query(f"SELECT doc_id, {_OUT} AS excluded FROM documents")
def kw01_exclusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keywords.is_excluded(F.col("text"), RULES).alias("excluded"))


@query("SELECT doc_id, " + " || ".join(f"CASE WHEN {_hit(t)} THEN '{t.category}:{t.lang}:{t.term};' ELSE '' END" for t in TERMS) + " AS found FROM documents")
def kw02_matches(spark, sf_dir):
    m = keywords.match_keywords(table(spark, sf_dir, "documents"), TERMS)
    return m.select("doc_id", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["category"], x["lang"], F.concat(x["term"], F.lit(";")))), "").alias("found"))


@query("SELECT doc_id, " + " || ".join(f"CASE WHEN {_hit(t)} THEN '{t.category}:{t.lang}:{t.term};' ELSE '' END" for t in TERMS[:4]) + " AS found FROM documents")
def kw02_matches_builtin(spark, sf_dir):
    m = table(spark, sf_dir, "documents").withColumn("matches", keywords.match_terms(F.col("text"), TERMS[:4]))
    return m.select("doc_id", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["category"], x["lang"], F.concat(x["term"], F.lit(";")))), "").alias("found"))


@query(f"SELECT doc_id, excluded, score, CAST({_COUNT} AS INT) AS n_matches, {' || '.join(f"CASE WHEN {_CAT(c)} THEN '{c} ' ELSE '' END" for c in ('context', 'energy', 'policy_type', 'subject'))} AS categories FROM ({_SCORED})")
def kw03_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "excluded", "score", "n_matches", F.array_join(F.transform("categories", lambda c: F.concat(c, F.lit(" "))), "").alias("categories"))


_BONUS = dict(gov_suffixes=[".net", ".gov"], gov=1.0, law_paths=[r"/bill[s]?[-/]", r"/de/\d", r"/es/9"], law=1.5, number=r"[/=](H\.?B|2|en/3)\d*", bonus=1.0)


@query(rf"SELECT page_id, 1.0::DOUBLE * (ends_with(lower({NETLOC}), '.net') OR ends_with(lower({NETLOC}), '.gov'))::INT + 1.5 * regexp_matches(f, '(?i)/bills?[-/]|/de/\d|/es/9')::INT + 1.0 * regexp_matches(f, '(?i)[/=](H\.?B|2|en/3)\d*')::INT AS bonus FROM (SELECT page_id, url, lower({PATH}) || CASE WHEN regexp_extract(url, {S}, 4) <> '' THEN '?' || regexp_extract(url, {S}, 4) ELSE '' END AS f FROM pages)")
def kw05_url_bonus(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_bonus(F.col("url"), **_BONUS).alias("bonus"))


@query(f"SELECT doc_id, score, {_PASS} AS passes, NOT {_PASS} AND score >= 0.6 * least AS near_miss FROM (SELECT *, 5.0 AS least FROM ({_SCORED}))")
def kw06_gate(spark, sf_dir):
    return keywords.judge(scored(spark, sf_dir), RULES).select("doc_id", "score", "passes", "near_miss")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN 2.5 WHEN s_suppkey % 3 = 0 THEN 2.0 ELSE 3.0 END::DOUBLE AS least FROM supplier")
def kw08_thresholds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", keywords.effective_min_score(F.when(F.col("s_suppkey") % 8 == 0, 2.5), F.col("s_suppkey") % 3 == 0).alias("least"))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_STAGED = f"""SELECT doc_id, source AS domain_id, lang AS scan_id, CASE WHEN NOT (source = 'src3') AND {_WORDS} < 50 THEN 'short' WHEN excluded THEN 'excluded' WHEN source <> 'src3' AND NOT {_PASS} THEN 'keyword_dropped' ELSE 'matched' END AS stage,
NOT {_PASS} AND score >= 0.6 * least AS near_miss FROM (SELECT *, CASE WHEN source = 'src1' THEN 9.0 ELSE 8.0 END AS least FROM ({_SCORED}))"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = keywords.effective_min_score(F.when(F.col("source") == "src1", 9.0), F.lit(False), 8.0)
    judged = keywords.judge(scored(spark, sf_dir), RULES, min_score=least)
    stage = keywords.stage(X.word_count(F.col("text")), F.col("source") == "src3")
    return judged.select("doc_id", F.col("source").alias("domain_id"), F.col("lang").alias("scan_id"), stage.alias("stage"), "near_miss")


@query(f"SELECT * FROM ({_STAGED})")
def kw09_stages(spark, sf_dir):
    return staged(spark, sf_dir)


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{t.category}' AS category, '{t.lang}' AS lang, '{t.term}' AS term FROM documents WHERE {_hit(t)}" for t in TERMS) + ") SELECT category, lang, term, count(*) AS n_docs FROM m GROUP BY ROLLUP (category, lang, term)")
def kw10_statistics(spark, sf_dir):
    return keywords.keyword_stats(keywords.match_keywords(table(spark, sf_dir, "documents").select("doc_id", "text"), TERMS))


@query("SELECT doc_id, score, " + " || ".join(f"CASE WHEN k{i} = 1 THEN '{t.term};' ELSE '' END" for i, t in enumerate(TERMS)) + f" AS terms FROM (SELECT *, 5.0 AS least FROM ({_SCORED})) WHERE NOT {_PASS} AND score >= 0.6 * least")
def kw10_near_misses(spark, sf_dir):
    near = keywords.near_misses(keywords.judge(scored(spark, sf_dir), RULES), "doc_id")
    return near.select("doc_id", "score", F.array_join(F.transform("terms", lambda t: F.concat(t, F.lit(";"))), "").alias("terms"))


@query("""
SELECT doc_id, array_to_string(list_slice(list_filter(['seed', CASE WHEN contains(lower(text), 'thing') OR contains(lower(text), 'ofthe') THEN 'thing' END, CASE WHEN contains(lower(text), 'heat') OR contains(lower(text), 'leaux') THEN 'heat' END, CASE WHEN contains(lower(text), 'para') THEN 'para' END], lambda x: x IS NOT NULL), 1, 3), ',') AS tags FROM documents""")
def kw11_tags(spark, sf_dir):
    tags = [("thing", "what ofthe it"), ("heat", "Leaux, a b"), ("para", ""), ("seed", "zzzzzz")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keywords.infer_tags(F.col("text"), F.array(F.lit("seed")), tags, 3), ",").alias("tags"))


_N = lambda s: f"CAST(sum((stage = '{s}')::INT) AS BIGINT) AS n_{s}"


_OUTCOME = f"SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'error' WHEN stage = 'matched' AND doc_id % 7 = 0 THEN 'screened_out' WHEN stage = 'matched' AND doc_id % 7 = 1 THEN 'llm_skipped' ELSE stage END AS outcome FROM ({_STAGED})"


@query(f"SELECT scan_id, domain_id, count(*) AS crawled, {_N('short')}, {_N('excluded')}, {_N('keyword_dropped')}, CAST(sum((stage = 'keyword_dropped' AND near_miss)::INT) AS BIGINT) AS near_misses, CAST(sum((stage IN ('matched', 'screened_out', 'llm_skipped'))::INT) AS BIGINT) AS n_matched, {_N('screened_out')}, CAST(sum((stage = 'llm_skipped')::INT) AS BIGINT) AS llm_skipped, CAST(sum((stage = 'error')::INT) AS BIGINT) AS errors FROM (SELECT * REPLACE (outcome AS stage) FROM ({_OUTCOME})) GROUP BY scan_id, domain_id")
def sc06_scan_funnel(spark, sf_dir):
    screening = F.when(F.col("doc_id") % 7 == 0, "reject").when(F.col("doc_id") % 7 == 1, "skip")
    return scan_funnel(outcomes(staged(spark, sf_dir), F.col("doc_id") % 23 == 0, screening))
