"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, exact_dedup, hard_negatives, html_extract, license_scan, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, url_filter
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflict = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.read_back(chat_format.format_turns(turns))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size(F.array_distinct("matches.license")).cast("long").alias("n_licenses"), F.array_join(F.array_distinct("matches.license"), ",").alias("licenses"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    noisy = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(noisy, vec_id % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_best_fit_packing,
        op3_url_filters,
        op4_quality_classifier,
        op5_chat_formatting,
        op6_source_mixing,
        op7_license_scan,
        op8_exact_dedup,
        op9_quality_rules,
        op10_html_extraction,
        op11_substring_dedup,
        op12_conversation_repair,
        op13_hard_negatives,
    )
}

#: DuckDB's form of a normalised text.
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def _seats(parts: str, keys: str, seats: str, weight: str, most: str, tie: str) -> str:
    """All quotients of all parts, and each part's number among the highest: Sainte-Lague without the short cut."""
    over = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT p.*, coalesce(w.quota, 0) AS quota FROM {parts} p LEFT JOIN (
            SELECT {keys + ',' if keys else ''} {tie}, count(*) AS quota FROM (
                SELECT *, row_number() OVER ({over}ORDER BY {weight} / (2 * k - 1) DESC, {tie} ASC NULLS LAST) AS turn
                FROM (SELECT *, unnest(generate_series(1, CAST({most} AS BIGINT))) AS k FROM {parts})) WHERE turn <= {seats} GROUP BY ALL) w
        ON p.{tie} IS NOT DISTINCT FROM w.{tie} {''.join(f'AND p.{k.strip()} IS NOT DISTINCT FROM w.{k.strip()} ' for k in keys.split(',') if k)}"""


def _hash(*parts: str) -> str:
    return "('0x' || left(md5(concat_ws('/', 'mix-1', " + ", ".join(f"coalesce(CAST({p} AS STRING), 'null')" for p in parts) + ")), 15))::BIGINT"


_GROUP = "CASE WHEN source IS NULL THEN '{}' ELSE '{\"source\":\"' || source || '\"}' END"
_MIX = f"""
        WITH d AS (SELECT doc_id, source, {_GROUP} AS grp, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, grp, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source, grp),
        f AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wleft
              FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(rest / wleft, most / w) AS level FROM f WHERE most * wleft > w * rest),
        a AS (SELECT source, grp, source_size, CASE WHEN most * wleft <= w * rest THEN most ELSE least(most, w * level) END AS target, 2 * CAST(ceil(source_size / 16) AS BIGINT) AS cap FROM f LEFT JOIN l ON TRUE),
        a2 AS (SELECT *, CAST(round(sum(target) OVER () / 16) AS BIGINT) AS seats, greatest(1, CAST(ceil(source_size / 1048576) AS BIGINT)) AS shards FROM a),
        q AS ({_seats('a2', '', 'seats', 'target', 'cap', 'source')}),
        p AS (SELECT d.doc_id, d.size, q.grp, q.source_size, q.target, q.quota AS source_quota, {_hash("'shard'", 'd.doc_id')} % q.shards AS shard, {_hash('d.doc_id')} AS turn FROM d JOIN q ON d.grp = q.grp),
        u AS (SELECT *, sum(size) OVER (PARTITION BY grp, shard ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p),
        h AS (SELECT grp, shard, CAST(max(upto) AS BIGINT) AS words, any_value(source_quota) AS source_quota FROM u GROUP BY grp, shard),
        h2 AS (SELECT *, greatest(1, CAST(ceil(words / 16) AS BIGINT)) AS blocks, words::DOUBLE AS weight, CASE WHEN words > 0 THEN 2 * greatest(1, CAST(ceil(words / 16) AS BIGINT)) ELSE 0 END AS cap FROM h),
        g AS (SELECT *, {_hash("'start'", 'grp', 'shard')} % blocks AS start FROM ({_seats('h2', 'grp', 'source_quota', 'weight', 'cap', 'shard')})),
        e AS (SELECT u.*, unnest([CAST(upto AS BIGINT), CAST(upto - size AS BIGINT)]) AS pos, unnest([1, -1]) AS sign, quota, blocks, start FROM u JOIN g ON u.grp = g.grp AND u.shard = g.shard),
        t AS (SELECT *, pos * (quota // blocks) + least(greatest(pos - 16 * start, 0), 16 * least(quota % blocks, blocks - start)) + least(pos, 16 * greatest(start + quota % blocks - blocks, 0)) AS upto_pos FROM e)
        SELECT doc_id, size, source_size, target, CAST(sum(sign * upto_pos) AS BIGINT) AS taken FROM t GROUP BY doc_id, size, source_size, target, grp, shard, upto"""

ORACLES: dict[str, str] = {
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
        g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g""",
    "op5_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        -- a text is escaped only where the parser would take a part of it for a control string or an escape
        e AS (SELECT *, CASE WHEN contains(text, '</turn>' || chr(10)) OR regexp_matches(text, '\\[\\#<:]')
                             THEN replace(replace(replace(text, '</turn>', '\</turn>'), '###', '\###'), ': ', '\: ') ELSE text END AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || role || ': ' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
        u AS (SELECT page_id, url, replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS t FROM a)
        SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS n_chars FROM u""",
    "op6_source_mixing": _MIX,
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        n AS (SELECT doc_id, r, w, len(w) AS n FROM d),
        x AS (SELECT doc_id, r, s, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT *, unnest(generate_series(1, n - 12)) AS s FROM n)),
        g AS (SELECT *, min(doc_id) OVER (PARTITION BY win) < doc_id AS gone FROM x),
        c AS (SELECT n.r, p.i, bool_or(g.gone) OVER (PARTITION BY n.r ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone, n.w[p.i] AS word
              FROM n, LATERAL (SELECT unnest(generate_series(1, n.n)) AS i) p LEFT JOIN g ON g.r = n.r AND g.s = p.i),
        k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS DISTINCT FROM TRUE) AS kept FROM c GROUP BY r)
        SELECT doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN k ON n.r = k.r""",
    "op13_hard_negatives": """
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id NULLS LAST, other) AS place FROM s WHERE alike) WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY s.score DESC, s.other_id NULLS LAST, s.other) AS INT) AS rank
              FROM p JOIN s ON p.r = s.r AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS v FROM range(256) r(i)),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS key FROM conversations),
        h AS (SELECT k.* EXCLUDE key, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(v[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS f FROM k, bits),
        dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE f <> 0),
        num AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM dam),
        flt AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'd'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before FROM num),
        ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
                (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])) t(i, m, c, a, l)),
        op AS (SELECT * FROM (VALUES ('D', '', 0, 0), ('D', '', 1, 1), ('D', '', 2, 2), ('D', '', 3, 3), ('R', '', 0, 2), ('R', '', 1, 2), ('R', '', 3, 2), ('R', '', 2, 3),
               ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'u', 3, 2), ('K', 'a', 2, 3)) t(op, ini, m, j)),
        dp AS (SELECT DISTINCT c AS conv, 0 AS n, 0 AS st, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS b FROM flt
               UNION ALL
               SELECT d.conv, d.n + 1, op.j, min({'c': d.b.c + ins.c + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'a': d.b.a || ins.a || op,
                      'l': d.b.l || ins.l || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE op.j WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END})
               FROM dp d JOIN flt r ON r.c = d.conv AND r.n = d.n + 1 JOIN ins ON ins.i = d.st JOIN op ON op.m = ins.m AND (op.ini = '' OR op.ini = r.ini) AND (op = 'D' OR fault NOT IN ('b', 'd')) GROUP BY d.conv, d.n + 1, op.j),
        fin AS (SELECT conv, min({'c': b.c + ins.c, 'a': b.a || ins.a, 'l': b.l || ins.l}) AS b FROM dp JOIN (SELECT c, max(n) AS last FROM flt GROUP BY c) ON c = conv AND last = n JOIN ins ON ins.i = st AND ins.m IN (0, 3) GROUP BY conv),
        cnt AS (SELECT c, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY c, conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv = cnt.c""",
}
