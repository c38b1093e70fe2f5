"""Streaming queries, run over what a table holds, and measure pages; each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_dir
from ..operators import signals
from ..operators.records import parse_measures
from ..sources.bucketed import BucketedStore
from ..streaming import streams
from .inputs import table
from .policy import PER_MINUTE, SG09_SQL, limited_requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def collected(stream: DataFrame, mode: str, to: str | None = None, at: str | None = None) -> DataFrame:
    """What a stream emits, with the number of its batch, written to the shared folder."""
    to = to or f"{shared_dir(stream.sparkSession)}/emitted-{uuid.uuid4().hex}"
    streams.drain(stream, mode, lambda batch, number: batch.write.mode("overwrite").parquet(f"{to}/batch={number}"), at)
    return stream.sparkSession.read.parquet(to)


def in_parts(df: DataFrame, part: str, n: int, run: Callable[[DataFrame], None]) -> None:
    """Rows of `df` come as a stream in `n` batches, by the number that `part` gives: each is written, and `run` goes on with what is new."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/arrived-{uuid.uuid4().hex}"
    numbered = df.withColumn("_part", F.expr(part))
    for k in range(n):
        numbered.filter(F.col("_part") == k).drop("_part").write.parquet(f"{at}/arrival-{k}")
        run(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(at))


@query("SELECT strftime(ts, '%d') AS scan_id, 'd' || CAST(user_id % 12 AS STRING) AS domain_id, count(*) AS events, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {n}" for n, t in signals.COUNTERS.items()) + " FROM events GROUP BY 1, 2")
def sg07_progress_stream(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS type", "date_format(ts, 'dd') AS scan_id", "'d' || (user_id % 12) AS domain_id")
    emitted = collected(streams.stream_progress(events), "update")
    return emitted.groupBy("scan_id", "domain_id").agg(*(F.max_by(c, "batch").alias(c) for c in ("events", *signals.COUNTERS)))


@query("SELECT record_id, seq, change_hash FROM (SELECT 'r' || CAST(user_id AS STRING) AS record_id, event_id AS seq, event_type AS change_hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> change_hash")
def cd08_changed_stream(spark, sf_dir):
    records = stream_of(spark, sf_dir, "events").selectExpr("'r' || user_id AS record_id", "event_id AS seq", "event_type AS change_hash")
    return collected(streams.stream_changed(records), "append").select("record_id", "seq", "change_hash")


#: Events arrive in four batches by their number, so that most of the last three are late by the clock of the first.
_ARRIVALS = 4


@query(f"""
WITH e AS (SELECT *, event_id % {_ARRIVALS} AS part, strftime(ts, '%d') AS scan_id, 'd' || CAST(user_id % 12 AS STRING) AS domain_id FROM events),
m AS (SELECT a.part, max(b.ts) - INTERVAL 10 DAY AS mark FROM (SELECT DISTINCT part FROM e) a JOIN e b ON b.part < a.part GROUP BY a.part),
l AS (SELECT e.*, coalesce(ts < mark, FALSE) AS late FROM e LEFT JOIN m ON e.part = m.part)
SELECT scan_id, domain_id, count(*) FILTER (NOT late) AS events, """ + ", ".join(f"count(*) FILTER (NOT late AND event_type = '{t}') AS {n}" for n, t in signals.COUNTERS.items()) + """, count(*) FILTER (late) AS late FROM l GROUP BY 1, 2""")
def sg07_progress_late(spark, sf_dir):
    """Events in time and late ones, together all."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS type", "date_format(ts, 'dd') AS scan_id", "'d' || (user_id % 12) AS domain_id")
    to = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    in_parts(events, f"event_id % {_ARRIVALS}", _ARRIVALS, lambda s: streams.stream_progress_late(s, to, "10 days", f"{to}-at"))
    return streams.progress_late(spark, to)


_KEEP = 4


@query(f"""
WITH e AS (SELECT 'r' || CAST(user_id % 40 AS STRING) AS record_id, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'same' ELSE event_type END AS change_hash, ts, CAST(floor((day(ts) - 1) / 10) AS INT) AS part FROM events WHERE user_id % 40 < 25 OR day(ts) NOT BETWEEN 8 AND 23),
m AS (SELECT a.part, max(b.ts) AS mark FROM (SELECT DISTINCT part FROM e) a JOIN e b ON b.part < a.part GROUP BY a.part),
l AS (SELECT *, lag(change_hash) OVER w AS before, lag(part) OVER w AS part_before, max(ts) OVER (PARTITION BY record_id, part) AS latest FROM e WINDOW w AS (PARTITION BY record_id ORDER BY part, seq)),
p AS (SELECT l.*, (SELECT max(x.ts) FROM e x WHERE x.record_id = l.record_id AND x.part < l.part) AS seen FROM l WHERE part_before IS DISTINCT FROM part)
SELECT record_id, seq, change_hash FROM l WHERE before IS NULL OR before <> change_hash
UNION SELECT record_id, seq, change_hash FROM p JOIN m ON p.part = m.part WHERE seen IS NOT NULL AND date_trunc('milliseconds', seen) + INTERVAL {_KEEP} DAY <= date_trunc('milliseconds', mark)""")
def cd08_forgotten_stream(spark, sf_dir):
    """Records that were idle for days are forgotten: they come again as new, changed or not."""
    rows = table(spark, sf_dir, "events").filter("user_id % 40 < 25 OR day(ts) NOT BETWEEN 8 AND 23")
    records = rows.selectExpr("'r' || (user_id % 40) AS record_id", "event_id AS seq", "IF(user_id % 2 = 0, 'same', event_type) AS change_hash", "CAST(ts AS TIMESTAMP) AS ts")
    to = f"{shared_dir(spark)}/changed-{uuid.uuid4().hex}"
    in_parts(records, "CAST(floor((day(ts) - 1) / 10) AS INT)", 3, lambda s: collected(streams.stream_changed(s, f"{_KEEP} days"), "append", to, f"{to}-at"))
    return spark.read.parquet(to).select("record_id", "seq", "change_hash")


@query(SG09_SQL)
def sg09_rate_limit_stream(spark, sf_dir):
    requests = limited_requests(stream_of(spark, sf_dir, "events"))
    return collected(streams.stream_rate_limit(requests, PER_MINUTE), "append").select("key", "request_id", "wait_s")


@query("""SELECT min(o_orderkey) AS seq, 'https://x/' || CAST(o_custkey AS STRING) AS url FROM orders GROUP BY 2
UNION ALL SELECT min(s_suppkey), 'https://s/' || CAST(s_suppkey % 50 AS STRING) FROM supplier GROUP BY 2""")
def io11_stream_store(spark, sf_dir):
    """Two runs over one store: what the first stored stays, and what comes again isn't stored again."""
    store = BucketedStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "seq BIGINT, url STRING")
    streams.stream_store(stream_of(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "'https://x/' || o_custkey AS url"), store)
    streams.stream_store(stream_of(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS seq", "'https://s/' || (s_suppkey % 50) AS url"), store)
    streams.stream_store(stream_of(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "'https://x/' || o_custkey AS url"), store)
    return store.read()


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages)
SELECT page_id, 'Land ' || CAST(page_id % 7 AS STRING) AS country, replace(replace(replace(title, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS title, 'https://e.eu' || replace(replace(href, '&quot;', '"'), '&amp;', '&') AS link FROM l WHERE title <> ''""")
def sr11_measures(spark, sf_dir):
    html = F.concat(F.lit("<li><a href=x>above any heading</a></li><h2> Land "), (F.col("page_id") % 7).cast("string"), F.lit("</h2><ul>"), F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1), F.lit("</ul>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("https://e.eu/d/x").alias("url"), html.alias("html"))
    return parse_measures(pages).select("page_id", "country", "title", "link")
