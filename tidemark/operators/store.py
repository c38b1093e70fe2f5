"""The policy and lead stores as tables: inserts that keep the first, updates, searches and statistics."""

from __future__ import annotations

import unicodedata
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.bucketed import BucketedStore
from .changes import first_rows

REVIEW = ("new", "confirmed", "rejected", "needs_review")
TEXT_FIELDS = ("policy_name", "summary", "key_requirements", "jurisdiction")
UPCOMING, ENACTED = ("proposed", "consultation", "in_committee", "passed"), ("enacted", "amended")


def add_policies(store: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """ST-01: the rows of `batch` that are new: of each key the first by seq, none whose key is stored."""
    return first_rows(batch, list(keys), [F.col("seq")]).join(store.select(*keys).distinct(), list(keys), "left_anti")


def insert_policies(store: BucketedStore, batch: DataFrame) -> None:
    """ST-01: adds the rows of `batch` that are new to the store: of each url the first by seq, none that is stored."""
    store.insert_new(first_rows(batch, ["url"], [F.col("seq")]))


def update_review(store: DataFrame, updates: DataFrame) -> DataFrame:
    """ST-02: the store with review states of `updates` (url, review_status, seq), the last of each url."""
    last = first_rows(updates, ["url"], [F.col("seq").desc()]).select("url", F.col("review_status").alias("_new"))
    return store.join(last, "url", "left").withColumn("review_status", F.coalesce("_new", "review_status")).drop("_new")


def unknown_updates(store: DataFrame, updates: DataFrame) -> DataFrame:
    """ST-02: updates whose url isn't stored."""
    return updates.join(store.select("url").distinct(), "url", "left_anti")


def matching(jurisdiction: str | None = None, policy_type: str | None = None, scan_id: str | None = None, review_status: str | None = None, lifecycle_stage: str | None = None, min_score: int | None = None) -> Column:
    """ST-03: the filters of a search as one condition; a jurisdiction is a literal substring, whatever case."""
    out = F.lit(True)
    if jurisdiction:
        out = out & F.lower("jurisdiction").contains(jurisdiction.lower())
    for name, value in (("policy_type", policy_type), ("scan_id", scan_id), ("review_status", review_status), ("lifecycle_stage", lifecycle_stage)):
        if value:
            out = out & (F.col(name) == value)
    if min_score is not None:
        out = out & (F.coalesce("relevance_score", F.lit(0)) >= min_score)
    return out


def search(store: DataFrame, **filters: Any) -> DataFrame:
    """ST-03: in order of insertion."""
    return store.filter(matching(**filters)).orderBy("seq")


def _accented() -> tuple[str, str]:
    """Letters that are another one with marks, and that one: what canonical decomposition gives once marks are dropped."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2C00)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _BARE = _accented()


def tokens_of(text: Column) -> Column:
    """Lower-case words without accents, as the index splits them."""
    bare = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _BARE), r"\p{M}+", "")
    return F.array_remove(F.split(F.lower(bare), r"[^\p{L}\p{N}]+"), "")


def query_tokens(query: str) -> list[list[str]]:
    """Words of a query, folded like the texts; one that the index would split is a phrase."""
    bare = "".join(x for c in query for x in (unicodedata.normalize("NFD", c) if c in _ACCENTED else c) if unicodedata.category(x)[0] != "M")
    parts = ("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower()).split() for t in bare.split())
    return [p for p in parts if p]


WEIGHTS = (10.0, 1.0, 1.0, 1.0)


def bm25(tf: Column, df: Column, docs: Column, size: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))


def search_text(store: DataFrame, query: str, limit: int = 50, weights: tuple[float, ...] = WEIGHTS, **filters: Any) -> DataFrame:
    """ST-04: rows that hold every word of the query (the last one as a prefix), ranked by BM25 over the four weighted fields.

    The whole store is read; `search_index` gives the same from an index. Only counts of the query's words leave the scan. Document frequencies and the mean length are one
    aggregation of the whole store; they are one row.
    """
    limit, phrases = max(1, min(int(limit), 100)), query_tokens(query)
    if not phrases:
        return store.limit(0).withColumn("rank_score", F.lit(0.0))
    words = {f: tokens_of(F.col(f)) for f in TEXT_FIELDS}
    rows = store.select("*", *(words[f].alias(f"_w_{f}") for f in TEXT_FIELDS))

    def hits(field: str, i: int) -> Column:
        phrase, last = phrases[i], i == len(phrases) - 1

        def count(w: Column) -> Column:
            def here(x: Column, at: Column) -> Column:
                out = F.lit(True)
                for k, p in enumerate(phrase):
                    y = x if k == 0 else F.get(w, at + k)
                    out = out & F.coalesce(y.startswith(p) if last and k == len(phrase) - 1 else y == p, F.lit(False))
                return out

            return F.size(F.filter(w, here))

        w = F.col(f"_w_{field}")
        # most texts don't hold the phrase's first word at all
        return F.when(F.array_join(w, " ").contains(phrase[0]), let(w, count)).otherwise(0)

    counted = rows.select("*", *(hits(f, i).alias(f"_n{i}_{k}") for i in range(len(phrases)) for k, f in enumerate(TEXT_FIELDS)), sum((F.size(f"_w_{f}") for f in TEXT_FIELDS), F.lit(0)).alias("_len"))
    counted = counted.drop(*(f"_w_{f}" for f in TEXT_FIELDS))
    any_hit = lambda i: sum((F.col(f"_n{i}_{k}") for k in range(4)), F.lit(0)) > 0
    facts = counted.agg(F.count("*").alias("_docs"), F.avg("_len").alias("_mean"), *(F.count_if(any_hit(i)).alias(f"_df{i}") for i in range(len(phrases))))
    score, found = F.lit(0.0), matching(**filters)
    for i in range(len(phrases)):
        tf = sum((F.col(f"_n{i}_{k}") * w for k, w in enumerate(weights)), F.lit(0.0))
        score = score + bm25(tf, F.col(f"_df{i}"), F.col("_docs"), F.col("_len"), F.col("_mean"))
        found = found & any_hit(i)
    # one row of facts on the right: a broadcast of a few numbers, not a product of tables
    scored = counted.join(F.broadcast(facts)).filter(found).withColumn("rank_score", score)
    return scored.orderBy(F.col("rank_score").desc(), "seq").limit(limit).select(*store.columns, "rank_score")


def search_like(store: DataFrame, query: str, limit: int = 50, **filters: Any) -> DataFrame:
    """ST-05: every word is a substring of one of the four fields at least; in order of insertion."""
    found = matching(**filters)
    for token in query.split():
        one = F.lit(False)
        for f in TEXT_FIELDS:
            one = one | F.lower(F.coalesce(F.col(f), F.lit(""))).contains(token.lower())
        found = found & one
    return store.filter(found).orderBy("seq").limit(max(1, min(int(limit), 100)))


def score_band(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= 9, "9-10").when(s >= 7, "7-8").when(s >= 4, "4-6").otherwise("1-3")


def policy_stats(store: DataFrame) -> DataFrame:
    """ST-06: (kind, value, n): total, flagged, by jurisdiction, by type and by score band, in one pass."""
    place = F.when(F.coalesce("jurisdiction", F.lit("")) == "", "Unknown").otherwise(F.col("jurisdiction"))
    flagged = F.size(F.coalesce("verification_flags", F.array().cast("array<string>"))) > 0 if "verification_flags" in store.columns else F.lit(False)
    facts = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("jurisdiction").alias("kind"), place.alias("value")),
        F.struct(F.lit("policy_type").alias("kind"), F.coalesce("policy_type", F.lit("unknown")).alias("value")),
        F.struct(F.lit("score").alias("kind"), score_band(F.col("relevance_score")).alias("value")),
        F.when(flagged, F.struct(F.lit("flagged").alias("kind"), F.lit("").alias("value"))),
    )
    counted = store.select(F.inline(F.array_compact(facts))).groupBy("kind", "value").agg(F.count("*").alias("n"))
    always = store.sparkSession.createDataFrame([("score", b) for b in ("1-3", "4-6", "7-8", "9-10")] + [("total", ""), ("flagged", "")], "kind string, value string")
    return counted.unionByName(always.withColumn("n", F.lit(0).cast("long"))).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def merge_policies(stored: DataFrame, live: DataFrame) -> DataFrame:
    """ST-07: stored and in-flight policies, one per url; the stored one wins, then the first."""
    both = stored.withColumn("_origin", F.lit(0)).unionByName(live.withColumn("_origin", F.lit(1)))
    return first_rows(both, ["url"], [F.col("_origin"), F.col("seq")]).drop("_origin")


def lead_key(source_url: Column, snippet: Column) -> Column:
    """ST-08: the URL, or a hash of the note."""
    url = F.coalesce(source_url, F.lit(""))
    return F.when(url != "", url).otherwise(F.concat(F.lit("note:"), F.sha2(F.coalesce(snippet, F.lit("")), 256)))


def add_leads(store: DataFrame, batch: DataFrame) -> DataFrame:
    """ST-08: leads of `batch` that are new; of like ones the first."""
    keyed = lambda df: df.withColumn("dedupe_key", lead_key(F.col("source_url"), F.col("snippet")))
    return first_rows(keyed(batch), ["dedupe_key"], [F.col("seq")]).join(keyed(store).select("dedupe_key"), "dedupe_key", "left_anti")


def list_leads(leads: DataFrame, status: str | None = None) -> DataFrame:
    """ST-09: newest first."""
    return (leads.filter(F.col("status") == status) if status else leads).orderBy(F.col("found_at").desc(), "lead_id")


def apply_chases(leads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """ST-10: the leads after their last chase (lead_id, seq, outcome, policy_url, error, at); a failed fetch keeps the status."""
    last = first_rows(outcomes, ["lead_id"], [F.col("seq").desc()]).select("lead_id", *(F.col(c).alias(f"_{c}") for c in ("outcome", "policy_url", "error", "at")))
    done = F.col("_outcome").isin("policy_found", "no_policy")
    out = leads.join(last, "lead_id", "left").withColumn("status", F.when(done, "chased").otherwise(F.col("status")))
    out = out.withColumn("policy_url", F.coalesce(F.nullif(F.col("_policy_url"), F.lit("")), "policy_url"))
    seen = F.col("_outcome").isNotNull()
    for new, old in (("_outcome", "chase_outcome"), ("_error", "chase_error"), ("_at", "chased_at")):
        out = out.withColumn(old, F.when(seen, F.col(new)).otherwise(F.col(old)))
    return out.drop("_outcome", "_policy_url", "_error", "_at")


def policy_view(df: DataFrame, mode: str = "all", tags: list[str] | None = None, places: list[str] | None = None, sort: str = "relevance") -> DataFrame:
    """ST-11: upcoming or enacted stages, all of `tags`, one of `places`; by relevance, name, jurisdiction or newest."""
    if mode != "all":
        df = df.filter(F.col("lifecycle_stage").isin(*(UPCOMING if mode == "upcoming" else ENACTED)))
    if tags:
        df = df.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if places:
        df = df.filter(F.col("jurisdiction").isin(*places))
    order = {"relevance": [F.coalesce("relevance_score", F.lit(0)).desc()], "name": [F.col("policy_name")], "jurisdiction": [F.col("jurisdiction")], "newest": [F.col("discovered_at").desc()]}[sort]
    return df.orderBy(*order, "seq")
