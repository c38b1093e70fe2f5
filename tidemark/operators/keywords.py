"""Keyword matching, scoring and gates over pages or documents.

The dictionary is a small configured dimension (rows of category, weight, lang, term); it
travels with the tasks, never joined row by row with the pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import ahocorasick
except ImportError:  # a combined pattern finds the same terms
    ahocorasick = None

# Languages whose terms match inside words.
COMPOUND_LANGS = {"de", "nl", "sv", "da", "no", "fi", "is", "hu", "ja", "ko", "ar"}
MATCH_TYPE = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("category", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("lang", T.StringType())]))


class Term(NamedTuple):
    category: str
    weight: float
    lang: str
    term: str


class Rules(NamedTuple):
    """What scoring needs besides the terms."""

    boost: tuple[str, ...] = ()
    penalty: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    boost_amount: float = 3.0
    penalty_amount: float = 2.0
    min_score: float = 5.0
    min_matches: int = 2
    near: float = 0.6


def bounded(term: str) -> str:
    """A term as a whole word, whatever case, by Unicode's letters."""
    return rf"(?iU)\b\Q{term}\E\b"


def _words_edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at `at`."""
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return inside(at - 1) != inside(at)


def finder(terms: list[Term]):
    """A function from a text to the numbers of the terms that occur in it."""
    by_text: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        by_text.setdefault(t.term.lower(), []).append(i)
    words = [w for w in by_text if w]
    if ahocorasick is not None:
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()

        def hits(low: str) -> Iterator[tuple[int, str]]:
            for end, w in machine.iter(low):
                yield end + 1 - len(w), w
    else:
        pattern = re.compile("(?=(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + "))")
        longer = {w: [v for v in words if w.startswith(v)] for w in words}

        def hits(low: str) -> Iterator[tuple[int, str]]:
            for m in pattern.finditer(low):
                for w in longer[m[1]]:
                    yield m.start(), w

    def find(text: str) -> list[int]:
        low, found = text.lower(), set()
        for at, w in hits(low) if words else ():
            whole = None
            for i in by_text[w]:
                if i in found:
                    continue
                if terms[i].lang in COMPOUND_LANGS:
                    found.add(i)
                else:
                    whole = _words_edge(low, at) and _words_edge(low, at + len(w)) if whole is None else whole
                    if whole:
                        found.add(i)
        return sorted(found)

    return find


def match_keywords(docs: DataFrame, terms: list[Term], text: str = "text") -> DataFrame:
    """KW-02: adds `matches`, at most one per (category, lang, term), in dictionary order; [] for null texts."""
    kept = list(dict.fromkeys(terms))
    kind = pa.list_(pa.struct([("term", pa.string()), ("category", pa.string()), ("weight", pa.float64()), ("lang", pa.string())]))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(kept)
        for b in batches:
            found = [[{"term": kept[i].term, "category": kept[i].category, "weight": kept[i].weight, "lang": kept[i].lang} for i in find(t or "")] for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "matches"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", MATCH_TYPE)]))


def match_terms(text: Column, terms: list[Term]) -> Column:
    """KW-02 by built-in functions alone, for a short dictionary."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda t: low.contains(t.term.lower()) if t.lang in COMPOUND_LANGS else F.coalesce(text, F.lit("")).rlike(bounded(t.term))
    one = lambda t: F.struct(F.lit(t.term).alias("term"), F.lit(t.category).alias("category"), F.lit(float(t.weight)).alias("weight"), F.lit(t.lang).alias("lang"))
    return F.array_compact(F.array(*(F.when(hit(t), one(t)) for t in dict.fromkeys(terms))))


def is_excluded(text: Column, rules: Rules) -> Column:
    """KW-01."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for phrase in rules.exclusions:
        out = out | low.contains(phrase.lower())
    return out


def score_keywords(df: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """KW-01, KW-03, KW-04: adds excluded, score, n_matches and categories; an exclusion leaves no matches and score 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda words: sum((body.rlike(bounded(w)).cast("int") for w in words), F.lit(0))
    weight = F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["weight"])
    total = F.greatest(F.lit(0.0), weight + rules.boost_amount * count(rules.boost) - rules.penalty_amount * count(rules.penalty))
    out = df.withColumn("excluded", is_excluded(F.col(text), rules))
    out = out.withColumn("matches", F.when(F.col("excluded"), F.array().cast(MATCH_TYPE)).otherwise(F.col("matches")))
    return out.withColumn("score", F.when(F.col("excluded"), 0.0).otherwise(total)).withColumn("n_matches", F.size("matches")).withColumn("categories", F.array_sort(F.array_distinct(F.col("matches.category"))))


def judge(df: DataFrame, rules: Rules, bonus: Column | None = None, min_score: Column | None = None) -> DataFrame:
    """KW-06, KW-07: adds url_bonus, passes and near_miss to scored rows."""
    least = F.lit(rules.min_score) if min_score is None else min_score
    has = lambda c: F.exists("matches", lambda m: m["category"] == c)
    paired = F.lit(not rules.pairs)
    for a, b in rules.pairs:
        paired = paired | (has(a) & has(b))
    out = df.withColumn("url_bonus", F.lit(0.0) if bonus is None else bonus)
    full = F.col("score") + F.col("url_bonus")
    out = out.withColumn("passes", ~F.col("excluded") & (full >= least) & (F.col("n_matches") >= rules.min_matches) & paired)
    return out.withColumn("near_miss", ~F.col("passes") & (full >= rules.near * least))


def effective_min_score(override: Column, deep: Column, settings: float = 3.0) -> Column:
    """KW-08: the domain's own threshold, else 2.0 for deep scans, else the settings' value."""
    return F.coalesce(override, F.when(deep, F.lit(2.0)), F.lit(settings))


def stage(n_words: Column, structured: Column, least: int = 50) -> Column:
    """KW-09: short, excluded, keyword_dropped or matched; structured records skip the short and score gates."""
    return F.when(~structured & (n_words < least), "short").when(F.col("excluded"), "excluded").when(~structured & ~F.col("passes"), "keyword_dropped").otherwise("matched")


def keyword_stats(df: DataFrame) -> DataFrame:
    """KW-10: documents per (category, lang, term), with totals per (category, lang), category and all."""
    long = df.select(F.explode("matches").alias("m")).select("m.category", "m.lang", "m.term")
    return long.rollup("category", "lang", "term").agg(F.count("*").alias("n_docs"))


def near_misses(judged: DataFrame, *keys: str) -> DataFrame:
    """KW-10: the near misses among judged rows, with their scores and the terms behind them: what to look at when tuning."""
    return judged.filter("near_miss").select(*keys, "score", "url_bonus", F.col("matches.term").alias("terms"))


def infer_tags(text: Column, explicit: Column, tags: list[tuple[str, str]], most: int = 8) -> Column:
    """KW-11: the explicit tags, then those whose name, or a word of five letters or more of whose description, is in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for name, description in tags:
        words = [w for w in re.split(r"[^a-z0-9]+", description.lower()) if len(w) >= 5]
        hit = low.contains(name.lower())
        for w in words:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.lit(name)))
    all_tags = F.concat(F.coalesce(explicit, F.array().cast("array<string>")), F.array_compact(F.array(*found)))
    return F.slice(F.array_distinct(all_tags), 1, most)
