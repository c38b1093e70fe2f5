"""ST-04: ranked search over an inverted index.

The index is a folder of three tables, each with a folder per batch (numbered upwards by the caller):

- postings (token, seq, field, position, words): one row per word, dealt by the token's first letter to `PARTS` folders and
  sorted by token, so that a query reads the folders and row groups of its own words;
- sizes (seq, words) of the indexed rows, and facts: the batch's rows and words, negative for rows that went;
- gone (seq): rows that a batch takes out of all batches before it.

A changed row is taken out and added again by one batch. A batch that is written again replaces itself.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import TEXT_FIELDS, WEIGHTS, bm25, matching, query_tokens, tokens_of

PARTS = 64
#: Rows that a task is given: up to MANY tasks of ROWS, as from there on Spark's shuffle writer holds in memory what a task sends; then larger ones, up to MOST_ROWS.
ROWS, MOST_ROWS, MANY = 500_000, 4_000_000, 200


def tasks(rows: int) -> int:
    """How many tasks deal with so many rows: whatever the session's number of partitions, which may stay while the tables grow."""
    return max(1, min(-(-rows // ROWS), MANY), -(-rows // MOST_ROWS))


def part_of(first: str) -> int:
    return ord(first) % PARTS


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the index; empty where no batch has written any."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def postings(rows: DataFrame) -> DataFrame:
    """Every word of the four fields of `rows`: token, seq, field, position in it, and the row's number of words."""
    words = [tokens_of(F.col(f)) for f in TEXT_FIELDS]
    split = rows.select("seq", *(w.alias(f"w{k}") for k, w in enumerate(words)))
    split = split.withColumn("words", sum((F.size(f"w{k}") for k in range(len(words))), F.lit(0)))

    def placed(k: int) -> Column:
        return F.transform(f"w{k}", lambda t, i: F.struct(t.alias("token"), F.lit(k).alias("field"), i.alias("position")))

    each = [placed(k) for k in range(len(words))]
    return split.select("seq", "words", F.inline(F.concat(*each))).select("token", "seq", "field", "position", "words", F.pmod(F.ascii("token"), F.lit(PARTS)).alias("part"))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.select("seq", sum((F.size(tokens_of(F.col(f))) for f in TEXT_FIELDS), F.lit(0)).alias("words"))


def add_batch(rows: DataFrame | None, path: str, batch: int, gone: DataFrame | None = None) -> None:
    """Writes one batch: new rows (seq and the four fields), and rows (seq) of earlier batches that go. Only the batch's own rows are read and written,
    and of the sizes those of rows that go."""
    spark = (rows if rows is not None else gone).sparkSession
    facts = []
    if gone is not None:
        gone.select(F.col("seq").cast("long").alias("seq")).distinct().write.mode("overwrite").parquet(f"{path}/gone/batch={batch}")
        out = spark.read.parquet(f"{path}/gone/batch={batch}")
        held = _stored(spark, f"{path}/sizes", "seq long, words int, batch int").filter(F.col("batch") < batch)
        n = tasks(held.count() + _gone(spark, path).count())
        old = live(held, spark, path, before=batch, n=n).join(out.repartition(n, "seq"), "seq", "left_semi")
        facts.append(old.agg((-F.count("*")).alias("rows"), (-F.coalesce(F.sum("words"), F.lit(0))).alias("words")))
    if rows is not None:
        sizes(rows).write.mode("overwrite").parquet(f"{path}/sizes/batch={batch}")
        new = spark.read.parquet(f"{path}/sizes/batch={batch}").agg(F.count("*").alias("rows"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        dealt = postings(rows).repartitionByRange(tasks(new.first()["words"]), "part", "token", "seq")
        dealt.sortWithinPartitions("part", "token", "seq").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/batch={batch}")
        facts.append(new)
    total = facts[0] if len(facts) == 1 else facts[0].union(facts[1])
    total.agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).write.mode("overwrite").parquet(f"{path}/facts/batch={batch}")


def _gone(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    gone = _stored(spark, f"{path}/gone", "seq long, batch int")
    return gone if before is None else gone.filter(F.col("batch") < before)


def live(rows: DataFrame, spark: SparkSession, path: str, before: int | None = None, n: int | None = None) -> DataFrame:
    """Rows (seq, batch) of the index that no later batch took out, dealt by seq to `n` tasks, else to as many as their number asks for."""
    gone = _gone(spark, path, before)
    n = n or tasks(rows.count() + gone.count())
    rows, gone = rows.repartition(n, "seq"), gone.repartition(n, "seq")  # both alike, so the join deals neither anew
    last = gone.groupBy("seq").agg(F.max("batch").alias("_gone")).withColumnRenamed("seq", "_seq")
    return rows.join(last, (F.col("seq") == F.col("_seq")) & (F.col("batch") < F.col("_gone")), "left_anti")


def phrase_counts(spark: SparkSession, path: str, phrases: list[list[str]], weights: tuple[float, ...]) -> DataFrame:
    """(seq, words, t0, t1, ...): weighted number of places of each phrase in each row that holds one at least."""
    wanted: list[tuple[Column, Column]] = []
    for i, phrase in enumerate(phrases):
        for k, word in enumerate(phrase):
            ends = i == len(phrases) - 1 and k == len(phrase) - 1
            token = F.col("token").startswith(word) if ends else F.col("token") == word
            wanted.append(((F.col("part") == part_of(word[0])) & token, F.struct(F.lit(i).alias("phrase"), F.lit(k).alias("nth"))))
    here = F.lit(False)
    for test, _ in wanted:
        here = here | test
    stored = _stored(spark, f"{path}/postings", "token string, seq long, field int, position int, words int, batch int, part int")
    read = stored.filter(F.col("part").isin(sorted({part_of(w[0]) for p in phrases for w in p})) & here)
    hits = live(read, spark, path).select("seq", "words", "field", "position", F.inline(F.array_compact(F.array(*(F.when(test, at) for test, at in wanted)))))
    if any(len(p) > 1 for p in phrases):  # a phrase stands where all its words stand in a row
        size = F.element_at(F.array(*(F.lit(len(p)) for p in phrases)), F.col("phrase") + 1)
        hits = hits.groupBy("seq", "words", "field", "phrase", (F.col("position") - F.col("nth")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == size)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("field") + 1)
    return hits.groupBy("seq", "words").agg(*(F.sum(F.when(F.col("phrase") == i, weight)).alias(f"t{i}") for i in range(len(phrases))))


def search_index(store: DataFrame, path: str, query: str, limit: int = 50, weights: tuple[float, ...] = WEIGHTS, **filters: Any) -> DataFrame:
    """ST-04: what `search_text` gives for the indexed rows of `store`, read from the index: only the query's words' folders are read, and of the store the rows found."""
    spark = store.sparkSession
    limit, phrases = max(1, min(int(limit), 100)), query_tokens(query)
    if not phrases:
        return store.limit(0).withColumn("rank_score", F.lit(0.0))
    counts = phrase_counts(spark, path, phrases, weights)
    df = counts.agg(*(F.count(f"t{i}").alias(f"df{i}") for i in range(len(phrases))))
    facts = _stored(spark, f"{path}/facts", "rows long, words long, batch int").agg(F.sum("rows").alias("rows"), F.sum("words").alias("all_words"))
    scored = counts.dropna(subset=[f"t{i}" for i in range(len(phrases))])
    # two one-row tables of sums
    scored = scored.join(F.broadcast(facts)).join(F.broadcast(df))
    score = sum((bm25(F.col(f"t{i}"), F.col(f"df{i}"), F.col("rows"), F.col("words"), F.col("all_words") / F.col("rows")) for i in range(len(phrases))), F.lit(0.0))
    ranked = scored.select("seq", score.alias("rank_score"))
    if filters:
        ranked = ranked.join(store.filter(matching(**filters)), "seq")
    top = ranked.orderBy(F.col("rank_score").desc(), "seq").limit(limit)
    top = top if filters else top.join(store, "seq")
    return top.select(*store.columns, "rank_score").orderBy(F.col("rank_score").desc(), "seq")
