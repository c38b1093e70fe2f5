"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: `SHARE` of all words go to the sources by weight; a target stops at `CAP` times
   its source's size and the excess goes to the others, until none is above.
2. Sources are dealt into shards by a hash of the document; a large source has more.
3. The blocks of BLOCK words that the targets make are allocated one by one to the source
   with the highest quotient target / (2 * blocks so far + 1), then within each source to its
   shards by their sizes, so each shard has a whole number of blocks, its quota.
4. A shard's documents, in a seeded order, make a stream of equal blocks, all taken equally often
   but for the blocks of one run from a seeded block on (past the stream's end it goes on at its
   start), which are taken once more. As the order is seeded, so is what the run holds; whole
   documents lie in it or out of it, and at most the two at its ends are cut.

Quotients near the last seat alone are ranked (see `apportion`), so rows don't grow with blocks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import SPACE, WORD, durable, join_spread, only, packed, row_key, with_presence

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Words of a block, and words of a source for each of its shards.
BLOCK, SHARD_WORDS = 16, 1 << 20


def _number(*parts: Column) -> Column:
    """A 60-bit number from an MD5 of the parts, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    Filling up: in the order of cap / weight, a source stops at its cap if the level, what is left over
    the weights that are left, is at least that. All windows are over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", (cap * F.col("source_size")).cast("double"))
    everything = W.partitionBy()
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(fill), F.lit(0.0))).withColumn("over", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    rows = rows.withColumn("full", F.col("most") * F.col("over") <= F.col("weight") * F.col("left"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), (F.col("left") / F.col("over")).alias("at")))).over(everything)["at"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * level))).select("source", "source_size", "target")


def apportion(parts: DataFrame, keys: list[str], seats: str, weight: str, most: str, tie: list[str]) -> DataFrame:
    """Adds `quota` to each part: Sainte-Lague shares of its group's seats (column `seats`, the same
    in a group of `keys`), `most` at the most.

    With S parts and N seats the last seat's divisor lies within a factor 1 -+ e of weight / seats,
    e = (S + 1) / (2N - 1), as rounding moves each part by half a seat at most. So a part has between
    x(1 - e) - 1 and x(1 + e) + 1 seats for its exact share x, and only those few are ranked.
    """
    group = W.partitionBy(*keys)
    x = F.col(weight) * F.col(seats) / F.greatest(F.sum(weight).over(group), F.lit(1e-9))
    e = (F.count("*").over(group) + 1) / F.greatest(2 * F.col(seats) - 1, F.lit(1))
    rows = parts.withColumn("_x", x).withColumn("_e", e)
    low = F.least(F.greatest(F.floor(F.col("_x") * (1 - F.col("_e")) - 1), F.lit(0)), F.col(most))
    high = F.least(F.greatest(F.ceil(F.col("_x") * (1 + F.col("_e")) + 1), F.lit(0)), F.col(most))
    rows = rows.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    rows = rows.withColumn("_free", F.col(seats) - F.sum("_low").over(group))
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranked = rows.withColumn("_seat", seat).withColumn("_quotient", F.col(weight) / (2 * F.col("_seat") - 1))
    turn = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie)))
    won = ranked.withColumn("_won", (F.col("_seat").isNotNull() & (turn <= F.col("_free"))).cast("long"))
    return won.groupBy(*parts.columns, "_low").agg(F.sum("_won").alias("_more")).withColumn("quota", F.col("_low") + F.col("_more")).select(*parts.columns, "quota")


def placed_rows(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int, block: int, shard_words: int) -> DataFrame:
    """The columns of `mix`, the source's `group`, the `first` word's place in the shard's stream and what its blocks are dealt by."""
    rows = only(docs, "doc_id", "text", "source")
    size = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), "")).cast("long")
    sized = durable(rows.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), size.alias("size")).withColumn("group", F.to_json(F.struct("source"))))
    per_source = durable(sized.groupBy("group", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    aims = targets(per_source.select("source", "source_size"), weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block)
    aims = aims.withColumn("most", cap * blocks)
    aims = aims.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("all", F.lit(1))
    quotas = apportion(aims, ["all"], "seats", "target", "most", ["source"]).select("source", "target", F.col("quota").alias("source_quota"))
    known = durable(per_source.join(quotas, per_source["source"].eqNullSafe(quotas["source"])).select("group", "n", "source_size", "target", "source_quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards")))
    placed = join_spread(sized, known, "group", "n").withColumn("turn", _number(F.col("doc_id"))).withColumn("shard", F.pmod(_number(F.lit("shard"), F.col("doc_id")), F.col("shards")))

    in_shard = W.partitionBy("group", "shard").orderBy("turn", "doc_id", "row_key", "size").rowsBetween(W.unboundedPreceding, 0)
    streamed = durable(placed.withColumn("upto", F.sum("size").over(in_shard)))
    shards = streamed.groupBy("group", "shard").agg(F.max("upto").alias("words"), F.count("*").alias("n"), F.first("source_quota").alias("source_quota"))
    shards = shards.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long")).withColumn("weight", F.col("words").cast("double"))
    shards = shards.withColumn("most", F.when(F.col("words") > 0, cap * F.col("blocks")).otherwise(F.lit(0)))
    shares = apportion(shards.drop("n"), ["group"], "source_quota", "weight", "most", ["shard"])
    start = F.pmod(_number(F.lit("start"), F.col("group"), F.col("shard")), F.col("blocks"))
    keyed = shares.join(shards.select("group", "shard", "n"), ["group", "shard"]).select(F.to_json(F.struct("group", "shard")).alias("key"), "n", "words", "blocks", "quota", start.alias("begin"))
    full = join_spread(streamed.withColumn("key", F.to_json(F.struct("group", "shard"))), keyed, "key", "n")

    each, more = F.expr("quota div blocks"), F.expr("quota % blocks")
    full = full.withColumn("each", each).withColumn("run_from", F.col("begin") * block)
    full = full.withColumn("run_to", F.least(F.col("begin") + more, F.col("blocks")) * block).withColumn("wrap_to", F.greatest(F.col("begin") + more - F.col("blocks"), F.lit(0)) * block)
    first = F.col("upto") - F.col("size")
    extra = sum(F.greatest(b - a, F.lit(0)) for a, b in in_run(first, F.col("size"), "run_from", "run_to", "wrap_to"))
    taken = F.col("each") * F.col("size") + extra
    return full.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row_key", "group", first.alias("first"), "each", "run_from", "run_to", "wrap_to")


def in_run(first: Column, size: Column, run_from: str, run_to: str, wrap_to: str) -> list[tuple[Column, Column]]:
    """Two stretches, from one word up to another, of a text of `size` words that starts at word `first` of its shard: those in the shard's run.

    The run is the shard's words from `run_from` to `run_to` and those up to `wrap_to`; a stretch without words ends where it starts or before.
    """
    inside = lambda at: F.least(F.greatest(at - first, F.lit(0)), size)
    return [(F.lit(0).cast("long"), inside(F.col(wrap_to))), (inside(F.col(run_from)), inside(F.col(run_to)))]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and row_key of every row of `docs`.

    Null and empty texts have size 0 and give nothing. A null source is a source, the last. Repeated
    rows each get their row, one after the other in their shard. An empty table gives no rows; further
    columns are ignored.
    """
    return placed_rows(docs, weights, share, cap, block, shard_words).select("doc_id", "size", "source_size", "target", "taken", "row_key")


def stretches(text: str, *ends: int) -> str:
    """The words of `text` from one word up to another, for each pair of `ends` (in ascending order), as they stand there; a line feed between two stretches."""
    words, at, out = re.finditer(WORD, text), 0, []
    for i, j in zip(ends[::2], ends[1::2]):
        start = end = None
        while at < j and (word := next(words, None)) is not None:
            if at == i:
                start = word.start()
            at, end = at + 1, word.end()
        if start is not None:
            out.append(text[start:end])
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def cut_words(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([stretches(*x) if x[0] else "" for x in zip(texts, a, b, c, d)], dtype="object")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: `docs` with their columns, each word as often as its block is taken.

    A shard's texts are taken k times whole, and once more those in its run; a text that the run holds in part (at most
    two in a shard) has its words in the run once more. n_chars, where the table has it, follows the text.
    Null and empty texts give nothing. Rows that repeat an id, text and source are dealt one after the other; an empty table gives none.
    """
    placed = placed_rows(docs, WEIGHTS, SHARE, CAP, BLOCK, SHARD_WORDS).groupBy(F.col("doc_id").alias("_id"), F.col("group").alias("_group"), "row_key")
    amounts = placed.agg(F.count("*").alias("_rows"), F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.min("first").alias("_first"), *(F.first(c).alias(f"_{c}") for c in ("each", "run_from", "run_to", "wrap_to")))
    amounts = durable(amounts.filter("_taken > 0"))
    keyed = packed(docs).select("_doc", "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row_key"), F.to_json(F.struct(F.col("_doc")["source"].alias("source"))).alias("_of"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_group")) & (F.col("_row_key") == F.col("row_key"))
    once = keyed.join(amounts.filter("_rows = 1"), same).withColumn("_at", F.col("_first"))
    # rows that repeat an id, text and source lie one after the other in their shard
    several = amounts.filter("_rows > 1")
    likely = with_presence(keyed, F.col("_row_key"), several.select("row_key"), "_maybe").filter("_maybe").drop("_maybe")
    like = W.partitionBy("_id", "_group", "row_key").orderBy("_row_key")
    repeated = likely.join(several, same).withColumn("_at", F.col("_first") + (F.row_number().over(like) - 1) * F.col("_size"))
    found = once.union(repeated).withColumn("text", F.col("_doc")["text"].cast("string"))
    wrapped, run = in_run(F.col("_at"), F.col("_size"), "_run_from", "_run_to", "_wrap_to")
    extra = sum(F.greatest(b - a, F.lit(0)) for a, b in (wrapped, run))
    whole = F.col("_each") + (extra >= F.col("_size")).cast("long")
    part = cut_words(F.when((extra > 0) & (extra < F.col("_size")), F.col("text")), *wrapped, *run)
    out = found.select("_doc", F.explode(F.concat(F.array_repeat(F.col("text"), whole.cast("int")), F.array(part))).alias("_text")).filter("_text <> ''")
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
