"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_dir  # noqa: F401  also for the other modules here

#: White space that separates words, and its complement, in Java's and DuckDB's regex syntax.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of `text`; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, also where `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with working names."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


#: Bits of a presence map: 256 bitmaps of 4096 bytes, so at most 1 MB is broadcast whatever the input.
MAP_BITS = 1 << 23


def with_presence(df: DataFrame, key: Column, present: DataFrame, name: str) -> DataFrame:
    """`df` with a boolean column `name`: false only where no row of `present` (one bigint column) equals `key`.

    A map of `MAP_BITS` bits of the keys, of a fixed size, is broadcast. It saves moving rows that
    can't match; what remains is for an exact join.
    """
    value = F.col(present.columns[0])
    pos = value.bitwiseAND(F.lit(MAP_BITS - 1))
    maps = present.groupBy(F.shiftright(pos, 15).alias("_part")).agg(F.bitmap_construct_agg(pos.bitwiseAND(F.lit(32767))).alias("_map"))
    at = key.bitwiseAND(F.lit(MAP_BITS - 1))
    low = at.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, low.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    joined = df.withColumn("_part_of", F.shiftright(at, 15)).join(F.broadcast(maps), F.col("_part_of") == F.col("_part"), "left")
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_part_of", "_part", "_map")


def row_key(doc_id: Column, text: Column) -> Column:
    """A number that rows of the same id and text share."""
    return F.xxhash64(doc_id, text)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as `_doc`, so that no column of the input can clash with working names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)


def drop_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` without the rows of `rejected` (doc_id, row_key); only rows that may be rejected are moved."""
    keyed = packed(docs).select("_doc", "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row_key"))
    marked = with_presence(keyed, F.col("_row_key"), rejected.select("row_key"), "_maybe")
    out = rejected.select(F.col("doc_id").alias("_gone"), F.col("row_key").alias("_gone_key")).distinct()
    maybe = marked.filter("_maybe").join(out, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_row_key") == F.col("_gone_key")), "left_anti")
    return marked.filter("not _maybe").select("_doc.*").union(maybe.select("_doc.*"))


#: A key is hot if more than one row in so many has it; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_spread(rows: DataFrame, by_key: DataFrame, key: str, count: str, keep_count: bool = False, total: int | None = None) -> DataFrame:
    """Inner join with a table of one row per `key`, whose column `count` says how many of `rows` have it (`total` together).

    The rows of hot keys, of which there are fewer than HOT_SHARE, are joined by a broadcast of these
    keys' short rows, so they stay spread over the tasks; the others by a shuffle.
    """
    if total is None:
        total = by_key.agg(F.sum(count)).first()[0] or 0
    hot = by_key.filter(F.col(count) * HOT_SHARE > total)
    values = [c for c in by_key.columns if c != key and (keep_count or c != count)]
    known = hot.select(F.col(key).alias("_hot_key"), F.struct(F.lit(True).alias("_is"), *values).alias("_hot"))
    marked = rows.join(F.broadcast(known), F.col(key) == F.col("_hot_key"), "left")
    near = marked.filter("_hot_key is not null").select(*rows.columns, *(F.col(f"_hot.{v}").alias(v) for v in values))
    rest = marked.filter("_hot_key is null").select(*rows.columns).join(by_key.filter(F.col(count) * HOT_SHARE <= total).select(key, *values), key)
    return near.union(rest.select(*rows.columns, *values))
