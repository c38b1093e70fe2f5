"""Exact duplicates by an extendible-hash index on shared files; DataFrame operations only.

Texts are equal when their normalised forms are (each run of white space becomes
one space; null counts as empty). A first pass over the documents writes their keys (64 bits)
and SHA-256 digests to the shared folder; entries, one for each (key, digest), count their rows.

Index: the directory starts with one bucket. While a bucket holds more entries
than `CAPACITY`, it splits by the next leading bit of the keys, and the directory
doubles as far as its deepest bucket needs; its depth follows the number of entries. A
bucket is so a range of keys. Entries are dealt to owner tasks by ranges of buckets, and their
bucket files written to the shared folder.

Comparison: the texts of entries with two rows or more are read again, find their
bucket and entry in the index, and go to the bucket's owner, copies pre-aggregated. Owners
sort a bucket's texts by entry and compare each, byte by byte, with the one before: a text
that differs opens a new link of the entry's chain. Each link is a group of equal texts.
Only texts that may belong to such an entry are moved (a presence map of fixed size tells).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, durable, join_spread, only, packed, row_key, with_presence

#: Entries that a bucket holds before it splits; tasks over which the copies of one text are pre-aggregated.
CAPACITY, SPREAD = 4096, 32
ENTRY = ["key", "digest"]
Hashes = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: How a normalised text is hashed to a key and a digest; tests pass weak ones to force collisions.
HASHES = (F.xxhash64, sha256)


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))


def hashed(docs: DataFrame, hashes: Hashes = HASHES) -> DataFrame:
    """doc_id, row_key, key, digest and uid (a number of its own) of every row, written to the shared folder."""
    norm = _rows(docs).select("doc_id", "row_key", normalised(F.col("text")).alias("norm"))
    return durable(norm.select("doc_id", "row_key", hashes[0](F.col("norm")).alias("key"), hashes[1](F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("uid")))


def leading(key: Column | str, bits: int) -> Column:
    """The first `bits` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """slot (leading bits of a key), depth and bucket (first slot) of its bucket, and how many bits a slot has.

    Splits are decided on the number of entries of each slot; slots get two bits more until no bucket is overfull
    (or none can be split as the slots have all bits of a key).
    """
    total, bits = entries.count(), 0
    while bits < 8 or capacity << bits < 8 * total:
        bits += 1
    while True:
        slots = durable(entries.groupBy(leading("key", bits).alias("slot")).agg(F.count("*").alias("n")))
        most = slots.agg(F.max("n")).first()[0] or 0
        if most <= capacity or bits >= 62:
            break
        bits += 2
    parts = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("part", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    filled = parts.groupBy("depth", "part").agg(F.sum("n").alias("n"))
    split = filled.filter((F.col("n") > capacity) & (F.col("depth") < bits))
    # what a split leaves are two halves; those that hold no more than a bucket may are buckets, as is a first one that is never split
    halves = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(2 * F.col("part"), 2 * F.col("part") + 1)).alias("part"))
    root = filled.filter("depth = 0").select("depth", "part")
    buckets = durable(halves.union(root).join(split, ["depth", "part"], "left_anti"))
    at = parts.join(buckets, ["depth", "part"]).select("slot", "depth", F.expr(f"shiftleft(part, {bits} - depth)").alias("bucket"))
    return at, bits


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of `hashed` rows, written to the shared folder: bucket, depth, key, digest, keep_id (the smallest doc_id) and n."""
    entries = durable(rows.groupBy(*ENTRY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")))
    slots, bits = directory(entries, capacity)
    placed = entries.withColumn("slot", leading("key", bits)).join(slots, "slot")
    return durable(placed.select("bucket", "depth", *ENTRY, "keep_id", "n").repartitionByRange("bucket").sortWithinPartitions("bucket", "key"))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, hashes: Hashes = HASHES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text), row_key.

    Of equal texts the row with the smallest doc_id stays; of rows that repeat that
    id, one. A null doc_id counts as the largest. Null texts equal empty ones. Texts of any length
    are compared whole. An empty table gives no rows; further columns of `docs` are ignored.
    """
    rows = hashed(docs, hashes)
    return _decide(docs, rows, build_index(rows, capacity), hashes)


def _texts(docs: DataFrame, rows: DataFrame, several: DataFrame, hashes: Hashes) -> DataFrame:
    """doc_id, row_key, norm and the entry's index row for every row of `docs` that has an entry with more than one."""
    likely = join_spread(rows.select("row_key", F.struct(*ENTRY).alias("entry")), several.select(F.struct(*ENTRY).alias("entry"), "n"), "entry", "n")
    maybe = with_presence(_rows(docs), F.col("row_key"), likely.select("row_key"), "_maybe").filter("_maybe")
    norm = maybe.select("doc_id", "row_key", normalised(F.col("text")).alias("norm"))
    keyed = norm.withColumn("entry", F.struct(hashes[0](F.col("norm")).alias("key"), hashes[1](F.col("norm")).alias("digest")))
    return join_spread(keyed, several.select(F.struct(*ENTRY).alias("entry"), "bucket", "n"), "entry", "n")


def _chains(texts: DataFrame) -> DataFrame:
    """The owners' work: bucket, entry, link (number in the entry's chain), norm, keep_id and n of each group of equal texts."""
    share = F.pmod(F.xxhash64("row_key"), F.lit(SPREAD))
    fewer = texts.groupBy("bucket", "entry", "norm", share.alias("share")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    owned = fewer.repartitionByRange("bucket").sortWithinPartitions("bucket", "entry", "norm")
    chain = W.partitionBy("bucket", "entry").orderBy("norm")
    opens = F.when(F.lag("norm").over(chain) == F.col("norm"), 0).otherwise(1)
    linked = owned.withColumn("opens", opens).withColumn("link", F.sum("opens").over(chain))
    return linked.groupBy("bucket", "entry", "link").agg(F.max(F.when(F.col("opens") == 1, F.col("norm"))).alias("norm"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _decide(docs: DataFrame, rows: DataFrame, index: DataFrame, hashes: Hashes) -> DataFrame:
    several = index.filter("n > 1")
    texts = _texts(docs, rows, several, hashes)
    links = durable(_chains(texts))
    ends = links.groupBy("entry").agg(F.max("link").alias("ends"))
    groups = durable(links.join(ends, "entry").select("entry", "link", "keep_id", "n", "ends"))
    known = rows.withColumn("entry", F.struct(*ENTRY)).drop("key")
    found = join_spread(known, groups.filter("ends = 1").drop("ends"), "entry", "n", keep_count=True)
    if not groups.filter("ends > 1").isEmpty():  # different texts with one key and digest: their rows are told by the text
        norms = links.join(ends.filter("ends > 1").select("entry"), "entry").select(F.struct("entry", "norm").alias("whole"), "link", "keep_id", "n")
        told = join_spread(texts.select("doc_id", "row_key", F.struct("entry", "norm").alias("whole")), norms, "whole", "n", keep_count=True)
        told = told.select("row_key", F.col("whole.entry").alias("entry"), "link", "keep_id", "n").distinct()
        found = found.union(known.join(told, ["row_key", "entry"]).select(*found.columns))
    found = durable(found)
    # rows that repeat the id that stays: the first of them
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("entry", "link").agg(F.min("uid").alias("first")).select("first")
    judged = found.join(first, F.col("uid") == F.col("first"), "left").withColumn("kept", F.col("first").isNotNull())
    many = judged.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "digest", "row_key")
    single = index.filter("n = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "digest", F.lit(None).cast("long").alias("row_key"))
    return single.union(many).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "row_key")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; only texts that may have copies are moved.

    Of equal texts the row with the smallest doc_id stays, null counting as empty and a null id as the largest; of rows
    that repeat that id and text, any one. An empty table gives no rows.
    """
    verdicts = durable(exact_duplicates(docs).filter("row_key is not null").groupBy("doc_id", "row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    keyed = packed(docs).select("_doc", "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row_key"))
    marked = with_presence(keyed, F.col("_row_key"), verdicts.select("row_key"), "_maybe")
    maybe = marked.filter("_maybe").drop("_maybe")
    named = verdicts.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "kept")
    same = maybe["doc_id"].eqNullSafe(named["_id"]) & (maybe["_row_key"] == named["_key"])
    alone = marked.filter("not _maybe").select("_doc").union(maybe.join(named, same, "left_anti").select("_doc"))
    repeated = maybe.join(named.filter("kept"), same, "left_semi").groupBy("doc_id", "_row_key").agg(F.first("_doc").alias("_doc"))
    return alone.union(repeated.select("_doc")).select("_doc.*")
