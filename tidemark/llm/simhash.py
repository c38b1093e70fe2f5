"""SimHash near-duplicates.

A fingerprint has 64 bits; bit b is 1 if more than half of a text's 3-word
shingles (XXH64, seed 42) have it. Texts link when their fingerprints differ in
at most `TAU` bits; classes are the connected components of the links.

Search for links (pigeonring principle): the bits form a ring of `SEGMENTS`
segments. If two fingerprints differ in at most TAU bits, there is a segment from
which every chain of l consecutive segments holds at most BUDGETS[l - 1] =
floor(l * TAU / SEGMENTS) differing bits: none in the first segment, 1 in two, 2 in three.

* A chain of three segments is looked up by equality: its first segment is equal and
  so are two of the four bytes after it, in one of five ways (`SLOTS`: 4 starts x 5).
* Candidates extend their chain segment by segment and fall out where it leaves its
  budget; only those that stay get the full Hamming test.

Only distinct fingerprints are joined, so copies cost nothing. A bucket (fingerprints
that agree in a slot) of more than `BUCKET` members isn't joined with itself, as that
would be all pairs of it. There the chain is extended from either side to meeting points:
fingerprints at distance d <= 3 have a value within 1 bit of one and 2 bits of the other.
Each member emits the values near it that stay within the chain's budgets, and per value
all members are linked to one that is 1 bit away at most: rows in proportion to members,
and the same components. Both ways are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, durable, join_spread, only, row_key
from .components import connected_components

TAU, SEGMENTS, SHINGLE = 3, 4, 3
SEGMENT_BITS = 64 // SEGMENTS
#: Differing bits that a chain of 1, 2, ... segments may hold.
BUDGETS = [length * TAU // SEGMENTS for length in range(1, SEGMENTS + 1)]
#: Members up to which a bucket is joined with itself.
BUCKET = 512
_SLICE = 1 << 16  # shingles counted at a time, so that a very long text takes bounded memory
_hash = partial(xxhash.xxh64_digest, seed=42)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    shingles = zip(*(itertools.islice(words, i, None) for i in range(min(SHINGLE, len(words)))))
    counts = np.zeros(64, np.int64)
    while part := b"".join(map(_hash, map(b" ".join, itertools.islice(shingles, _SLICE)))):
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and fp (bigint, the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps], ["doc_id", "row_key", "fp"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _byte(start: int, k: int) -> int:
    """Mask of byte k of the ring that begins with segment `start`."""
    return 0xFF << (start * SEGMENT_BITS + 8 * k) % 64


#: (first segment of the chain, mask of what is equal): a chain within its budgets has its first two bytes
#: equal and, of the next two and the two after these, the first pair or one of each.
SLOTS = [(i, sum(_byte(i, k) for k in (0, 1, *two))) for i in range(SEGMENTS) for two in ((2, 3), (2, 4), (2, 5), (3, 4), (3, 5))]
_WAYS = len(SLOTS) // SEGMENTS


def chain_ok(diff: Column, start: Column | int, length: int) -> Column:
    """Whether the chain of `length` segments from segment `start` of the differing bits `diff` is within its budget."""
    turn = F.lit(start) * SEGMENT_BITS
    ring = F.call_function("shiftrightunsigned", diff, turn.cast("int")).bitwiseOR(F.call_function("shiftleft", diff, (64 - turn).cast("int")))
    return F.bit_count(ring.bitwiseAND(F.lit(_signed((1 << length * SEGMENT_BITS) - 1)))) <= BUDGETS[length - 1]


def chains_ok(diff: Column, start: Column | int) -> Column:
    """Whether all chains from `start` but the whole ring, which is the Hamming test, are within their budgets."""
    out = chain_ok(diff, start, 1)
    for length in range(2, SEGMENTS):
        out = out & chain_ok(diff, start, length)
    return out


def first_slot(diff: Column) -> Column:
    """Number of the first slot that finds a pair, so that it comes from one bucket only."""
    return F.coalesce(*(F.when((diff.bitwiseAND(F.lit(_signed(mask))) == 0) & chains_ok(diff, i), F.lit(t)) for t, (i, mask) in enumerate(SLOTS)))


def candidates(members: DataFrame) -> DataFrame:
    """u, v, diff and t of pairs that share a bucket and whose chains, from the slot's first segment on, are within their budgets.

    `members` has t (the number of a slot), key (the bits equal in it) and fp.
    """
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), F.col("a.fp").bitwiseXOR(F.col("b.fp")).alias("diff"), F.col("a.t").alias("t"))
    return pairs.filter(chains_ok(F.col("diff"), F.floor(F.col("t") / _WAYS)))


def slotted(fps: DataFrame) -> DataFrame:
    """fp with each slot's number t and key."""
    slots = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (_, mask) in enumerate(SLOTS)))
    return fps.select("fp", F.inline(slots))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints `fp` into the same components as all links do."""
    keyed = slotted(fps)
    sizes = keyed.groupBy("t", "key").count().filter("count > 1")
    full = durable(keyed.join(sizes, ["t", "key"]))
    light, heavy = full.filter(F.col("count") <= bucket).drop("count"), full.filter(F.col("count") > bucket).drop("count")
    near = candidates(light).filter(F.bit_count("diff") <= TAU).filter(first_slot(F.col("diff")) == F.col("t")).select("u", "v")
    return near.union(_dense(heavy))


def near_flips(slot: int) -> tuple[list[int], list[int]]:
    """Flips of no or one bit, and of two bits, that keep the slot's equal bits and its chain's budgets."""
    start, mask = SLOTS[slot]
    free = [1 << b for b in range(64) if not (mask >> b) & 1]

    def within(bits: int) -> bool:
        ring = (bits >> start * SEGMENT_BITS | bits << 64 - start * SEGMENT_BITS) & ((1 << 64) - 1)
        return all((ring & ((1 << n * SEGMENT_BITS) - 1)).bit_count() <= BUDGETS[n - 1] for n in range(1, SEGMENTS + 1))

    two = [x | y for x, y in itertools.combinations(free, 2) if within(x | y)]
    return [0, *map(_signed, free)], list(map(_signed, two))


def _dense(members: DataFrame) -> DataFrame:
    """Links within large buckets, by values at most 1 bit from one and 2 bits from the other fingerprint."""
    spark = members.sparkSession
    # a row for each slot's flips, some ten thousand numbers whatever the input
    flips = spark.createDataFrame([(t, *near_flips(t)) for t in range(len(SLOTS))], "_t int, one array<bigint>, two array<bigint>")
    near = members.join(F.broadcast(flips), F.col("t") == F.col("_t"))
    marked = F.concat(F.transform("one", lambda x: F.struct(x.alias("x"), F.lit(True).alias("close"))), F.transform("two", lambda x: F.struct(x.alias("x"), F.lit(False).alias("close"))))
    at = near.select("fp", "t", F.explode(marked).alias("s")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("s.x")).alias("z"), F.col("s.close").alias("close"))
    hub = at.groupBy("t", "z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.count("*").alias("n")).filter("v is not null and n > 1")
    return at.join(hub, ["t", "z"]).filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the class) of every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows each get their row. A null doc_id keeps its fingerprint and takes its class's
    smallest id (null if the class has none). An empty table gives no rows; further
    columns of `docs` are ignored.
    """
    found = _classes(docs, bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, bucket: int) -> DataFrame:
    prints = durable(with_fingerprints(docs))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = connected_components(links(classes.select("fp"), bucket))
    linked = classes.join(parts.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    named = durable(classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")))
    return join_spread(prints, named, "fp", "n")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each class the one with the smallest doc_id.

    Rows that repeat both that id and its text all stay (exact duplicates are another operator's work),
    as do rows of a class without any id.
    """
    found = durable(_classes(docs, bucket))
    return drop_rows(docs, found.filter("not (doc_id <=> component_id)").select("doc_id", "row_key"))
