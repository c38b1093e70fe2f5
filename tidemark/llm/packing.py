"""Best-fit packing of tokenised documents into sequences.

Documents become token ids (a public byte-level BPE vocabulary) and an end id.
Longer ones are cut into whole sequences, the first piece taking the remainder.

Which lengths share a sequence depends on the number of pieces of each length
alone, CAPACITY numbers however large the corpus. The plan is made from these:

* lengths above a third of the capacity: longest first, each takes the longest
  other that still fits, so at most two share a sequence;
* smaller ones, longest first, go where the least room that fits is left, as many
  as fit; a new sequence is opened only if none fits.

A plan is a list of runs: pieces of a length, by rank, go to consecutive
sequences at one offset. Ranks come from windows over (length, salt) and the
salts' counts, so that a length which a third of the pieces share is split.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import durable, only

CAPACITY, END_ID, SALTS = 1024, 2, 64
#: Documents that a worker encodes at a time.
AT_ONCE = 128
# The pre-tokenizing pattern that byte-level BPE files name by `use_regex`.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, Callable[[list[str | None]], list[bytes]]] = {}


def _bytes_of() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _is_plain(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose merges are in the order of their ids, with nothing else that changes ids."""
    model, pre, ids = spec["model"], spec.get("pre_tokenizer") or {}, spec["model"].get("vocab")
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    merged = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(a < b for a, b in zip([-1, *merged], merged)) and _bytes_of().keys() <= ids.keys()


def encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Texts -> their ids as little-endian unsigned 32-bit numbers, by a tokenizer file.

    The vocabulary of a plain byte-level BPE is run by a faster engine with the same ids; other files, and texts with a
    special token's string, are left to the file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    engine = None
    if _is_plain(spec):
        letters = _bytes_of()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        slow = engine is None or any(s in text for s in added)
        ids = tokenizer.encode(text, add_special_tokens=False).ids if slow else engine.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()

    return lambda texts: [encode(t or "") for t in texts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, encoder(tokenizer))
        for b in batches:
            out: list[tuple] = []
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    out += [(doc, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Runs of a packing: (length, first rank, count, first sequence, offset, sequences apart)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.runs, self.used = capacity, 0, [], Counter()
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number)

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, first, offset))
        self.used[length] += count

    def opened(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.rooms.setdefault(room, []).append((first, count))

    def fill(self, length: int, n: int, room: int, first: int, bins: int) -> int:
        """Puts up to n pieces into like sequences, as many in each as fit; what remains of n."""
        each = room // length
        full, rest = min(bins, n // each), 0
        for k in range(each if full else 0):
            self.put(length, full, first, self.capacity - room + k * length)
        n -= full * each
        self.leave(room - each * length, first, full)
        if n and full < bins:
            rest = 1
            for k in range(n):
                self.put(length, 1, first + full, self.capacity - room + k * length)
            self.leave(room - n * length, first + full, 1)
            n = 0
        self.leave(room, first + full + rest, bins - full - rest)
        return n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) for so many pieces of each length, and the number of sequences."""
    p, left = _Plan(capacity), Counter({k: v for k, v in counts.items() if v})
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b == a and n == 0:  # one piece of this length is left
            b = large[at - 1] if at else None
            n = 1
        first = p.opened(n)
        p.put(a, n, first, 0)
        left[a] -= n
        if b is not None:
            p.put(b, n, first, a)
            left[b] -= n
        p.leave(capacity - a - (b or 0), first, n)
        large = [k for k in large if left[k]]
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[length]
        for room in sorted(r for r in p.rooms if r >= length):
            for first, bins in p.rooms.pop(room):
                if n:
                    n = p.fill(length, n, room, first, bins)
                else:
                    p.leave(room, first, bins)
            if not n:
                break
        if n:
            bins = -(-n // (capacity // length))
            p.fill(length, n, capacity, p.opened(bins), bins)
    return p.runs, p.bins


def pack(items: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """`items` (doc_id, piece, start, length, ids_crc32; lengths from 1 to capacity) with sequence_id and offset.

    Rows that are alike in all columns are exchangeable, so reruns agree.
    """
    spark = items.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))
    salted = items.withColumn("_salt", salt)
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # capacity x salts rows at most
    before = groups.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), (F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_length", "_rank0", "_count", "_first", "_offset")])
    runs_df = spark.createDataFrame(runs, schema)
    local = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_local", local).join(F.broadcast(before), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_before") + F.col("_local") - 1)
    placed = ranked.join(F.broadcast(runs_df), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_rank0")) & (F.col("_rank") < F.col("_rank0") + F.col("_count")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_rank0")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All rows of `docs`, tokenised, cut and packed: one row per piece.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are separate
    documents; a null doc_id stays null. Texts of any length are encoded whole. An empty table gives no rows; further
    columns of `docs` are ignored.
    """
    return pack(durable(pieces(docs, tokenizer, capacity, end_id)), capacity)
