"""Operator 11: substring dedup by seed and extend.

Seeds are winnowed: of the 5-word grams of a window of 13 words the one with the least hash stands for the window, so two
equal windows always have the same seed at the same place in them, wherever they are. Neighbouring windows with one seed
are a stretch: the seed extended both ways as far as its windows reach. Then

1. seeds are joined: those of one document alone go, by one aggregation of (seed, document);
2. stretches that agree to both ends are a class; its windows repeat whole in all of its documents but the first;
3. where a seed has several classes, their first documents' stretches are cut to single windows, which are joined by seed and words;
4. the windows found are merged to maximal repeats of each document.

No pairs are made: each stretch meets one row of its class. Stretches of a class or of a window that many documents
share are salted. Words and stretches are told by 64-bit hashes of their words, always together with the seed's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, durable, only, shared_dir, with_presence

LENGTH, SEED = 13, 5
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 20
#: Bits of the map of repeated seeds that tasks get: 8 MB whatever the input. What it lets through wrongly is sorted out by the joins.
MAP_BITS = 1 << 26
#: Parts into which the rows of a hot key are dealt.
SALTS = 64

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(_P))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd number mod 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, U)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=U)
    return _powers[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def _piece_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they start; a word ends at white space and at each of `bounds`."""
    gap = _SPACE[data]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    at = bounds[(bounds > 0) & (bounds < len(data))]
    first[at], last[at - 1] = ~gap[at], ~gap[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _prefix(_BYTE[data], _P)
    return _mix((sums[end] - sums[start]) * powers(inverse(_P), len(data) + 1)[start] + (end - start).astype(U)), start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie behind each other, and each text's place among them. Long texts are read in pieces, cut at white space."""
    hashes, starts, low = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while low < len(data):
        high = min(len(data), low + PIECE)
        if high < len(data):
            bound = offsets[np.searchsorted(offsets, high, side="right") - 1]
            gaps = np.flatnonzero(_SPACE[data[low:high]])
            if bound > low:
                high = int(bound)
            elif len(gaps):
                high = low + int(gaps[-1]) + 1
            else:  # a word longer than a piece
                more = np.flatnonzero(_SPACE[data[high:]])
                nxt = int(offsets[np.searchsorted(offsets, high)])
                high = min(nxt, high + int(more[0]) + 1) if len(more) else nxt
        h, s = _piece_words(data[low:high], offsets - low)
        hashes.append(h)
        starts.append(s + low)
        low = high
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def stretches(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each stretch: its text, its first window's place in it, the number of its windows, its seed's hash, its own; and the hashes of all windows, stretch by stretch."""
    n = len(words)
    first = np.flatnonzero(np.arange(n) + length <= np.repeat(at[1:], np.diff(at)))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U), none.astype(U)
    sums, back = _prefix(words, _Q), powers(inverse(_Q), n + 1)
    grams = _mix((sums[seed:] - sums[:-seed]) * back[: n + 1 - seed])
    least, place = grams[first], first.copy()
    for j in range(1, length - seed + 1):
        other = grams[first + j]
        less = other < least
        least, place = np.where(less, other, least), np.where(less, first + j, place)
    opens = np.ones(len(first), bool)
    opens[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    lead = np.flatnonzero(opens)
    count = np.diff(np.append(lead, len(first)))
    start = first[lead]
    end = start + count + length - 1
    whole = _mix((sums[end] - sums[start]) * back[start] + _mix((count * length + place[lead] - start).astype(U)))
    windows = _mix((sums[first + length] - sums[first]) * back[first])
    text = np.searchsorted(at, start, side="right") - 1
    return text, start - at[text], count, least[lead], whole, windows


def _stretch_batches(length: int, seed: int, rows: Callable) -> Callable:
    """A task over batches of (doc_id, text_key, text); `rows` makes a batch of what `stretches` finds and the texts' ids and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            low = 0
            while low < len(texts):  # whole texts, of a piece together or one longer one
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1)
                part = offsets[low : high + 1] - offsets[low]
                words, at = word_hashes(data[offsets[low] : offsets[high]], part)
                yield rows(ids[low:high], keys[low:high], *stretches(words, at, length, seed))
                low = high

    return run


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def _seed_rows(ids, keys, text, start, count, seed, whole, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_long(seed), _long(ids[text])], names=["seed", "doc_id"])


def _held(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (x & U(MAP_BITS - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _class_rows(repeated) -> Callable:
    def rows(ids, keys, text, start, count, seed, whole, windows) -> pa.RecordBatch:
        keep = _held(repeated.value, seed)
        return pa.RecordBatch.from_arrays([_long(seed[keep]), _long(whole[keep]), _long(ids[text[keep]])], names=["seed", "whole", "doc_id"])

    return rows


def _full_rows(repeated, several) -> Callable:
    """Stretches of repeated seeds; the windows of those whose seed has several classes."""

    def rows(ids, keys, text, start, count, seed, whole, windows) -> pa.RecordBatch:
        keep = _held(repeated.value, seed)
        cut = keep & _held(several.value, seed)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(cut, count, 0)[keep])).astype(np.int32)), _long(windows[np.repeat(cut, count)]))
        columns = [_long(seed[keep]), _long(whole[keep]), _long(ids[text[keep]]), _long(keys[text[keep]]), _long(start[keep]), _long(count[keep]), lists]
        return pa.RecordBatch.from_arrays(columns, names=["seed", "whole", "doc_id", "text_key", "start", "n", "windows"])

    return rows


def bit_map(values: DataFrame, name: str):
    """A map of MAP_BITS bits of a bigint column, of that size whatever the table, given to all tasks."""
    at = F.col(name).bitwiseAND(F.lit(MAP_BITS - 1))
    parts = values.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for part, block in parts:
        bits[part * 4096 : part * 4096 + 4096] = np.frombuffer(bytes(block).ljust(4096, b"\0"), np.uint8)
    return values.sparkSession.sparkContext.broadcast(bits)


def _join_first(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `first`, the least document of their keys, null where `firsts` (keys, first, n) has none; the rows of a key
    that more than a thousandth of all share are dealt to SALTS parts."""
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.filter(F.col("n") * HOT_SHARE > total)
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64("text_key", "start"), F.lit(SALTS))).otherwise(0).cast("int")
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_is_hot"))), keys, "left").withColumn("_salt", salt).drop("_is_hot")
    salts = F.when(F.col("n") * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(firsts.select(*keys, "first", F.explode(salts).alias("_salt")), [*keys, "_salt"], "left").drop("_salt")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, spans): the maximal repeats of each text, as places [from, to) of its words: stretches of words all of whose
    windows of `length` words also start in a document with a smaller doc_id. Texts without any have no row.

    Rows without doc_id neither are repeats nor make any. Rows of one doc_id are alike documents, none before the other.
    """
    rows = _keyed(docs).filter("doc_id is not null").select("doc_id", "text_key", "text")
    scan = lambda make, schema: rows.mapInArrow(_stretch_batches(length, seed, make), schema)
    seeds = scan(_seed_rows, "seed long, doc_id long").groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = bit_map(seeds.filter("first < last").select("seed"), "seed")
    classes = scan(_class_rows(repeated), "seed long, whole long, doc_id long").groupBy("seed", "whole")
    classes = durable(classes.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")))
    several = bit_map(classes.groupBy("seed").count().filter("count > 1").select("seed"), "seed")

    found = scan(_full_rows(repeated, several), "seed long, whole long, doc_id long, text_key long, start long, n long, windows array<long>")
    found = found.select("seed", "whole", "doc_id", "text_key", F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n_windows"), "windows")
    met = _join_first(found, classes.filter("first < last").select("seed", "whole", "first", "n"), ["seed", "whole"])
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    settled = met.filter(later | (F.size("windows") > 0)).select("doc_id", "text_key", "start", "n_windows", later.alias("later"), F.when(~later, F.col("seed")).alias("seed"), F.when(~later, F.col("windows")).alias("windows"))
    at = f"{shared_dir(docs.sparkSession)}/stretches-{uuid.uuid4().hex}"
    settled.write.parquet(at)
    settled = docs.sparkSession.read.schema(settled.schema).parquet(at)

    single = settled.filter("not later").select("seed", "doc_id", "text_key", "start", F.posexplode("windows").alias("k", "window"))
    single = single.select("seed", "window", "doc_id", "text_key", (F.col("start") + F.col("k")).alias("start"))
    firsts = durable(single.groupBy("seed", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last").select("seed", "window", "first", "n"))
    again = _join_first(single, firsts, ["seed", "window"]).filter("doc_id > first")
    spans = settled.filter("later").select("doc_id", "text_key", "start", (F.col("start") + F.col("n_windows") + (length - 1)).alias("end"))
    spans = spans.union(again.select("doc_id", "text_key", "start", (F.col("start") + length).alias("end")))
    gathered = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return gathered.mapInArrow(_merged, "doc_id long, text_key long, spans array<struct<start: int, end: int>>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans in order, joined where they overlap or touch."""
    for b in batches:
        spans = b.column("spans")
        flat, bounds = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
        text = np.repeat(np.arange(len(spans)), np.diff(bounds))
        start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
        order = np.lexsort((end, start, text))
        text, start, end = text[order], start[order], end[order]
        # ends so far, text by text: a later text's are moved above all earlier ones'
        top = int(end.max(initial=0)) + 1
        upto = np.maximum.accumulate(end + text * top) - text * top
        opens = np.ones(len(text), bool)
        opens[1:] = (text[1:] != text[:-1]) | (start[1:] > upto[:-1])
        lead = np.flatnonzero(opens)
        last = np.append(lead[1:], len(text)) - 1
        made = pa.StructArray.from_arrays([pa.array(start[lead], pa.int32()), pa.array(upto[last].astype(np.int32))], names=["start", "end"])
        offsets = np.searchsorted(text[lead], np.arange(len(spans) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.ListArray.from_arrays(pa.array(offsets), made)], names=["doc_id", "text_key", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        kept, n, gone = [], [], []
        for text, spans in zip(texts, b.column("spans").to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            left, at = [], 0
            for s in spans or ():
                left += words[at : s["start"]]
                at = s["end"]
            left += words[at:]
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b.column("spans")], names=["doc_id", "n_words", "n_removed", "text", "spans"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans): each document's words that no maximal repeat covers, joined by one space, and the
    repeats (null if none). Null and empty texts have no words. Only texts that may hold repeats are moved.
    """
    rows = _keyed(docs)
    spans = durable(repeated_spans(docs, length, seed))
    marked = with_presence(rows, F.col("text_key"), spans.select("text_key"), "_maybe")
    maybe = marked.filter("_maybe").select("doc_id", "text_key", "text").join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    none = marked.filter("not _maybe").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return none.union(maybe).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string, spans array<struct<start: int, end: int>>")
