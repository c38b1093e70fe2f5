"""Operator 13: hard negatives by slot-decomposed selection.

A positive of score p admits negatives of scores from low*p to high*p (in hundredths). An anchor's positives have upper limits
that fall from one to the next; these split the scores into disjoint slots, each from one limit down to just above the next.
So a negative belongs to one slot of an anchor, however many windows it lies in. Each task keeps the best few of every
slot, and so does the merge of the tasks. The best of a window are the first of the slots from its positive's on, in falling order,
as far as its lower limit: one pass answers all windows, which overlap.

Anchors and rows are dealt to cells of one block of anchors and one slice of rows. A cell's anchors are held, its rows
streamed past them in blocks; only a cell's best leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components become floor(SCALE * x).
SCALE = 256
#: Anchors of a cell, rows of a slice at least, and slices at most; rows and anchors scored at a time.
ANCHORS, SLICE, SLICES = 16384, 2048, 64
ROWS, AT_ONCE = 2048, 512
#: Scores that stay below this in size are worked out in doubles, which hold them exactly; others in Python's whole numbers.
EXACT = 1 << 50
MOST = (1 << 63) - 1
FOUND = "anchor long, slot int, score long, other long, other_id long"


def prepare(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, vec_id, label, anchor, q) of the rows that take part; `uid` tells rows of one vec_id apart."""
    x = F.col(f"`{vector}`")
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    picked = rows.filter(F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite)
    picked = picked.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("q"))
    return durable(picked.withColumn("uid", F.monotonically_increasing_id()))


def _matrix(lists: pa.ListArray, width: int, exact: bool) -> np.ndarray:
    flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], sizes)] = flat
    return out.astype(np.float64) if exact else out.astype(object)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k of each anchor and slot: higher scores, then smaller ids, then null ids."""
    order = np.lexsort((found["other"], found["id"], found["no_id"], -found["score"], found["slot"], found["at"]))
    found = found.iloc[order]
    return found[found.groupby(["at", "slot"], sort=False).cumcount().to_numpy() < k]


class _Cell:
    """A cell's anchors, and the best rows so far of each of their slots."""

    def __init__(self, width: int, exact: bool, k: int, negatives: bool) -> None:
        self.width, self.exact, self.k, self.negatives = width, exact, k, negatives
        self.batches: list[pa.RecordBatch] = []
        self.parts: list[pd.DataFrame] | None = None

    def add_anchors(self, b: pa.RecordBatch) -> None:
        self.batches.append(b)

    def start(self) -> None:
        t = pa.Table.from_batches(self.batches).combine_chunks()
        self.q = _matrix(t["q"].combine_chunks(), self.width, self.exact)
        self.uid, self.label = t["uid"].to_numpy(), t["label"].to_numpy()
        # limits of the slots from the highest on, the last one below all scores; and the least score of any window
        ps = t["scores"].to_pylist()
        high = [[HIGH * p // 100 for p in x or ()] for x in ps]
        low = [min([-(-LOW * p // 100) for p in x or () if p >= 0], default=None) for x in ps]
        n = max([len(x) for x in high], default=0)
        self.high = np.array([x + [-MOST] * (n - len(x)) for x in high], np.int64).reshape(len(ps), n)
        self.low = np.array([MOST if x is None else x for x in low], np.int64)
        none = pd.DataFrame({c: np.zeros(0, bool if c == "no_id" else np.int64) for c in ("at", "slot", "score", "no_id", "id", "other")})
        self.parts = [none for _ in range(0, len(ps), AT_ONCE)]

    def add_rows(self, b: pa.RecordBatch) -> None:
        if self.parts is None:
            self.start()
        for low in range(0, len(b), ROWS):
            part = b.slice(low, ROWS)
            q, uid, label = _matrix(part.column("q"), self.width, self.exact), part.column("uid").to_numpy(), part.column("label").to_numpy()
            no_id, ids = part.column("vec_id").is_null().to_numpy(zero_copy_only=False), part.column("vec_id").fill_null(0).to_numpy()
            for i in range(len(self.parts)):
                these = slice(i * AT_ONCE, (i + 1) * AT_ONCE)
                score = np.dot(self.q[these], q.T)
                score = (score if self.exact else np.clip(score, -MOST, MOST)).astype(np.int64)
                if self.negatives:
                    ok = (self.label[these, None] != label) & (score <= self.high[these, :1]) & (score >= self.low[these, None])
                else:
                    ok = (self.label[these, None] == label) & (self.uid[these, None] != uid)
                a, r = np.nonzero(ok)
                s = score[a, r]
                a = a + i * AT_ONCE
                slot = (self.high[a] >= s[:, None]).sum(axis=1).astype(np.int64) if self.negatives else np.zeros(len(a), np.int64)
                new = pd.DataFrame({"at": a, "slot": slot, "score": s, "no_id": no_id[r], "id": ids[r], "other": uid[r]})
                self.parts[i] = _best(pd.concat([self.parts[i], new], ignore_index=True), self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        for p in self.parts or ():
            columns = [pa.array(self.uid[p["at"]], pa.int64()), pa.array(p["slot"].to_numpy(), pa.int32()), pa.array(p["score"].to_numpy(), pa.int64()), pa.array(p["other"].to_numpy(), pa.int64()), pa.array(p["id"].to_numpy(), pa.int64(), mask=p["no_id"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "other", "other_id"])


def _cells(make: Callable[[], _Cell]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for b in batches:
            block, slice_, kind = (b.column(c).to_numpy() for c in ("block", "slice", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(slice_) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if (block[low], slice_[low]) != now:
                    if cell is not None:
                        yield from cell.result()
                    now, cell = (block[low], slice_[low]), make()
                part = b.slice(low, high - low)
                if kind[low] == 0:
                    cell.add_anchors(part)
                elif cell.batches:
                    cell.add_rows(part)
        if cell is not None:
            yield from cell.result()

    return run


def _select(rows: DataFrame, anchors: DataFrame, k: int, negatives: bool, anchors_per_cell: int, rows_per_slice: int) -> DataFrame:
    """The best k rows of each slot of each anchor (uid, label, q, scores of its positives), over all cells."""
    facts = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda v: F.abs(v.cast("decimal(20,0)")))))).first()
    n, width, largest = facts[0], facts[1] or 0, int(facts[2] or 0)
    blocks, slices = max(1, -(-anchors.count() // anchors_per_cell)), min(SLICES, max(1, -(-n // rows_per_slice)))
    exact = largest * largest * max(width, 1) < EXACT
    one = anchors.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "uid", F.lit(None).cast("long").alias("vec_id"), "label", "q", "scores")
    many = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "uid", "vec_id", "label", "q", F.lit(None).cast("array<long>").alias("scores"))
    both = one.withColumns({c: F.col(c).cast("int") for c in ("block", "slice")}).union(many.withColumns({c: F.col(c).cast("int") for c in ("block", "slice")}))
    dealt = both.repartition(min(blocks * slices, 10_000), "block", "slice").sortWithinPartitions("block", "slice", "kind")
    found = dealt.mapInArrow(_cells(lambda: _Cell(width, exact, k, negatives)), FOUND)
    turn = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other"))
    return found.withColumn("turn", turn).filter(F.col("turn") <= k)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, anchors_per_cell: int = ANCHORS, rows_per_slice: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor and each of its first `positives` rows of the
    same label the first `negatives` rows of other labels with scores from LOW to HIGH hundredths of the positive's.

    Rows with a null label or vector, or with a null or non-finite component, take no part; empty vectors score 0, a shorter vector counts
    as filled up with zeros. Components and scores beyond 64 bits become the nearest 64-bit number. Equal scores
    go by vec_id, null last. Repeated rows are rows of their own: each is anchor, positive and negative by itself.
    """
    ready = prepare(rows, anchor, vec_id, vector, label)
    of = ready.filter("anchor").select("uid", F.col("vec_id").alias("anchor_id"), "label", "q")
    first = _select(ready, of.withColumn("scores", F.lit(None).cast("array<long>")), positives, False, anchors_per_cell, rows_per_slice)
    first = durable(first.select(F.col("anchor").alias("uid"), F.col("turn").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    limits = first.groupBy("uid").agg(F.sort_array(F.collect_list("positive_score"), asc=False).alias("scores"))
    slots = _select(ready, of.join(limits, "uid"), negatives, True, anchors_per_cell, rows_per_slice).select(F.col("anchor").alias("uid"), "slot", "turn", F.col("score").alias("negative_score"), F.col("other_id").alias("negative_id"))
    # from a positive's slot on: every slot's scores are below those of the slots before it
    p, s = (F.col(c).cast("decimal(38,0)") for c in ("positive_score", "negative_score"))
    window = first.join(slots, "uid").filter((F.col("slot") >= F.col("place")) & (100 * s >= LOW * p) & (100 * s <= HIGH * p))
    rank = F.row_number().over(W.partitionBy("uid", "place").orderBy("slot", "turn"))
    ranked = window.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.join(of.select("uid", "anchor_id"), "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
