"""Operator 12: repair of conversation structure by a grammar-compressed dynamic program.

A row of a conversation is one of nine symbols (role and fault). What cheapest edits do to the form (s?(ua)+)? over some rows is a
4 x 4 min-plus matrix: from each state of the form to each, the least cost and its audit, the ASCII-least one at equal cost, as a
rope. Matrices of rows behind each other multiply. Re-Pair over all conversations' symbols gives a grammar of frequent pairs;
each rule's matrix is worked out once, bottom-up, from those of its two parts, and shared by all conversations.

Rows are sorted over the cluster, so a long conversation may lie in several parts. Of each part that shares a conversation with
another one only that conversation's matrix is known to the driver (two of a part at most); from these it tells at which states the parts meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, only, with_presence

#: States of the form: nothing yet, after s, after u, after ua. Trailing inserts that end it, by state.
STATES = range(4)
ENDS = ("", "II", "I", "")
INSERT, REROLE, DELETE = 2, 2, 3
#: Rules of the grammar at most, and how many are made from one count of pairs.
RULES, AT_ONCE = 64, 8
FIRST_RULE = 0x4E00
BLANKS = " \t\n\x0b\f\r"
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A string as a tree of shared parts, with a hash that tells equal parts."""

    __slots__ = ("hash", "left", "right", "size", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.hash = len(text), 0
            for ch in text:
                self.hash = (self.hash * _BASE + ord(ch)) % _MOD
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MOD) + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                a += [Rope(x.text[n:])] if x.size > n else []
                b += [Rope(y.text[n:])] if y.size > n else []
            elif y.text is not None or x.text is None and x.size >= y.size:
                a += [x.right, x.left]
                b.append(y)
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)


class Best(NamedTuple):
    cost: int
    audit: Rope


#: A matrix: Best or None by state before and state after.
Matrix = tuple[tuple[Best | None, ...], ...]


def _better(a: Best | None, b: Best | None) -> Best | None:
    if a is None or b is None:
        return b if a is None else a
    return b if b.cost < a.cost or b.cost == a.cost and b.audit < a.audit else a


def times(a: Matrix, b: Matrix) -> Matrix:
    def entry(row: tuple, j: int) -> Best | None:
        out = None
        for k in STATES:
            if row[k] is not None and b[k][j] is not None:
                out = _better(out, Best(row[k].cost + b[k][j].cost, row[k].audit + b[k][j].audit))
        return out

    return tuple(tuple(entry(row, j) for j in STATES) for row in a)


def after(state: int) -> int:
    """The state that follows when a user or assistant text comes, whichever is due."""
    return 3 if state == 2 else 2


def _matrix(edges: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    return tuple(tuple(min((Best(c, Rope(a)) for c, a in edges.get((i, j), ())), key=lambda x: (x.cost, str(x.audit)), default=None) for j in STATES) for i in STATES)


#: Any inserts before a row: none, one or two; more would pay for states that fewer reach.
INSERTS = _matrix({(i, j): [(INSERT * n, "I" * n)] for i in STATES for n, j in ((0, i), (1, after(i)), (2, after(after(i)))) if n < 2 or j != i})


def terminal(symbol: str) -> Matrix:
    """The matrix of one row, inserts before it included: s, u, a or x (another role), in capitals if the text is truncated; D must be deleted."""
    edges = {(i, i): [(DELETE, "D")] for i in STATES}
    if symbol != "D":
        late, role = int(symbol.isupper()), symbol.lower()
        for i in STATES:
            edges.setdefault((i, after(i)), []).append((REROLE + late, "R"))
            if role == "s" and i == 0:
                edges.setdefault((0, 1), []).append((late, "K"))
            if role in "ua" and (role == "a") == (i == 2):
                edges[i, after(i)].append((late, "K"))
    return times(INSERTS, _matrix(edges))


class Grammar:
    """Rules (new symbol, pair) in the order in which Re-Pair made them, and the matrices of all symbols."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.matrices = {s: terminal(s) for s in "suaxSUAXD"}
        for new, pair in rules:  # a rule's parts are older than itself
            self.matrices[new] = times(self.matrices[pair[0]], self.matrices[pair[1]])
        self.whole = lru_cache(1 << 14)(self._whole)

    def compress(self, symbols: str) -> str:
        for new, pair in self.rules:
            symbols = symbols.replace(pair, new)
        return symbols

    def row(self, symbols: str, state: int) -> tuple[Best | None, ...]:
        """From one state to each, over all symbols."""
        now: Matrix = (tuple(Best(0, Rope("")) if j == state else None for j in STATES),)
        for s in self.compress(symbols):
            now = times(now, self.matrices[s])
        return now[0]

    def _whole(self, symbols: str) -> tuple[int, str]:
        """Least cost and audit of a whole conversation."""
        best = None
        for x, end in zip(self.row(symbols, 0), ENDS, strict=True):
            if x is not None:
                best = _better(best, Best(x.cost + INSERT * len(end), x.audit + Rope(end)))
        return best.cost, str(best.audit)

    def part(self, symbols: str) -> tuple[list[int], list[int]]:
        """Costs from each state to each (-1: no way), and which audit is the how-manieth of those from its state."""
        costs, ranks = [], []
        for i in STATES:
            row = self.row(symbols, i)
            costs += [-1 if x is None else x.cost for x in row]
            ranks += [sum(1 for y in row if y is not None and x is not None and y.audit < x.audit) for x in row]
        return costs, ranks


def meet(parts: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """States before and after each part of one conversation on the cheapest way, the ASCII-least one at equal cost.

    Audits of one part from one state to two others differ before either ends, as each ends with an edit of the last row; so the
    first part where two ways part decides.
    """
    ahead = [[INSERT * len(e) for e in ENDS]]
    for costs, _ in reversed(parts):
        ahead.append([min(costs[4 * i + j] + ahead[-1][j] for j in STATES if costs[4 * i + j] >= 0) for i in STATES])
    out, state = [], 0
    for k, (costs, ranks) in enumerate(parts):
        rest = ahead[len(parts) - k - 1]
        least = ahead[len(parts) - k][state]
        nxt = min((j for j in STATES if costs[4 * state + j] >= 0 and costs[4 * state + j] + rest[j] == least), key=lambda j: ranks[4 * state + j])
        out.append((state, nxt))
        state = nxt
    return out


def _pairs(seqs: DataFrame) -> list[tuple[str, int]]:
    """The most frequent pairs of neighbouring symbols."""
    at = F.sequence(F.lit(1), F.length("symbols") - 1)
    pairs = seqs.filter("length(symbols) > 1").select("n", F.explode(F.transform(at, lambda i: F.substring(F.col("symbols"), i, F.lit(2)))).alias("pair"))
    top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "pair").limit(4 * AT_ONCE)
    return [(r[0], r[1]) for r in top.collect()]


def learn(sequences: DataFrame, rules: int = RULES) -> list[tuple[str, str]]:
    """Re-Pair over the column `symbols`: the most frequent pair becomes a symbol, again and again, until none comes twice or there are
    `rules`. One count of pairs gives several rules where their symbols don't meet."""
    base = durable(sequences.groupBy("symbols").agg(F.count("*").alias("n")))
    made: list[tuple[str, str]] = []
    now = base
    while len(made) < rules:
        used: set[str] = set()
        found = []
        for pair, _ in _pairs(now):
            if not used & set(pair) and len(found) < min(AT_ONCE, rules - len(made)):
                found.append(pair)
                used |= set(pair)
        if not found:
            break
        for pair in found:
            made.append((chr(FIRST_RULE + len(made)), pair))
            now = now.withColumn("symbols", F.replace("symbols", F.lit(pair), F.lit(made[-1][0])))
    return made


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, over the cluster: conv_id, turn, role, text, copies, fault (0 none, 1 blank, 2 duplicate, 3 truncated), part.

    Equal rows are one with a count. Rows of one turn go by role and text hash. `fault` is the first copy's.
    """
    same = durable(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    said = [F.xxhash64("role", "text"), F.hash("text", "role")]
    order = F.struct(F.col("turn").isNotNull(), "turn")
    keyed = same.select("*", said[0].alias("_h1"), said[1].alias("_h2"), order.alias("_order"), F.xxhash64("conv_id", *said).alias("_said"))
    seen = keyed.groupBy("conv_id", "_h1", "_h2").agg(F.min("_order").alias("_first"), F.max("_order").alias("_last")).filter("_first < _last")
    seen = durable(seen.select(F.col("conv_id").alias("_conv"), F.col("_h1").alias("_s1"), F.col("_h2").alias("_s2"), "_first"))
    marked = with_presence(keyed, F.col("_said"), seen.select(F.xxhash64("_conv", "_s1", "_s2")), "_maybe")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h1") == F.col("_s1")) & (F.col("_h2") == F.col("_s2"))
    columns = ["conv_id", "turn", "role", "text", "copies", "_h1"]
    again = marked.filter("_maybe").join(seen, on, "left").select(*columns, F.coalesce(F.col("_order") > F.col("_first"), F.lit(False)).alias("_again"))
    both = marked.filter("not _maybe").select(*columns, F.lit(False).alias("_again")).union(again)
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", 1).when(F.col("_again"), 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    keys = ["conv_id", "turn", "role", "_h1"]
    placed = both.withColumn("fault", fault).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return durable(placed.select("conv_id", "turn", "role", "text", "copies", "fault")).withColumn("part", F.spark_partition_id())


def symbol(role: str, fault: int) -> str:
    s = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "D" if fault in (1, 2) else s.upper() if fault == 3 else s


class Segment:
    """The rows of one conversation in one part, as they come."""

    def __init__(self, part: int, conv_id: int | None, texts: bool) -> None:
        self.part, self.conv_id, self.texts = part, conv_id, texts
        self.symbols: list[str] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first: str | None = None
        self.last: str | None = None
        self.low: int | None = None
        self.high: int | None = None
        self.rows: list[tuple[str, str, int]] = []

    def add(self, turn: int | None, role: str, text: str | None, copies: int, fault: int) -> None:
        more = fault if fault == 1 else 2
        self.symbols += [symbol(role, fault), "D" * (copies - 1)]
        self.faults[fault] += 1
        self.faults[more] += copies - 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # a role after itself
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.texts:
            self.rows.append((role, text, copies))

    def repaired(self, audit: str, state: int) -> list[str]:
        """Lines of this part, edited as `audit` says from `state` on."""
        out, rows = [], iter(x for role, text, copies in self.rows for x in [(role, text)] * copies)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            nxt = 1 if edit == "K" and role[:1] == "s" else after(state)
            out.append(f"{role if edit == 'K' else ('user', 'assistant')[nxt - 2]}:{text}")
            state = nxt
        return out


def segments(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[Segment]:
    now = None
    for b in batches:
        text = b.column("text").to_pylist() if texts else [None] * len(b)
        for part, conv, turn, role, copies, fault, x in zip(*(b.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "copies", "fault")), text, strict=True):
            if now is None or (now.part, now.conv_id) != (part, conv):
                if now is not None:
                    yield now
                now = Segment(part, conv, texts)
            now.add(turn, role, x, copies, fault)
    if now is not None:
        yield now


_SYMBOLS = "part int, conv_id long, symbols string, at_edge boolean"


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of each conversation in this part; `at_edge` for the first and the last one."""
    held: list[Segment] = []
    first = True

    def rows(last: bool) -> pa.RecordBatch:
        nonlocal first
        columns = [[s.part for s in held], [s.conv_id for s in held], ["".join(s.symbols) for s in held], [first and i == 0 or last and i == len(held) - 1 for i in range(len(held))]]
        first = False
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["part", "conv_id", "symbols", "at_edge"])

    for s in segments(batches, texts=False):
        if len(held) >= 1000:
            yield rows(last=False)
            held = []
        held.append(s)
    if held:
        yield rows(last=True)


_PARTS = "conv_id long, part int, alone boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, audit string, lines long, repaired string"


def _repair(rules: list[tuple[str, str]], joints: dict[tuple, tuple[int, int, bool]]):
    """Edits each conversation, or the part of it that lies here: `joints` has states before and after, and whether it is the last part, of those in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, out = Grammar(rules), []
        names = [f.split()[0] for f in _PARTS.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in _PARTS.split(", ")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        size = 0
        for s in segments(batches, texts=True):
            symbols, joint, state = "".join(s.symbols), joints.get((s.part, s.conv_id)), 0
            if joint is None:
                cost, audit = grammar.whole(symbols)
            else:
                state, nxt, ends = joint
                x = grammar.row(symbols, state)[nxt]
                end = ENDS[nxt] if ends else ""
                cost, audit = x.cost + INSERT * len(end), str(x.audit) + end
            lines = s.repaired(audit, state)
            text = "\n".join(lines)
            if joint is None:
                text = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((s.conv_id, s.part, joint is None, s.faults[1], s.faults[2], s.faults[3], s.illegal, s.first, s.last, s.low, s.high, s.turns, cost, audit, len(lines), text))
            size += len(text) + len(audit) + 100
            if size > 1 << 22:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each conversation's parts, which come in order; of the repaired text only the digest is kept."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    now: dict[str, Any] | None = None

    def done() -> pa.RecordBatch:
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        row = now | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["digest"].hexdigest()}
        return pa.RecordBatch.from_arrays([pa.array([row[n]], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names], names=names)

    for b in batches:
        for i in range(len(b)):
            r = b.slice(i, 1).to_pylist()[0]
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield done()
                now = r | {"digest": hashlib.sha256(r["repaired"].encode("utf-8", "surrogatepass")), "audit": [r["audit"]]}
                continue
            now["illegal"] += r["illegal"] + (now["last"] + r["first"] not in ("su", "ua", "au"))
            if r["low"] is not None:
                now["turns"] += r["turns"] - (r["low"] == now["high"])
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            for c in ("blank", "duplicate", "truncated", "cost"):
                now[c] += r[c]
            if r["lines"]:
                now["digest"].update((b"\n" if now["lines"] else b"") + r["repaired"].encode("utf-8", "surrogatepass"))
            now["lines"] += r["lines"]
            now["last"] = r["last"]
            now["audit"].append(r["audit"])
    if now is not None:
        yield done()


def repair(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `rows` (conv_id, turn, role, text, copies).

    A row with `copies` is so many equal rows in a row; one with 0 is left out, but its conversation has a result: zeros, an empty audit and
    the hash of an empty text if no row is left. Null roles and texts count as one space; a null conv_id is a conversation of its own. A role that
    begins with none of s, u, a can't be kept. Further columns play no part.
    """
    clean = only(rows, "conv_id", "turn", "role", "text", "copies").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    placed = sorted_rows(clean.filter("copies > 0"))
    found = durable(placed.select("part", "conv_id", "turn", "role", "copies", "fault").mapInArrow(_symbol_rows, _SYMBOLS))
    made = learn(found.select("symbols"), rules)

    edges: dict[int | None, list] = {}
    for r in found.filter("at_edge").select("part", "conv_id").collect():  # two of a part at most
        edges.setdefault(r["conv_id"], []).append(r["part"])
    shared = [(p, c) for c, parts in edges.items() if len(parts) > 1 for p in parts]
    joints: dict[tuple, tuple[int, int, bool]] = {}
    if shared:
        spans = found.filter("at_edge").join(F.broadcast(found.sparkSession.createDataFrame(shared, "_part int, _conv long")), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
        table: dict[int | None, list] = {}
        for part, conv, costs, ranks in spans.select("part", "conv_id", "symbols").mapInArrow(_matrices(made), "part int, conv_id long, costs array<long>, ranks array<long>").collect():
            table.setdefault(conv, []).append((part, costs, ranks))
        for conv, parts in table.items():
            parts.sort()
            for k, (part, (i, j)) in enumerate(zip([p[0] for p in parts], meet([(p[1], p[2]) for p in parts]), strict=True)):
                joints[part, conv] = (i, j, k == len(parts) - 1)

    parts = placed.mapInArrow(_repair(made, joints), _PARTS)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    if joints:
        parts = durable(parts)
    whole = parts.filter("alone").select("conv_id", gaps.alias("gaps"), *counts, F.col("repaired").alias("repaired_sha256"))
    if joints:
        whole = whole.union(parts.filter("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined, _RESULT))
    all_ids = clean.groupBy(F.col("conv_id").alias("_id")).agg(F.max("copies").alias("_most")).filter("coalesce(_most, 0) <= 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", *counts[:-1])]
    return whole.union(all_ids.select(F.col("_id").alias("conv_id"), *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")))


def _matrices(rules: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for b in batches:
            made = [grammar.part(s) for s in b.column("symbols").to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("conv_id"), pa.array([m[0] for m in made], longs), pa.array([m[1] for m in made], longs)], names=["part", "conv_id", "costs", "ranks"])

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) after faults that crc32 of `conv_id:turn` picks: of twenty rows one is dropped, one emptied, one loses
    its stops, one comes twice, one becomes the user's."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), (F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn"))) % 20).alias("_fault"))
    fault: Column = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
