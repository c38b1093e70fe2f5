"""Substring dedup, conversation repair and hard negatives against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, hard_negatives, substring_dedup

from .test_operators import AWKWARD, DOCS, NAMES, WORD

EMPTY = hashlib.sha256(b"").hexdigest()


def windows_gone(rows, length=13):
    """doc_id and text -> words, removed words and kept words, by all windows of all rows."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def cut(df, **how):
    return sorted(((r[0], r[1], r[2], r[3]) for r in substring_dedup.cut_repeats(df, **how).select("doc_id", "n_words", "n_removed", "text").collect()), key=repr)


def with_clashes(df, names=NAMES):
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def test_substrings_are_cut_as_by_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + rng.choice(passages)[rng.randrange(4) :]
        rows.append((i if i % 41 else None, rng.choice([" ", "\n", "\x0b "]).join(w)))
    rows += rows[:5] + [(7, "another text of the same id"), (8, None), (9, "a\x85b c\x1fd " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(df) == windows_gone(rows)
    assert cut(df, length=9, seed=3) == windows_gone(rows, 9)


def test_substrings_of_awkward_tables(spark):
    assert cut(with_clashes(spark.createDataFrame(AWKWARD, DOCS), [*NAMES, "seed", "start", "spans"])) == windows_gone([(r[0], r[1]) for r in AWKWARD])
    assert cut(spark.createDataFrame([], DOCS)) == []


def test_substrings_hot_windows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 3)
    common = " ".join(f"c{i}" for i in range(20))
    rows = [(i, f"{common} " + " ".join(f"u{i}_{k}" for k in range(20)) if i % 3 else f"v{i} {common} end") for i in range(90)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == windows_gone(rows)


def test_words_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"  a b", b"x" * 50, " ".join(rng.choice(["ä", "bb", "\U0001f600c", ""]) for _ in range(200)).encode(), b"end "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, at = substring_dedup.word_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    for piece in (1, 7, 16, 33):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        again, at2 = substring_dedup.word_hashes(data, offsets)
        assert again.tolist() == whole.tolist() and at2.tolist() == at.tolist()
    words = b" ".join(texts).split()
    assert len(set(whole.tolist())) == len(set(words)) == len(set(zip(whole.tolist(), words)))


def test_equal_windows_have_equal_seeds():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 5, 4000).astype(np.uint64)
    text, start, count, seed, whole, windows = substring_dedup.stretches(words, np.array([0, 1500, 1505, 4000]), 13, 5)
    assert count.sum() == len(windows) == 1488 + 2483
    of, place = {}, 0
    for k in range(len(text)):
        for o in range(count[k]):
            at = [0, 1500, 1505][text[k]] + start[k] + o
            assert of.setdefault(tuple(words[at : at + 13]), (seed[k], windows[place])) == (seed[k], windows[place])
            place += 1


# --- conversation repair


def best_edits(rows):
    """Least cost and ASCII-least audit, lines of the repaired rows: rows (role, text, fault), all ways but the costlier to one state."""
    rank = {0: (0, "", ()), 1: None, 2: None, 3: None}

    def better(a, b):
        return b if a is None or b is not None and b[:2] < a[:2] else a

    def inserted(now):
        for _ in range(3):
            new = dict(now)
            for i, x in now.items():
                if x is not None:
                    j = 3 if i == 2 else 2
                    new[j] = better(new[j], (x[0] + 2, x[1] + "I", (*x[2], ("assistant:" if j == 3 else "user:"))))
            now = new
        return now

    now = rank
    for role, text, fault in rows:
        new = dict.fromkeys(range(4))
        for i, x in inserted(now).items():
            if x is None:
                continue
            new[i] = better(new[i], (x[0] + 3, x[1] + "D", x[2]))
            if fault in ("blank", "duplicate"):
                continue
            late, j = int(fault == "truncated"), 3 if i == 2 else 2
            new[j] = better(new[j], (x[0] + 2 + late, x[1] + "R", (*x[2], ("assistant:" if j == 3 else "user:") + text)))
            keep = {"s": 1 if i == 0 else None, "u": 2 if i != 2 else None, "a": 3 if i == 2 else None}.get(role[:1])
            if keep:
                new[keep] = better(new[keep], (x[0] + late, x[1] + "K", (*x[2], f"{role}:{text}")))
        now = new
    now = inserted(now)
    return better(now[0], now[3])


def repaired_by_hand(rows):
    """conv_id -> result; rows as the damage leaves them: (conv_id, turn, role, text, copies), of one turn in any order given."""
    convs = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        convs[conv] += [(turn, role, text)] * copies
    out = {}
    for conv, items in convs.items():
        seen, faults, done = set(), [], []
        for _, role, text in items:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            done.append((role, text, fault))
        cost, audit, lines = best_edits(done)
        turns = [t for t, _, _ in items if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROWS = "conv_id long, turn long, role string, text string, copies long"


def repaired(df, **how):
    return {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df, **how).collect()}


def random_rows(n, seed, convs):
    rng, rows, turns = random.Random(seed), [], defaultdict(int)
    for _ in range(n):
        c = rng.choice(convs)
        turns[c] += rng.choice([1, 1, 1, 2])
        rows.append((c, turns[c], rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown"]), rng.choice(["Yes.", "no", " ", "", "Why?", "Long enough!\n", f"t{rng.randrange(9)}."]), rng.choice([0, 1, 1, 1, 1, 2])))
    return rows


def test_conversations_are_repaired_at_least_cost(spark):
    rows = random_rows(900, 3, [None, *range(150)])
    want = repaired_by_hand(rows)
    for rules in (0, 3, 64):
        got = repaired(spark.createDataFrame(rows, ROWS), rules=rules)
        assert {c: got[c] for c in want} == want


def test_long_conversations_meet_over_parts(spark):
    rows = random_rows(1500, 8, [1, 2]) + [(3, 5, "user", "One.", 1)] + [(4, k, "user", "All from the user.", 1) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, ROWS)
        parts = conversation_repair.sorted_rows(df.filter("copies > 0")).select("conv_id", "part").distinct().collect()
        assert len({p for c, p in parts if c == 1}) > 1
        assert repaired(df) == repaired_by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_of_awkward_tables(spark):
    rows = [
        (1, None, "user", "First.", 1), (1, 3, "assistant", "Then.", 1),  # a null turn comes first
        (2, 1, "user", "Gone.", 0),  # no row is left
        (3, 1, " ", " ", 1),
        (None, None, "user", "Hi there", 1), (None, 2, "assistant", "Yes.", 1),
        (5, 1, "user", "Twice.", 2), (5, 1, "user", "Twice.", 1), (5, 9, "user", "Twice.", 1),
        (6, 1, "user", "a. " * 50_000, 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = repaired(with_clashes(df, [*NAMES, "part", "fault", "symbols", "_h1"]))
    want = repaired_by_hand(rows)
    want[2] = (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got == want
    assert repaired(spark.createDataFrame([(1, 1, None, None, 1), (1, None, None, None, None)], ROWS)) == {1: (0, 1, 0, 0, 0, 3, "D", EMPTY)}
    assert repaired(spark.createDataFrame([], ROWS)) == {}


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"Text {c}. More!") for c in (*range(40), None) for t in (*range(4), None)]
    got = {(r[0], r[1]): tuple(r[2:]) for r in conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    kinds = set()
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kinds.add(f)
        assert got[c, t] == ("user" if f == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(f, text), {0: 0, 3: 2}.get(f, 1))
    assert {0, 1, 2, 3, 4} < kinds


def test_ropes_compare_as_strings():
    rng = random.Random(2)

    def rope(s):
        if len(s) < 2 or rng.random() < 0.2:
            return conversation_repair.Rope(s)
        k = rng.randrange(1, len(s))
        return rope(s[:k]) + rope(s[k:])

    for _ in range(2000):
        a, b = ("".join(rng.choice("DK") for _ in range(rng.randrange(7))) for _ in range(2))
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a


def test_a_grammar_shortens_and_changes_nothing(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice(["ua", "ua", "s", "D", "uU"]) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    made = conversation_repair.learn(spark.createDataFrame([(s,) for s in seqs], "symbols string"), 24)
    grammar, plain = conversation_repair.Grammar(made), conversation_repair.Grammar([])
    assert len(made) == 24 and sum(len(grammar.compress(s)) for s in seqs) < 0.5 * sum(map(len, seqs))
    for s in seqs:
        assert grammar.whole(s) == plain.whole(s)
        for k in (0, 1, len(s) // 2):
            parts = [p for p in (s[:k], s[k:]) if p]
            ways = conversation_repair.meet([grammar.part(p) for p in parts])
            audit = "".join(str(grammar.row(p, i)[j].audit) for p, (i, j) in zip(parts, ways)) + conversation_repair.ENDS[ways[-1][1]]
            assert audit == plain.whole(s)[1]


# --- hard negatives


def mined(rows, every=10, positives=5, negatives=10):
    ready = [(k, i, y, [int(np.floor(256.0 * float(x))) for x in v]) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for k, i, y, q in ready:
        if i is None or i % every:
            continue
        most = 2**63 - 1
        scores = [(max(-most, min(most, sum(a * b for a, b in zip(q, p)))), j, z) for m, j, z, p in ready if m != k]
        pos = sorted((x for x in scores if x[2] == y), key=order)[:positives]
        for p, j, _ in pos:
            neg = sorted((x for x in scores if x[2] != y and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:negatives]
            out += [(i, j, n + 1, x[1], p, x[0]) for n, x in enumerate(neg)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def mine(df, **how):
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"anchors_per_cell": 7, "rows_per_slice": 30}])
def test_hard_negatives_as_by_brute_force(spark, how):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)], int(rng.integers(3))) for i in range(260)]
    rows += [(300 + i, None if i == 1 else [0.5, float("nan")] if i == 2 else [0.5, None] if i == 3 else [] if i == 4 else [1.0, 1.0, 1.0, 1.0, 9.0] if i == 5 else [float("inf")], None if i == 0 else 1) for i in range(7)]
    rows += rows[:3] + [(None, [1.0, 1.0, 0.5, 0.5], 2), (None, [1.0, 1.0, 0.5, 0.5], 2)]
    df = with_clashes(spark.createDataFrame(rows, VECTORS), ["uid", "q", "anchor", "slot", "block"])
    got = mine(df, **how)
    assert got == mined(rows) and len(got) > 500


def test_hard_negatives_of_wide_scores_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    for size in (1e6, 1e7):
        rows = [(i, [float(x) * size for x in rng.normal(size=3)], int(rng.integers(2))) for i in range(60)]
        got = mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        assert got == mined(rows) and got
    assert mine(spark.createDataFrame([(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [1.0, 3e38], 2)], VECTORS)) == []
    assert mine(spark.createDataFrame([], VECTORS)) == []
    assert mine(spark.createDataFrame([(1, [1.0], 1)], VECTORS)) == []
