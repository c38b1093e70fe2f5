"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, exact_dedup, html_extract, license_scan, mixing, packing, quality_classifier, quality_rules, simhash, url_filter, url_table

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls in any column, empty and very long texts, ties, repeated rows, texts alike but for white space.
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
    (2, "one two  three four five six seven eight\nnine ten eleven", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n", "en", None, 0),
    (None, "a text without an id that is long enough to have a dozen words", "en", "b", 3),
    (None, "a text without an id that is long enough to have a dozen words", "en", "b", 3),
    (7, "Ünï «códe» — \U0001f600 \u00a0 " * 30, "fr", "b", 4),
    (8, " ".join(f"w{i % 977}" for i in range(60_000)), "de", "c", 5),
    (9, "same " * 400, "de", "c", 5),
    (10, "short", "", "", 1),
]
NAMES = ["_key", "key", "fp", "size", "length", "group", "shard", "score", "row_key", "_maybe", "digest", "kept", "piece"]


def awkward(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    for n in NAMES:  # further columns with names that clash
        df = df.withColumn(n, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = [sum(xxhash.xxh64_intdigest(g, seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def components(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return sorted(((doc, f"{p:016x}", least.get(x)) for (doc, _), p, x in zip(rows, prints, label)), key=repr)


@pytest.mark.parametrize("bucket", [512, 1])
def test_simhash_matches_brute_force(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    # variants of a long text, so that chains of near fingerprints and dense buckets come up
    base = max((t for _, t in rows), key=lambda t: len(t or ""))[:6000].split()
    rows += [(10_000 + i, " ".join(w + "x" * (k == 37 * i % len(base)) for k, w in enumerate(base))) for i in range(25)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket).collect()
    assert sorted(map(tuple, got), key=repr) == components(rows)


@pytest.mark.parametrize("stage", [simhash.keep_one, exact_dedup.keep_first, quality_rules.keep_good, mixing.mixed_documents])
def test_stages_leave_other_columns_alone(spark, stage):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", 5) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    for n in (*NAMES, "_row_key", "_doc", "_id", "_turn", "_text", "_rows"):
        df = df.withColumn(n, F.lit("x"))
    out = stage(df)
    got = out.collect()
    assert out.columns == df.columns and got
    assert all(r[n] == "x" for r in got for n in df.columns[5:])


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == components([(r[0], r[1]) for r in AWKWARD])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id in (1, 2, 3, 4, 5)").collect()) == [1, 1, 3]


def test_chain_condition_never_loses_a_pair(spark):
    rng = np.random.default_rng(7)
    flips = [int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3) for _ in range(300)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in flips], "d long")
    assert df.filter(simhash.first_slot(F.col("d")).isNull()).count() == 0


def test_chains_prune_candidates_before_the_hamming_test(spark):
    """Of pairs with one equal segment, most leave a budget on the way; what stays holds every near pair."""
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64)]
    # an equal first segment, and up to ten other bits that differ
    fps = sorted({b ^ int(sum(1 << int(k) for k in rng.choice(np.arange(16, 63), n, replace=False))) for b in base for n in rng.integers(0, 11, 80)})
    members = simhash.slotted(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = [(r.u, r.v, r["diff"]) for r in simhash.candidates(members).select("u", "v", "diff").distinct().collect()]
    signed = lambda d: d & ((1 << 64) - 1)
    pairs = [(a, b, signed(a ^ b)) for i, a in enumerate(fps) for b in fps[i + 1 :]]
    equal = [p for p in pairs if any(not (p[2] >> 16 * i) & 0xFFFF for i in range(4))]

    def chain(d, start):
        parts = [((d >> 16 * ((start + k) % 4)) & 0xFFFF).bit_count() for k in range(3)]
        return parts[0] == 0 and sum(parts[:2]) <= 1 and sum(parts) <= 2

    want = {(a, b) for a, b, d in pairs if any(chain(d, i) for i in range(4))}
    assert {(a, b) for a, b, _ in got} == want
    near = {(a, b) for a, b, d in pairs if d.bit_count() <= 3}
    assert near < want and len(want) < len(equal) / 3  # dropped before the Hamming test
    assert any(signed(d).bit_count() > 3 for _, _, d in got)  # and the test has something left to drop


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(rows, got):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append(doc)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = min(known, default=None), True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr)


def test_exact_dedup(spark, sf):
    rows = [(r[0], r[1]) for r in AWKWARD]
    got = exact_dedup.exact_duplicates(awkward(spark)).collect()
    check_exact(rows, got)
    shas = {hashlib.sha256(normal(t).encode()).hexdigest() for _, t in rows}
    assert {r.text_sha256 for r in got} == shas
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    kept = exact_dedup.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == len(shas)


def test_exact_dedup_chains_collisions(spark):
    """With keys and digests that all collide, whole texts decide."""
    rows = [(i, f"t{i % 7}") for i in range(40)]
    weak = (lambda c: F.lit(5).cast("long"), lambda c: F.lit(b"x"))
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, weak).collect()
    check_exact(rows, got)


def test_directory_splits_overfull_buckets(spark):
    """Buckets are those of an extendible hash table that takes the keys one by one."""
    rng = np.random.default_rng(6)
    # a third of the keys share their first 20 bits, so one place must split far deeper than the others
    keys = {int(k) for k in rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)} | {(0x5A5A5 << 43) + int(k) for k in rng.integers(0, 1 << 43, 1000)}
    bits64 = {k: f"{k & ((1 << 64) - 1):064b}" for k in keys}
    want, todo = {}, [""]
    while todo:
        prefix = todo.pop()
        inside = [k for k in keys if bits64[k].startswith(prefix)]
        if len(inside) > 100:
            todo += [prefix + "0", prefix + "1"]
        else:
            want |= dict.fromkeys(inside, prefix)
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    slots, bits = exact_dedup.directory(entries, 100)
    got = entries.withColumn("slot", exact_dedup.leading("key", bits)).join(slots, "slot").collect()
    assert {r.key: f"{r.bucket:0{bits}b}"[: r.depth] for r in got} == want
    assert max(len(p) for p in want.values()) > 20


def test_exact_dedup_reads_the_index(spark):
    """Groups come from the stored index: without an entry there, its rows aren't found."""
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    rows = exact_dedup.hashed(df)
    index = exact_dedup.build_index(rows, 2)
    assert index.select("bucket").distinct().count() > 1
    gone = index.filter("keep_id <> 3")
    got = exact_dedup._decide(df, rows, gone, exact_dedup.HASHES).collect()
    assert {r.doc_id % 5 for r in got} == {0, 1, 2, 4} and len(got) == 16


def test_exact_dedup_of_many_copies(spark):
    rows = [(i, f"same  text\t{'x' * 50}" if i % 3 == 0 else f"same text {'x' * 50}" if i % 3 == 1 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    check_exact(rows, exact_dedup.exact_duplicates(df, 64).collect())
    assert exact_dedup.keep_first(df).count() == 1001


def test_plan_places_every_item_without_gaps():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.choice([10, 31, 1024]))
        counts = Counter(rng.integers(1, capacity + 1, rng.integers(1, 400)).tolist())
        runs, bins = packing.plan(counts, capacity)
        placed, seen = defaultdict(list), Counter()
        for length, rank, n, first, offset in runs:
            assert rank == seen[length]
            seen[length] += n
            for i in range(n):
                placed[first + i].append((offset, length))
        assert seen == counts and sorted(placed) == list(range(bins))
        for items in placed.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2


def one_by_one(counts, capacity):
    """Sequences of greedy matching and best fit, item by item."""
    items = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    large, rooms = [n for n in items if 3 * n > capacity], []
    while large:
        a = large.pop(0)
        b = next((n for n in large if n <= capacity - a), None)
        if b is not None:
            large.remove(b)
        rooms.append(capacity - a - (b or 0))
    for n in (n for n in items if 3 * n <= capacity):
        at = min((r for r in rooms if r >= n), default=None)
        if at is None:
            at = capacity
        else:
            rooms.remove(at)
        rooms.append(at - n)
    return len(rooms)


def test_plan_is_greedy_matching_and_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(80):
        capacity = int(rng.choice([30, 100, 1024]))
        counts = Counter((1 + rng.integers(0, capacity, rng.integers(1, 300)) ** rng.choice([1, 2]) % capacity).tolist())
        bins = packing.plan(counts, capacity)[1]
        least = -(-sum(n * k for n, k in counts.items()) // capacity)
        assert least <= bins <= one_by_one(counts, capacity) + 1 and bins <= 1.5 * least + 1


def test_other_tokenizer_files_keep_their_own_ids(tmp_path):
    """A file that isn't a plain byte-level BPE is run by the library."""
    import json

    from tokenizers import Tokenizer

    with open(TOKENIZER) as f:
        spec = json.load(f)
    assert packing._is_plain(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    text = "Some Words, in A text"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(path)([text])[0], "<u4").tolist() == want != np.frombuffer(packing.encoder(TOKENIZER)([text])[0], "<u4").tolist()


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [(r[0], r[1]) for r in AWKWARD] + [(20, "a  b\n c <|endoftext|> it's 12,345 «é»"), (21, "x "), (22, " y")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0
    assert packing.pack_documents(awkward(spark), TOKENIZER).select("doc_id").distinct().count() == 10


def test_url_rules_and_model(spark):
    urls = [("https://a.example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("HTTP://WWW.Example.COM/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("x://b.net/es/9", "b.net", "/es/9", "net/es/", "block"), ("http://b.net/fr/#t", "b.net", "/fr/", "net/fr/", "block"), ("http://q.com", "q.com", "", None, "allow"), ("http://q.com/a/b", "q.com", "/a/b", "com/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://lucky-casino-slots.org/win", "lucky-casino-slots.org", "/win", None, "block"), ("http://county-library.org/en/4", "county-library.org", "/en/4", None, "allow"), ("a://b://c.com/d", "b:", "//c.com/d", None, "allow")]
    pages = spark.createDataFrame([(i, u[0], "h", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0)).count() == 0
    twice = url_filter.judge(pages.union(pages)).collect()
    assert Counter((r.page_id, r.verdict) for r in twice) == Counter([(i, u[4]) for i, u in enumerate(urls)] * 2)
    long = spark.createDataFrame([(1, "http://free-casino.org/" + "a/" * 200_000), (2, "http://" + "county-library." * 5_000 + "org/")], "page_id long, url string")
    assert {r.page_id: (r.verdict, len(r.host), len(r.path)) for r in url_filter.judge(long).collect()} == {1: ("block", 15, 400_001), 2: ("allow", 75_003, 1)}


def test_url_model_finds_sites_left_out():
    """Written-out sites left out of the table, many with words that no other row has: how many are judged right."""
    rows, made = url_table.rows(), url_filter.composed_urls()
    hits = misses = alarms = kept = 0
    for fold in range(5):
        out = [zlib.crc32(r[0].encode()) % 5 == fold for r in rows]
        w = url_filter.train([r for r, x in zip(rows, out) if not x] + made)
        test = [r for r, x in zip(rows, out) if x]
        for s, (_, _, y) in zip(url_filter.scores(w, [r[0] for r in test], [r[1] for r in test]), test):
            blocked = s >= url_filter.THRESHOLD
            hits, misses, alarms, kept = hits + (blocked and y), misses + (not blocked and y), alarms + (blocked and not y), kept + (not blocked and not y)
    assert hits / (hits + misses) > 0.85 and hits / (hits + alarms) > 0.9 and kept / (kept + alarms) > 0.92


def test_url_model_equals_plain_gradient_steps():
    """An independent fit of the penalised likelihood, by gradient steps on dense columns, gives the same scores."""
    rows = url_table.rows()[::4]
    row, bucket, value = url_filter.features([r[0] for r in rows], [r[1] for r in rows])
    used, at = np.unique(bucket, return_inverse=True)
    x = np.zeros((len(rows), len(used) + 1))
    np.add.at(x, (row, at), value)
    x[:, -1] = 1
    y, w, l2 = np.array([r[2] for r in rows], float), np.zeros(len(used) + 1), 0.02
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + l2)
    for _ in range(20_000):
        w -= step * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + l2 * w)
    got = url_filter.scores(url_filter.train(rows, l2=l2), [r[0] for r in rows], [r[1] for r in rows])
    want = 1 / (1 + np.exp(-x @ w))
    assert np.allclose(got, want, atol=1e-4) and ((got >= 0.5) == (want >= 0.5)).all()


def test_url_batches_are_cut_by_characters():
    """Long URLs among short ones are scored as they are alone."""
    w = url_filter.train(url_table.rows())
    hosts = [("county-library." * (5_000 if i % 7 == 3 else 1)) + "org" for i in range(40)]
    got = next(iter(url_filter.scorer(w).func(iter([(pd.Series(hosts), pd.Series(["/x"] * 40))]))))
    assert np.allclose(got, [url_filter.scores(w, [h], ["/x"])[0] for h in hosts])
    assert len(next(iter(url_filter.scorer(w).func(iter([(pd.Series([], dtype=object), pd.Series([], dtype=object))]))))) == 0


def test_url_model_on_other_names():
    bad = ["partypoker.com", "slots4you.net", "lucky-casino-slots.org", "bestviagrapills.net", "adtracker.io", "freeporncams.com", "cheap-meds.info", "paydayloans24.com", "warezcrack.net"]
    good = ["sussex.gov.uk", "county-library.org", "essexlibrary.org", "windowsdocs.org", "en.wikipedia.org", "riverside-school.edu", "citymuseum.org", "winterforest.net", "q.com"]
    got = url_filter.scores(url_filter.train(), bad + good, ["/"] * 18) >= url_filter.THRESHOLD
    assert got.tolist() == [True] * 9 + [False] * 9


def test_url_features_are_the_ngrams():
    hosts, paths = ["aaab.com", "", "é\U0001f600x.org", "aaab.com"], ["/p", "", "/", "/p"]
    row, bucket, value = url_filter.ngrams(hosts, 0)
    for i, h in enumerate(hosts):
        grams = {f"^{h}$"[k : k + n] for n in (3, 4, 5) for k in range(len(h) + 3 - n)}
        own = set(bucket[row == i].tolist())
        assert len(own) in (len(grams), len(grams) - 1) and abs((value[row == i] ** 2).sum() - bool(grams)) < 1e-9
    assert bucket[row == 0].tolist() == bucket[row == 3].tolist()
    w = url_filter.train()
    together = url_filter.scores(w, hosts, paths)
    assert np.allclose(together, [url_filter.scores(w, [h], [p])[0] for h, p in zip(hosts, paths)])


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].score, q) for i, q in truth.items() if got[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.95
    # labels of held-out rows have no influence
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.classify(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert len(quality_classifier.classify(awkward(spark), labels).collect()) == len(AWKWARD)
    assert {r.score for r in quality_classifier.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), labels).count() == 0


def test_discriminant_matches_direct_densities(spark):
    """Scores against Gaussian densities worked out from the rows themselves, whatever the partitioning."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.union(labels.limit(40))  # repeated labels weigh as often
    texts = {r.doc_id: quality_classifier.statistics(r.text) for r in docs.collect()}
    x = {0: [], 1: []}
    for r in labels.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            x[r.quality].append(texts[r.doc_id])
    x = {c: np.array(v) for c, v in x.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    n = {c: len(v) for c, v in x.items()}
    pooled = sum(n[c] * cov[c] for c in x) / sum(n.values())
    unit = np.diag(np.diag(pooled))
    log_density = {}
    for c in x:
        s = (1 - quality_classifier.POOLED - quality_classifier.DIAGONAL) * cov[c] + quality_classifier.POOLED * pooled + quality_classifier.DIAGONAL * np.diag(np.diag(cov[c])) + quality_classifier.FLOOR**2 * unit
        off = np.array(list(texts.values())) - x[c].mean(0)
        log_density[c] = np.log(n[c]) - (np.linalg.slogdet(s)[1] + (off @ np.linalg.inv(s) * off).sum(1)) / 2
    want = dict(zip(texts, 1 / (1 + np.exp(-np.clip((log_density[1] - log_density[0]) / quality_classifier.TEMPERATURE, -500, 500)))))
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 0.02
    again = {r.doc_id: r.score for r in quality_classifier.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == got


HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\", "a\\:", "\\</turn>", "", None, "### ", ": ", "\r\n\x00é\U0001f600", "<", "\\#" * 50, "x" * 200_000]


def test_chat_round_trip(spark):
    for role in ("user", "assistant", "a: b", "\\", "x\\: ", ":", "", "r\ns"):
        for text in HARD:
            formatted, begin, end = chat_format.render(role, text or "")
            assert chat_format.parse_all(formatted * 2) == [(role, text or "")] * 2 and begin <= end
    rows = [(1, i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(HARD)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "assistant", "z"), (3, 5, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("loss_start", F.lit(2))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert len(got) == 4
    for conv, r in got.items():
        turns = [x for x in rows if x[0] == conv]
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def sainte_lague(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(25):
        n, seats = int(rng.integers(1, 12)), int(rng.integers(0, 200))
        weights = [float(rng.integers(0, 1000)) ** float(rng.choice([1, 2])) for _ in range(n)]
        caps = [int(rng.integers(0, 3 * seats + 2)) if rng.random() < 0.3 else 10**9 for _ in range(n)]
        rows += [(g, i, seats, w, c) for i, (w, c) in enumerate(zip(weights, caps))]
        if all(c == 10**9 for c in caps):
            want |= {(g, i): k for i, k in enumerate(sainte_lague(weights, seats, caps))}
    df = spark.createDataFrame(rows, "g int, i int, seats long, weight double, most long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "seats", "weight", "most", ["i"]).collect()}
    totals = defaultdict(float)
    for g, _, _, w, _ in rows:
        totals[g] += w
    assert want and all(got[k] == v for k, v in want.items() if totals[k[0]] > 0)


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").union(awkward(spark).select("doc_id", "text", "source"))
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        left, w = 1.5 * sum(sizes.values()) - sum(fixed.values()), sum(weights[s] for s in names if s not in fixed)
        target = fixed | {s: left * weights[s] / w for s in names if s not in fixed}
        over = {s: 2.0 * sizes[s] for s in names if s not in fixed and target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        fixed |= over
    taken = Counter()
    sources = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in docs.collect()}
    for r in got:
        s = sources[r.doc_id, r.size]
        taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s]
    assert all(abs(taken[s] - target[s]) <= 48 for s in names)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    mixed = mixing.mixed_documents(docs)
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_holds_the_words_of_the_selected_blocks(spark):
    rng = np.random.default_rng(4)
    sizes = {(i, s): int(n) for s in "abc" for i, n in enumerate(rng.integers(1, 400, 12))}
    texts = {(i, s): "  ".join(f"{s}{i}w{j}" for j in range(n)) for (i, s), n in sizes.items()}
    twice, both = " ".join(f"t{j}" for j in range(150)), " ".join(f"u{j}" for j in range(90))
    rows = [(i, t, s) for (i, s), t in texts.items()] + [(50, twice, "a")] * 2 + [(51, both, "b"), (51, both, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    number = lambda *parts: int(hashlib.md5("/".join(map(str, ("mix-1", *parts))).encode()).hexdigest()[:15], 16)
    taken = Counter()
    for r, (_, _, s) in ((r, x) for r in mixing.mix(df).collect() for x in rows if x[0] == r.doc_id and len(x[1].split()) == r.size and sum(len(y[1].split()) for y in rows if y[2] == x[2]) == r.source_size):
        taken[s] += r.taken / (2 if r.doc_id == 50 else 1)
    want = Counter()
    for s in "abc":
        stream = [(s, r[0], w) for r in sorted((r for r in rows if r[2] == s), key=lambda r: (number(r[0]), r[0])) for w in r[1].split()]
        blocks = -(-len(stream) // 16)
        begin = number("start", f'{{"source":"{s}"}}', 0) % blocks
        times = lambda q: [q // blocks + ((k - begin) % blocks < q % blocks) for k in range(blocks)]
        quota = next(q for q in range(2 * blocks + 1) if sum(times(q)[p // 16] for p in range(len(stream))) == taken[s])
        for p, x in enumerate(stream):
            want[x] += times(quota)[p // 16]
    got = Counter((r.source, r.doc_id, w) for r in mixing.mixed_documents(df).collect() for w in r.text.split())
    assert got == +want
    assert mixing.stretches(" a b  c\td e f ", 0, 1, 3, 5) == "a\nd e" and mixing.stretches(" a b ", 0, 0, 1, 9) == "b" and mixing.stretches("a b", 0, 0, 1, 1) == ""


def test_mix_leaves_documents_whole_but_at_the_ends_of_runs(spark, sf):
    """Of each shard at most the two documents at its run's ends are cut; all others are taken whole so many times."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: " ".join(WORD.findall(r.text or "")) for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    cut, parts = {r.doc_id for r in mixing.mix(docs).collect() if r.size and r.taken % r.size}, Counter()
    for r in mixing.mixed_documents(docs).collect():
        if " ".join(WORD.findall(r.text)) != words[r.doc_id]:
            assert r.doc_id in cut
            parts[sources[r.doc_id]] += 1
    assert cut and max(parts.values()) <= 2 and sum(parts.values()) == len(cut)


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["mit-text"].text
    words = notice.split()
    texts = {
        1: ("before " * 500 + notice + " after" * 500, ["mit"]),
        2: (" ".join(w for i, w in enumerate(words) if i % 9), ["mit"]),
        3: (" ".join(words[len(words) // 2 :]), []),
        4: ("so: Released under the MIT license. And: licensed under cc by-nc 4.0!", ["cc-by-nc-4.0", "mit"]),
        5: ("released that was under all other things the one of MIT by license", []),
        6: (None, []),
        7: ("", []),
        8: ("word " * 300_000 + "Released under the MIT License.", ["mit"]),
        9: (license_scan.TEMPLATES["bsd-3-clause-text"].text, ["bsd-3-clause"]),
        10: (license_scan.TEMPLATES["bsd-2-clause-text"].text.replace("Redistribution and", "# Redistribution\n# and"), ["bsd-2-clause"]),
        11: (license_scan.TEMPLATES["isc-text"].text, ["isc"]),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").withColumn("matches", F.lit(0))
    got = {r.doc_id: r.matches for r in license_scan.scan_documents(df).collect()}
    assert {i: [m.license for m in got[i]] for i in got} == {i: want for i, (_, want) in texts.items()}
    assert (got[1][0].first_word, got[1][0].end_word, got[1][0].coverage) == (500, 500 + len(license_scan.words_of(notice)), 1.0)
    assert license_scan.scan_documents(df.limit(0)).count() == 0
    assert Counter(r.doc_id for r in license_scan.scan_documents(awkward(spark)).collect()) == Counter(r[0] for r in AWKWARD)
    twice = license_scan.scan_documents(df.union(df)).collect()
    assert Counter((r.doc_id, str(r.matches)) for r in twice) == Counter([(i, str(m)) for i, m in got.items()] * 2)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the MIT License.", "mit"),
        ("Released under the BSD License.", "bsd"),
        ("Released under the ISC License.", "isc"),
        ("Released under the Sleepycat License.", None),
        ("Licensed under the Apache License, Version 1.1.", "apache-1.1"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Licensed under the Apache License, Version 3.0.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
        ("Licensed under CC BY 4.0.", "cc-by-4.0"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"),
        ("Licensed under CC BY-XX 4.0.", None),
        ("Licensed under CC BY 4.0 and CC BY-SA 3.0.", "cc-by-4.0,cc-by-sa-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
        ("You can read about the GNU General Public and its license, of which version 3 is new.", None),
    ],
)
def test_sibling_licences_are_told_apart(text, want):
    known = license_scan.prepare(license_scan.TEMPLATES)
    found = {known[m[0]].license for m in license_scan.scan(f"some words before. {text} and more after it", known)}
    assert ",".join(sorted(found)) == (want or "")


@pytest.mark.parametrize("text, want", [
    ("// SPDX-License-Identifier: MIT", {"mit"}), ("# SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}), ("SPDX-License-Identifier: CC-BY-SA-4.0", {"cc-by-sa-4.0"}),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", {"gpl-3.0"}), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", {"apache-2.0"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl-2.1"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"mpl-2.0"}),
    ("CC0 1.0 Universal", {"cc0-1.0"}), ("To the extent possible under law, Ann has waived all copyright and related or neighboring rights to this work.", {"cc0-1.0"}), ("Licensed under the EUPL, Version 1.2 or later", {"eupl-1.2"}),
    ("Distributed under the terms of the MIT License", {"mit"}), ("It is released under the GNU GPL v2 or later", {"gpl-2.0"}),
    ("This software is not licensed under the MIT License", set()), ("It isn't released under the MIT License", set()), ("It is not only licensed under the MIT License", {"mit"}), ("A text about the general public and its versions, under two licenses", set()),
])
def test_license_scan_finds_common_notices(text, want):
    known = license_scan.prepare(license_scan.TEMPLATES)
    assert {known[m[0]].license for m in license_scan.scan(f"Words before. {text} and after", known)} == want


def test_license_scan_is_linear_in_matches():
    import time

    known = license_scan.prepare(license_scan.TEMPLATES)
    began = time.process_time()
    assert len(license_scan.scan("under the MIT License. " * 30_000, known)) == 30_000
    assert time.process_time() - began < 20  # with the square of the matches it took minutes


def test_license_scan_keeps_every_match():
    known = license_scan.prepare(license_scan.TEMPLATES)
    spans = lambda text: sorted((known[m[0]].license, m[2], m[3]) for m in license_scan.scan(text, known))
    nc, by = "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0."
    assert spans(f"{nc} and then {by}") == [("cc-by-4.0", 10, 15), ("cc-by-nc-4.0", 1, 7)]
    assert spans(f"{nc} {by} {nc} {by}") == [("cc-by-4.0", 8, 13), ("cc-by-4.0", 21, 26), ("cc-by-nc-4.0", 1, 7), ("cc-by-nc-4.0", 14, 20)]
    full, short = license_scan.TEMPLATES["apache-2.0-header"].text, "Licensed under the Apache License, Version 2.0."
    assert [m[0] for m in spans(full + " filler" * 9 + " " + short)] == ["apache-2.0", "apache-2.0"]
    assert spans("Released under the MIT License. a b c d " * 5) == [("mit", 9 * i, 9 * i + 5) for i in range(5)]


def test_coverage_is_near_the_best_possible():
    """Coverage against the longest common subsequence, worked out in full, of altered notices."""
    rng = np.random.default_rng(9)
    known = license_scan.prepare(license_scan.TEMPLATES)
    for name in ("mit-grant", "apache-2.0-header", "gpl-3.0-header", "isc-text"):
        words = known[name].words
        for _ in range(10):
            altered = [w for w in words for w in ([w] if rng.random() > 0.05 else [] if rng.random() < 0.5 else [w, "filler"])]
            table = np.zeros((len(words) + 1, len(altered) + 1), int)
            for i, a in enumerate(words):
                for j, b in enumerate(altered):
                    table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
            assert len(license_scan.align(words, altered)) >= 0.95 * table[-1, -1]


def test_patience_alignment_is_a_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(0, 30))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(license_scan.align(a, a)) == len(a)


def counts_of(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(500 + i, *r[1:]) for i, r in enumerate(AWKWARD)] + [(600, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z", None, "a", 0), (601, "x\nx\n \ny\nx", "en", "a", 0)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(text), doc
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty(spark)).count() == 0
    assert quality_rules.apply_rules(awkward(spark)).count() == len(AWKWARD)
    assert quality_rules.keep_good(awkward(spark)).columns == awkward(spark).columns


def test_quality_rules_keep_clean_and_reject_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_rules.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


CELLS = "pool string, of_lang string, " + ", ".join(f"{f} long" for f in quality_rules.FEATURES) + ", w long"


def _fit(x):
    """Mean and covariance, not floored."""
    return x.mean(0), quality_rules.CONSISTENCY * np.cov(x.T, bias=True)


def _shrink(own, n, prior):
    share = n / (n + quality_rules.PRIOR)
    off = own[0] - prior[0]
    return share * own[0] + (1 - share) * prior[0], share * own[1] + (1 - share) * prior[1] + share * (1 - share) * np.outer(off, off)


def _far(z, estimate):
    off = z - estimate[0]
    return (off @ np.linalg.inv(estimate[1] + quality_rules.UNITS**2 * np.eye(5)) * off).sum(1)


def test_estimate_matches_numpy(spark):
    """Mean and Mahalanobis distance of a language's cells are those of the floored covariance, a group's those after shrinking."""
    rng = np.random.default_rng(1)
    z, own = rng.integers(-40, 40, (300, 5)), rng.integers(-10, 60, (30, 5))
    df = spark.createDataFrame([("l", None, *map(int, r), 1) for r in z] + [("g", "l", *map(int, r), 1) for r in own], CELLS)
    e = df.join(quality_rules._estimate(df, ["pool"]), "pool").withColumn("d", quality_rules._distance())
    got = {(r.pool, *(r[f] for f in quality_rules.FEATURES)): r.d for r in e.collect()}
    for pool, x, estimate in (("l", z, _fit(z)), ("g", own, _shrink(_fit(own), 30, _fit(z)))):
        assert all(abs(got[(pool, *map(int, r))] - w) < 1e-6 for r, w in zip(x, _far(x, estimate)))


def _mcd(z, seeds, prior=None, size=12):
    """Smallest log determinant that concentration steps on sorted distances reach from many random starts, and its estimate."""
    rng, n = np.random.default_rng(seeds), len(z)
    h = int(np.ceil(quality_rules.SHARE * n))

    def fit(x):
        estimate = _fit(x) if prior is None else _shrink(_fit(x), len(x), prior)
        return np.linalg.slogdet(estimate[1] + quality_rules.UNITS**2 * np.eye(5))[1] / 2, estimate

    best = None
    for k in range(30):
        det, estimate = fit(z[rng.choice(n, min(n, size), replace=False)] if k else z)
        last = np.inf
        while det < last - 1e-9:
            last = det
            det, estimate = fit(z[np.argsort(_far(z, estimate), kind="stable")[:h]])
        if best is None or det < best[0]:
            best = det, estimate
    return best


def test_concentration_finds_the_least_determinant(spark):
    """Languages with a fifth or a third of far rows: as small as brute force, and its centre among the good rows."""
    rng = np.random.default_rng(11)
    groups = {}
    for g, far in enumerate((0, 40, 65)):
        good = rng.normal(0, 14, (200 - far, 5)) @ np.diag([1, 2, 1, 0.5, 1])
        groups[str(g)] = np.rint(np.vstack([good, rng.normal(180, 10, (far, 5))])).astype(int)
    rows = [(g, None, *map(int, r), 1) for g, z in groups.items() for r in z]
    cells = spark.createDataFrame(rows, CELLS)
    got = {r.pool: r for r in quality_rules.concentrate(cells).collect()}
    for g, z in groups.items():
        det, (mean, _) = _mcd(z.astype(float), 1)
        assert got[g].logdet < det + 0.1  # whole bins of like distances count, so a few rows more may be fitted
        assert np.abs(np.array([got[g][f"m{i}"] for i in range(5)]) - mean).max() < 8
    again = {r.pool: r for r in quality_rules.concentrate(cells.repartition(5)).collect()}
    assert again == got


def features_of(text):
    words, chars, symbols, dup, repeated = counts_of(text)
    text = text or ""
    shouts = sum(1 for c in text if unicodedata.category(c) == "Lu" or c == "!")
    lines = sum(1 for x in text.split("\n") if WORD.search(x))
    rate = lambda x, total, scale: math.log(0.5 + scale * x / total)
    values = [math.log((chars + 250) / (words + 50)), rate(symbols, chars + 50, 1000), rate(shouts + 3, chars + 200, 1000), rate(dup, lines + 10, 100), math.sqrt(1000 * repeated / (words + 50))]
    return [math.copysign(math.floor(abs(v * quality_rules.UNITS / f) + 0.5), v) for v, f in zip(values, quality_rules.FLOORS)]


def test_every_language_and_source_has_its_own_verdict(spark, sf):
    """All verdicts of a table against brute force, group by group, also those of one or two rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    rows = [(r.doc_id, r.lang, r.source, features_of(r.text)) for r in docs.collect() if not got[r.doc_id].base_failed]
    near, checked = [], 0
    for lang in {r[1] for r in rows}:
        prior = _mcd(np.array([r[3] for r in rows if r[1] == lang]), 1)[1]
        for source in {r[2] for r in rows if r[1] == lang}:
            own = [r for r in rows if r[1:3] == (lang, source)]
            z = np.array([r[3] for r in own])
            for (doc, *_), d in zip(own, _far(z, _mcd(z, 2, prior)[1])):
                checked += 1
                if (d <= quality_rules.CUTOFF) != got[doc].kept:
                    near.append((doc, d, got[doc].distance))
    # whole bins of like distances are fitted, so a distance may differ a little
    assert checked > 150 and len({r[1:3] for r in rows}) > 40 and not near, near


def test_repeated_windows_alone_can_reject(spark):
    rng = np.random.default_rng(4)
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000)) + "." for _ in range(60)]
    words = clean[0].split()
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(clean)] + [(100, " ".join(words[:2700] + words[:295] + ["end."]), "en", "a", 0)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[100].base_failed and not got[100].kept and all(got[i].kept for i in range(60))


def test_small_groups_lean_on_their_language(spark):
    """A source's few rows don't move the language's estimate; many do, smoothly."""
    rng = np.random.default_rng(2)
    z = np.rint(rng.normal(0, 10, (400, 5))).astype(int)
    sizes = (1, 10, 50, 200, 2000)
    rows = [("l", None, *map(int, r), 1) for r in z] + [(f"g{n}", "l", 40, 0, 0, 0, 0, n) for n in sizes]
    got = {r.pool: r.m0 for r in quality_rules.concentrate(spark.createDataFrame(rows, CELLS)).collect()}
    moved = [got[f"g{n}"] for n in sizes]
    assert moved == sorted(moved) and moved[0] < 2 and 15 < moved[2] < 25 and moved[-1] > 38


PAGES = [
    ("<body><ul class=menu><li><a href=a>Home</a><li><a>News</a></ul><div id=content><h1>T</h1>a &lt;b&gt; &eacute;<p>x<b>y</b>z<div class='comments'><p>no</div></div><div class=copyright-footer>&copy;</div>", "T a <b> é xyz"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav>n</nav><header>h</header><main><h1>Head</h1><p>one<br>two<p>three</main><aside>s</aside><footer>f</footer>", "Head one two three"),
    ("<article><p>a</p><div class='ad'>buy</div><p><a href=x>only a link</a></p></article><form><p>form</p></form><p>tail", "a only a link"),
    ("<script>var t='</p><article>';</script><article>x<!-- <p>c --> y &amp;amp; z</article>", "x y &amp; z"),
    ("plain &#233;\n text", "plain é text"),
    ("", ""),
    (None, ""),
    ("<p class=notice>hide<p>show", "show"),
    ("<article><p>" + "long " * 20_000 + "</article>", " ".join(["long"] * 20_000)),
]


def test_html_extraction_joins_the_parts_of_one_text():
    one, two = "first words of the text. " * 9, "more words of the text. " * 12
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(3))
    flat = lambda *parts: " ".join(" ".join(parts).split())
    listed = flat("link 0 link 1 link 2")
    assert html_extract.main_text(f"<body><div><p>{one}</p><ul>{links}</ul><p>{two}</p></div>") == flat(one, listed, two)
    assert html_extract.main_text(f"<main><p>{one}</p><article><p>{two}</p></article><p>end of it</p></main>") == flat(one, two, "end of it")
    assert html_extract.main_text(f"<article><p>{one}</p><article><p>{two}</p></article><p>end</p></article>") == flat(one, two, "end")
    assert html_extract.main_text(f"<body><div>Home | News</div><div><p>{one}</p><p>{two}</p></div><div>\u00a9 2020 Someone</div>") == flat(one, two)


def test_html_text_is_found_by_the_distribution():
    """No tag or class tells these parts: only the sums over line blocks do."""
    long = "real words of a long paragraph that go on for a while. " * 4
    flat = lambda *parts: " ".join(" ".join(parts).split())
    notes = "".join(f"<div>reader {i}: nice post</div>" for i in range(5))
    page = f"<body><div>menu text here</div><div>one two three</div><div><h2>Title</h2><p>{long}</p><p>{long}</p><p>short end.</p></div>{notes}<div>Contact us</div>"
    assert html_extract.main_text(page) == flat("Title", long, long, "short end.")
    # the heavier of two texts that lie apart
    small = "<div>" + "a short blurb of another kind, not the text. " * 2 + "</div>"
    assert html_extract.main_text(f"<body>{small}{notes}<div><p>{long}</p><p>{long}</p></div>{notes}{small}") == flat(long, long)
    assert html_extract.surges([5, 5, 5, 300, 200, 100, 5, 5, 5, 5, 120], 100) == [(3, 6), (10, 11)]
    assert html_extract.block_sums([1, 2, 3, 4]) == [1, 3, 6, 9, 7, 4]
    assert html_extract.surges([1, 1, 60, 1, 39, 1, 1], 100) == [(2, 5)]


def test_html_articles_and_names_inside():
    long = "A sentence of the main text that goes on for a while. " * 4
    flat = lambda *parts: " ".join(" ".join(parts).split())
    aside = "<div>" + "Other words of the page. " * 32 + "</div>"
    assert html_extract.main_text(f"<body>{aside}<article><p>Hi.</p></article>{aside}") == "Hi."
    assert html_extract.main_text(f"<body><article><h2>One</h2><p>{long}</p></article>{aside}<article><p>{long}</p><p>Two.</p></article>") == flat("One", long, long, "Two.")
    for name in ("notice-of-meeting", "related-work", "content share", "news-alerts-explained"):
        assert html_extract.main_text(f"<article><p>{long}</p><div class='{name}'>{long}</div></article>") == flat(long, long), name
    for name in ("notice", "related-posts", "share-buttons", "post-comments", "ad-banner", "cookie_notice x"):
        assert html_extract.main_text(f"<article><p>{long}</p><div class='{name}'>{long}</div><p>End.</p></article>") == flat(long, "End."), name
    assert html_extract.main_text(f"<body><p>{long}</p><p>More of it, sixty characters long or so, and then it ends.</p><div>Contact: office@example.org, 12 Some Street, Some Town, phone 555</div></body>") == flat(long, "More of it, sixty characters long or so, and then it ends.")


def test_html_texts_of_the_given_pages_need_the_distribution(spark, sf, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    whole = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "surges", lambda weights, threshold: [(k := max(range(len(weights)), key=weights.__getitem__), k + 1)])
    changed = sum(a != html_extract.main_text(p) for a, p in zip(whole, pages))
    assert changed > 0.5 * len(pages)


def test_html_text_without_any_names(spark, sf):
    """The given pages with plain divs for article, menu, advert and footer."""
    import html

    right = n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        want = " ".join(html.unescape(re.sub(r"</?(?:h1|p|br)>", " ", article)).split())
        got = html_extract.main_text(re.sub(r"<(/?)(?:article|nav|footer|div)[^>]*>", r"<\1div>", r.html))
        right, n = right + (got == want), n + 1
    assert right / n > 0.95


@pytest.mark.parametrize("page", ["<div>" * 16_000 + "</span></b>" * 16_000 + "x", "<ul>" + "<div>" * 16_000 + "<li>x" * 16_000, "<p>" + "<b>" * 16_000 + "<p>x" * 16_000, "<p>" + "word " * 20 + "</p><p><a>x</a></p><p><a>x</a></p><p><a>x</a></p>" * 8_000])
def test_html_takes_linear_time(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 2


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"u{i}", h, 0) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want), i
    assert html_extract.extract(df.limit(0)).count() == 0
    assert Counter(map(tuple, html_extract.extract(df.union(df)).collect())) == Counter([tuple(r) for r in got.values()] * 2)
    broken = ["<", "<p", "<a href='", "&#xZZ;", "</p></p>", "<!--", "<script>", "<p " + "a=" * 5000, "<div>" * 3000, "<![CDATA["]
    assert all(isinstance(html_extract.main_text(x), str) for x in broken)


def test_html_extraction_of_the_given_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1].replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:h1|p|br)>", " ", article)).split())
