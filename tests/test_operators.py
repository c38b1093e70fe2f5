"""Cases of single operators that SQL can't check or that the tables don't hold."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import records, urls
from tidemark.functions.text import redact, screening_excerpt
from tidemark.operators import extract, frontier, keywords, language, places, scans, search_index, signals, store, verdicts
from tidemark.operators.records import parse_measures
from tidemark.sources import bucketed, readers, sinks
from tidemark.sources.bucketed import BucketedStore
from tidemark.streaming import streams


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


EXTRACT = [
    ("<html lang='de-AT'><title> A </title><body><nav>x</nav><main>m <b>n</b></main></body>", ("m\nn", "A", "de")),
    ("<body><article><h1>Head</h1><p>one</article><p>two", ("Head\none", "Head", None)),
    ("<body><div class='x page-content'>c</div><div>d</div>", ("c", None, None)),
    ("<body><div id=sidebar>s</div><div class='cookie-bar'>k</div>text", ("text", None, None)),
    ("<header><h1>gone</h1></header><p>p", ("p", None, None)),
    ("<p>a</p><div class=ad>b</div><div class=adx>c</div>", ("a\nc", None, None)),
    ("", ("", None, None)),
    (None, ("", None, None)),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(EXTRACT)], "page_id long, html string")
    got = {r.page_id: (r.text, r.title, r.language) for r in extract.extract_content(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(EXTRACT)}
    cut = extract.extract_content(df, extract.Config(max_length=3)).filter("page_id = 1").first()
    assert cut.text == "Hea"


def test_extract_leaves_names_without_semicolon(spark):
    html = "<title>a &amp&amp; b&amp</title><body><main><p>x&amp;&amp</p><p>y &ampx; &ltz &amp;lt; &eacute;&#233;&#xe9 &no; &</p></main>"
    row = extract.extract_content(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.title, row.text) == ("a &amp& b&amp", "x&&amp\ny &ampx; &ltz &lt; ééé &no; &")


T = keywords.Term


@pytest.mark.parametrize("text, want", [("Abwärmenutzung", ["de"]), ("heat recovery plan", ["en"]), ("heat recoverys", []), ("ÉNERGIE", ["fr"]), ("énergies", []), ("ΝΌΜΟΣ νόμος", ["el"]), ("", []), (None, [])])
def test_keyword_edges(spark, text, want):
    terms = [T("s", 3.0, "de", "abwärme"), T("s", 3.0, "en", "heat recovery"), T("s", 3.0, "fr", "énergie"), T("s", 3.0, "el", "νόμος"), T("s", 3.0, "el", "νόμος")]
    df = spark.createDataFrame([(text,)], "text string")
    assert [m.lang for m in keywords.match_keywords(df, terms).first().matches] == want
    assert [m.lang for m in df.select(keywords.match_terms(F.col("text"), terms).alias("m")).first().m] == want


def test_keyword_pattern_finder_equals_automaton(monkeypatch):
    terms = [T("a", 1, "de", "ab"), T("a", 1, "de", "abc"), T("a", 1, "en", "bc"), T("a", 1, "en", "abc d")]
    texts = ["abc d", "xabcx", "bc", "abcd bc", ""]
    want = [keywords.finder(terms)(t) for t in texts]
    monkeypatch.setattr(keywords, "ahocorasick", None)
    assert [keywords.finder(terms)(t) for t in texts] == want


def test_scores_and_gates(spark):
    terms = [T("subject", 3.0, "en", "heat recovery"), T("context", 2.0, "en", "data center"), T("energy", 1.5, "en", "energy efficiency")]
    rules = keywords.Rules(exclusions=("job posting",), pairs=(("context", "subject"),), boost=("waste",), penalty=("news",))
    df = spark.createDataFrame([(0, "data center heat recovery energy efficiency"), (1, "Job Posting heat recovery"), (2, "heat recovery waste news"), (3, "data center"), (4, "news news news")], "i int, text string")
    got = {r.i: r for r in keywords.judge(keywords.score_keywords(keywords.match_keywords(df, terms), rules), rules).collect()}
    assert [got[i].score for i in range(5)] == [6.5, 0.0, 4.0, 2.0, 0.0]
    assert [got[i].passes for i in range(5)] == [True, False, False, False, False] and got[1].excluded and got[1].n_matches == 0
    assert [got[i].near_miss for i in range(5)] == [False, False, True, False, False]


def test_excerpt(spark):
    text = "a" * 9000 + "Heat" + "b" * 5000
    terms = F.array(F.lit("none"), F.lit("heat"))
    got = column(spark, [text, "short", "c" * 9000], lambda c: screening_excerpt(c, terms))
    assert got == [(text[:8000] + "\n[...]\n" + text[8000:11000])[:12500], "short", "c" * 8000]


def test_public_urls(spark):
    good = ["http://8.8.8.8/x", "https://a.org", "http://[2606:4700::1111]/", "http://172.32.0.1"]
    bad = ["ftp://a.org", "http://10.1.2.3", "http://127.0.0.1:80/", "http://user@192.168.1.1", "http://[::1]/", "http://[fe80::1]/", "http://[fd00::2]", "http://224.0.0.1", "http://0.0.0.0", "", "http://"]
    assert column(spark, good + bad, urls.is_public_url) == [True] * len(good) + [False] * len(bad)


def test_domain_ids(spark):
    hosts = {"lis.virginia.gov": "va_lis", "energy.gov": "us_energy", "www.gov.uk": "uk_gov", "www.example.com": "example_com", "a.b.west-virginia.gov": "wv_a_b", "beis.gov.uk": "uk_beis", "sub-x.gouv.fr": "sub_x"}
    assert column(spark, list(hosts), urls.domain_id) == list(hosts.values())


def test_redaction(spark):
    assert column(spark, ["sk" + "-ant-abc_1 x", "a sk" + "-" + "a" * 20, "sk" + "-short", "eyJab.eyJcd", None], redact) == ["[REDACTED] x", "a [REDACTED]", "sk" + "-short", "[REDACTED]cd", None]


def test_wcf_dates(spark):
    assert column(spark, ["/Date(1782338400000+0200)/", "/Date(1782338400000)/", "x", None, "/Date(99999999999999999)/"], records.parse_wcf_date) == ["2026-06-25", "2026-06-24", "", "", ""]


def test_extract_json(spark):
    raw = ['a ```json\n{"a": 1}\n``` b', "```\n{}\n```", ' {"a": {"b": 2}} tail }', "none", '{"open": {', None]
    assert column(spark, raw, verdicts.extract_json) == ['{"a": 1}', "{}", '{"a": {"b": 2}}', "none", '{"open": {', ""]
    assert column(spark, ["true", "Ja", "sí", "1", "2", "no", "0", None], verdicts.truth) == [True, True, True, True, True, False, False, False]
    assert column(spark, ["8/10", "15", "-5", "high", "7.9 x", None], verdicts.score) == [8, 10, 0, 0, 7, 0]


REGISTRY = [
    (0, "sweden", "Sweden", "country", "752", None, [], ["sverige"]), (1, "us", "United States", "country", "840", None, [], ["usa", "u.s."]), (2, "minnesota", "Minnesota", "us_state", None, "us", [], []),
    (3, "georgia", "Georgia", "country", "268", None, [], []), (4, "us_georgia", "Georgia (US)", "us_state", None, "us", [], ["georgia usa"]), (5, "germany", "Germany", "country", "276", None, [], ["deutschland"]),
    (6, "lower_saxony", "Lower Saxony", "subnational", None, "germany", [], []), (7, "eu", "European Union", "supranational", None, None, ["sweden", "germany", "nordic"], ["eu"]), (8, "nordic", "Nordic", "group", None, None, ["sweden", "norway"], []),
    (9, "loop_a", "Loop A", "subnational", None, "loop_b", [], []), (10, "loop_b", "Loop B", "subnational", None, "loop_a", [], []), (11, "norway", "Norway", "country", "578", None, [], []),
]
REGISTRY_SCHEMA = "seq long, slug string, name string, kind string, iso_numeric string, parent string, members array<string>, aliases array<string>"


def normal_text(text: str) -> str:
    return " ".join(text.split()).lower()


class Resolver:
    """PL-02 for one text, alias by alias."""

    def __init__(self, aliases: list[tuple[str, str]], kinds: dict[str, str], countries: dict[str, str | None]) -> None:
        self.index = dict(reversed(aliases))
        ordered = sorted(aliases, key=lambda x: -len(x[0]))
        self.words = [(re.compile(rf"\b{re.escape(a)}\b"), slug) for a, slug in ordered]
        self.kinds, self.countries = kinds, countries

    def _find(self, text: str) -> str | None:
        return self.index.get(text) or next((slug for p, slug in self.words if p.search(text)), None)

    def _same_country(self, a: str, b: str) -> bool:
        return self.countries.get(a) is not None and self.countries.get(a) == self.countries.get(b)

    def resolve(self, raw: str | None) -> str | None:
        text = normal_text(raw or "")
        if not text:
            return None
        if text in self.index:
            return self.index[text]
        outside = normal_text(re.sub(r"\([^)]*\)", " ", text))
        inside = re.search(r"\(([^)]*)\)", text)
        if inside:
            outer = self._find(outside)
            whole = normal_text(inside[1])
            inner = self._find(whole) or next((s for s in map(self._find, map(normal_text, whole.split(","))) if s), None)
            if outer and inner and self.kinds.get(inner) in places.LOCAL_KINDS and self._same_country(inner, outer):
                return inner
        text = outside or text
        if text in self.index:
            return self.index[text]
        if "," in text:
            child, country = (self._find(normal_text(p)) for p in text.split(",", 1))
            if child and country and self.countries.get(child) == country:
                return child
            if country or child:
                return country or child
        return self._find(text)


def test_resolve(spark):
    want = dict([("Sweden (EU)", "sweden"), ("USA", "us"), ("Minnesota, USA", "minnesota"), ("Germany (Peine, Lower Saxony)", "lower_saxony"), ("Germany (Federal)", "germany"), ("Belarus", None), ("Stockholm, Sverige", "sweden"), ("in Deutschland today", "germany"), ("", None), ("  ", None), (None, None), ("Wallonia", None)])
    registry = spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)
    got = {r.jurisdiction: r.slug for r in places.resolve_places(spark.createDataFrame([(t,) for t in want], "jurisdiction string"), registry).collect()}
    assert got == want


def test_resolve_brute_force(spark):
    registry = spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)
    aliases = [(r.alias, r.slug) for r in places.alias_index(registry).orderBy("seq", "alias").collect()]
    kinds = {r[1]: r[3] for r in REGISTRY}
    resolver = Resolver(aliases, kinds, {r.slug: r.country for r in places.country_rollup(registry).collect()})
    draw, names = random.Random(5), [*(a for a, _ in aliases), "x", "u.s.a", "swedenx", "Österreich", ""]
    made = ["{} ({})", "({})", "{}, {}", "{} ({}, {})", "{} {}", "{}  ({}) {}", "{}, {}, {}", "the {} of {}", "{}", "({}", "{} (), {}"]
    texts = sorted({m.format(*draw.choices(names, k=m.count("{}"))) for m in made for _ in range(60)} | {t.upper() for t in names})
    got = {r.jurisdiction: r.slug for r in places.resolve_places(spark.createDataFrame([(t,) for t in texts], "jurisdiction string"), registry).collect()}
    assert got == {t: resolver.resolve(t) for t in texts} and len(set(got.values())) > 8


def test_holding_words(spark):
    names = ["new york", "york", "york, pa", "a.b.", "é", "--", "new"]
    texts = ["old new york, pa", "newyork", "a.b.c", "x -- y", "café é", "york", "", "new new"]
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {(r.text, r.name) for r in places.holding(df(texts, "text"), df(names, "name"), "text", "name").collect()}
    assert got == {(t, n) for t in texts for n in names if re.search(rf"\b{re.escape(n)}\b", t) and re.search(r"\w", n)}


def test_hierarchy(spark):
    registry = spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)
    up = {r.slug: r.country for r in places.country_rollup(registry).collect()}
    assert up["minnesota"] == "us" and up["sweden"] == "sweden" and up["loop_a"] is None and up["eu"] is None
    assert [r.slug for r in places.members_of(registry, "eu").orderBy("position").collect()] == ["sweden", "germany", "norway"]


def brute_dedupe(rows):
    urls_, titles, kept = set(), set(), []
    for seq, url, title in sorted(rows):
        key = " ".join(title.lower().split())
        if url not in urls_ and key not in titles:
            urls_.add(url)
            titles.add(key)
            kept.append(seq)
    return kept


@pytest.mark.parametrize("n, u, t", [(60, 5, 5), (300, 40, 40), (300, 300, 7)])
def test_dedupe_items(spark, n, u, t):
    rows = [(i, f"u{i * i % u}", f"Title {'  x ' * (i % 2)} {i * 7 % t}") for i in range(n)] + [(n + 1, "same", "a"), (n + 2, "same", "b"), (n + 3, "x", "B ")]
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(r.seq for r in signals.dedupe_items(df).collect()) == brute_dedupe(rows)


def brute_limit(rows, n):
    allowed, out = {}, {}
    for key, ts, i in sorted(rows):
        recent = allowed.setdefault(key, [])
        recent[:] = [t for t in recent if (ts - t).total_seconds() <= 60]
        if len(recent) >= n:
            out[i] = 60 - (ts - recent[0]).total_seconds()
        else:
            recent.append(ts)
            out[i] = None
    return out


def requests():
    start = datetime(2024, 1, 1)
    return [(i % 3, start + timedelta(seconds=(i * i * 7) % 900 + i % 5 * 5000), i) for i in range(300)]


def test_rate_limit(spark):
    df = spark.createDataFrame(requests(), "key long, ts timestamp, request_id long")
    got = {r.request_id: r.wait_s for r in signals.rate_limit(df, 3).collect()}
    assert got == pytest.approx(brute_limit(requests(), 3))


def test_links(spark):
    html = "<nav><a href='/a#x'>1</a><a href=\"b?q=1\">2</a></nav><a class=c href=https://sub.site.org/c>3</a><a href='/a'>4</a><a href='mailto:x'>5</a><a href='//other.org/d'>6</a><a href='/e.PDF'>7</a><a name=n>8</a>"
    df = spark.createDataFrame([(1, "https://www.site.org/dir/p", html), (2, "https://x.org", None)], "page_id long, url string, html string")
    got = {r.dst_url for r in frontier.extract_links(df, (".pdf",)).collect()}
    assert got == {"https://www.site.org/a", "https://www.site.org/dir/b?q=1", "https://sub.site.org/c"}


def test_measures(spark):
    html = "<h2>Austria</h2><ul><li><a href='/m1'>Law 1</a></li><li>no link</li></ul><h3> Belgium </h3><table><tr><td><a href='m2'>Law 2</a><a href='m3'>x</a></td></tr></table>"
    got = parse_measures(spark.createDataFrame([(1, "https://e.eu/d/x", "<li><a href=q>early</a>" + html)], "page_id long, url string, html string")).orderBy("position").collect()
    assert [(r.country, r.title, r.link) for r in got] == [("Austria", "Law 1", "https://e.eu/m1"), ("Belgium", "Law 2", "https://e.eu/d/m2")]


def test_search_text(spark):
    rows = [(1, "Wärmegesetz heat", "s", None, "DE"), (2, "Other", "about heat pumps", "k", "FR"), (3, "heat OR plan", "x", "y", "NEAR(1)"), (4, "grid", "heater", "z", "US")]
    df = spark.createDataFrame(rows, "seq long, policy_name string, summary string, key_requirements string, jurisdiction string")
    find = lambda q: [r.seq for r in store.search_text(df, q).collect()]
    assert set(find("heat")) == {1, 2, 3, 4} and find("heat")[:1] in ([1], [3])
    assert find("warmegesetz") == [1] and find("heat pu") == [2] and find('"heat" OR plan') == [3] and find("(") == [] and find("") == []


def test_json_reader_keeps_corrupt_records_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"url": "u", "relevance_score": 3, "other": 1}, {"url": "v"}]))
    (tmp_path / "bad.json").write_text('[{"url": ')
    good, bad = readers.read_policies_json(spark, str(tmp_path))
    assert sorted(r.url for r in good.cache().collect()) == ["u", "v"] and len(bad.collect()) == 1


def test_dimensions(spark, tmp_path):
    (tmp_path / "domains" / "eu").mkdir(parents=True)
    (tmp_path / "keywords.yaml").write_text("keywords:\n  subject:\n    weight: 3\n    terms:\n      en: [heat, waste]\nexclusions: [job]\n")
    (tmp_path / "domains" / "eu" / "fr.yaml").write_text("domains:\n  - {id: a, region: [france], base_url: 'https://a.fr'}\n")
    (tmp_path / "domains" / "_skip.yaml").write_text("domains: [{id: b}]")
    dims = readers.load_dims(spark, str(tmp_path))
    assert dims["terms"].count() == 2 and [(r.id, r.source_file, r.enabled) for r in dims["domains"].collect()] == [("a", "fr", True)] and dims["groups"].count() == 0


def stream_of(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_progress_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS type", "'s' || (user_id % 3) AS scan_id", "'d' || (user_id % 4) AS domain_id")
    rows = {}
    streams.drain(streams.stream_progress(stream_of(spark, events, tmp_path / "e")), "update", lambda b, _: rows.update({(r.scan_id, r.domain_id): tuple(r) for r in b.collect()}))
    assert sorted(rows.values()) == sorted(tuple(r) for r in signals.progress(events).collect())


def test_stream_changed(spark, tmp_path):
    rows = [(f"r{i % 5}", i, f"h{i // 10 if i % 5 else 0}") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, seq long, change_hash string")
    out = []
    for k in range(4):  # in order, a file for each ten
        df.filter(F.floor(F.col("seq") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streams.drain(streams.stream_changed(stream), "append", lambda b, _: out.extend(tuple(r) for r in b.collect()))
    assert {(r, h) for r, _, h in out} == {(r, h) for r, _, h in rows} and len(out) == 4 * 4 + 1


def test_stream_rate_limit_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(requests(), "key long, ts timestamp, request_id long")
    out = []
    streams.drain(streams.stream_rate_limit(stream_of(spark, df, tmp_path / "r", 1), 3), "append", lambda b, _: out.extend((r.request_id, r.wait_s) for r in b.collect()))
    assert dict(out) == pytest.approx(brute_limit(requests(), 3))


def test_stream_store_keeps_the_first_and_reruns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i % 7}", "x") for i in range(30)], "seq long, url string, policy_name string")
    other = spark.createDataFrame([(i, f"u{i % 4 + 5}", "y") for i in range(30)], df.schema)
    target = BucketedStore.like(df, str(tmp_path / "store"), parts=4, buckets=2)
    streams.stream_store(stream_of(spark, df, tmp_path / "p"), target)
    streams.stream_store(stream_of(spark, other, tmp_path / "q"), target)
    streams.stream_store(stream_of(spark, df, tmp_path / "r"), target)
    stored = {r.url: r.policy_name for r in target.read().collect()}
    assert stored == {f"u{i}": "x" if i < 7 else "y" for i in range(9)} and target.read().count() == 9


def test_deep_hierarchies(spark):
    rows = [(0, "land", "Land", "country", "1", None, [], [])] + [(i, f"p{i}", f"P{i}", "subnational", None, f"p{i - 1}" if i > 1 else "land", [], []) for i in range(1, 14)]
    rows += [(20 + i, f"g{i}", f"G{i}", "group", None, None, [f"g{i + 1}" if i < 9 else "p3"], []) for i in range(10)]
    registry = spark.createDataFrame(rows, REGISTRY_SCHEMA)
    up = {r.slug: r.country for r in places.country_rollup(registry).collect()}
    assert all(up[f"p{i}"] == "land" for i in range(1, 14))
    assert [r.slug for r in places.members_of(registry, "g0").collect()] == ["p3"]


def test_long_chains_of_items(spark):
    """A chain decides two items a round, and mustn't take a round for each two."""
    for n in (104, 100_000):
        rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(n)]
        df = spark.createDataFrame(pd.DataFrame(rows, columns=["seq", "url", "title"]))
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        assert sorted(r.seq for r in signals.dedupe_items(df).collect()) == brute_dedupe(rows)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 400


def test_nulls_are_values_of_items(spark):
    rows = [(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "u", None), (5, "v", None), (6, "w", "A ")]
    assert sorted(r.seq for r in signals.dedupe_items(spark.createDataFrame(rows, "seq long, url string, title string")).collect()) == [1, 3, 4]


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_rate_limit_of_a_hot_key(spark, limit):
    rng = random.Random(limit)
    start, at, rows = datetime(2024, 1, 1), 0.0, []
    for i in range(3000):
        at += rng.choice([0, 0.25, 2, 9, 9, 30, 75]) * (0.2 if limit > 3 else 1) if i % 500 else 4000
        rows.append((None if i % 3 == 0 else rng.randrange(4), start + timedelta(seconds=at), i))
    got = {r.request_id: r.wait_s for r in signals.rate_limit(spark.createDataFrame(rows, "key long, ts timestamp, request_id long"), limit).collect()}
    want = brute_limit([(-1 if k is None else k, t, i) for k, t, i in rows], limit)
    assert got == pytest.approx(want) and 20 < sum(w is not None for w in want.values())


@pytest.mark.parametrize("small", [0, 100_000])
def test_reach_over_hubs(spark, small):
    edges = [("hub", f"p{i}") for i in range(1500)] + [(f"p{i}", f"q{i % 40}") for i in range(300)] + [("q1", "far"), ("far", "farther"), (None, "x"), ("q2", None)]
    df = spark.createDataFrame(edges, "src_url string, dst_url string")
    got = {r.url: r.depth for r in frontier.bfs_depth(df, spark.createDataFrame([("hub",), ("q1",)], "url string"), 2, small=small).collect()}
    want = {"hub": 0, "q1": 0, "far": 1, "farther": 2} | {f"p{i}": 1 for i in range(1500)} | {f"q{i}": 2 for i in range(40) if i != 1}
    assert got == want


# --- the inverted index

SEARCHED = [
    (1, "Énergie verte", "Plan pour l'énergie", "", "FR", "law"), (2, "ŁÓDŹ: ciepło", "energia odpadowa", None, "PL", "law"), (3, "Abwärme", "heat reuse of heat pumps", "heat-reuse plan", "DE", "grant"),
    (4, "Energie", None, "reuse heat", "NEAR(1)", "law"), (5, "日本語 法", "heat", "x", "JP", "law"), (6, "e\u0301nergies", "heater", "", "FR", "grant"),
]


def searched(spark, rows=SEARCHED):
    return spark.createDataFrame(rows, "seq long, policy_name string, summary string, key_requirements string, jurisdiction string, policy_type string")


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    df, path = searched(spark).cache(), str(tmp_path / "i")
    search_index.add_batch(df.filter("seq < 4"), path, 0)
    search_index.add_batch(df.filter("seq >= 4"), path, 1)
    ranks = lambda rows: [(r.seq, round(r.rank_score, 9)) for r in rows.collect()]
    expected = {"énergie": {1, 4, 6}, "Łódź": {2}, "heat-reuse": {3}, "日本語": {5}, "heat) OR (1=1": None, '"""': set(), "plan energ": {1}, "heat pu": {3}}
    for text, seqs in expected.items():
        scan = ranks(store.search_text(df, text))
        assert ranks(search_index.search_index(df, path, text)) == scan and (seqs is None or {s for s, _ in scan} == seqs)
    assert ranks(search_index.search_index(df, path, "energie", policy_type="law")) == ranks(store.search_text(df, "energie", policy_type="law"))


def test_index_tasks_grow_with_the_rows_not_with_the_session(spark, tmp_path, monkeypatch):
    most, path, before = 40, str(tmp_path / "i"), spark.conf.get("spark.sql.shuffle.partitions")
    df = searched(spark, [(i, "heat law", f"reuse of heat {i % 7}", "keep heat", "FR", "law") for i in range(300)])
    monkeypatch.setattr(search_index, "ROWS", most, raising=False)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        search_index.add_batch(df, path, 0)
        search_index.add_batch(df.filter("seq % 3 = 0"), path, 1, gone=df.filter("seq % 3 = 0 OR seq = 1").select("seq"))
        counts = search_index.phrase_counts(spark, path, [["reuse", "of", "hea"]], store.WEIGHTS)
        sent = [r["count"] for r in counts.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sent) == 299 and max(sent) <= most
        assert re.findall(r"Exchange \w+\(seq#\d+L, (\d+)\)", counts._jdf.queryExecution().executedPlan().toString()) == ["53", "53"]  # five words in each of 400 rows, 101 that went
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = spark.read.parquet(f"{path}/postings/batch=0").groupBy(F.input_file_name()).count()
    assert spark.read.parquet(f"{path}/postings/batch=0").count() == 300 * 9 and max(r["count"] for r in files.collect()) <= 4 * most


def test_index_batches_replace_and_read_their_words_only(spark, tmp_path):
    path = str(tmp_path / "i")
    old, now = searched(spark), searched(spark, [r if r[0] != 4 else (4, "heat law", "new", "", "US", "law") for r in SEARCHED if r[0] != 3])
    search_index.add_batch(old, path, 0)
    for _ in range(2):  # a batch that is written again replaces itself
        search_index.add_batch(now.filter("seq = 4"), path, 1, gone=old.filter("seq IN (3, 4)").select("seq"))
    for text in ("heat", "law"):
        assert [(r.seq, round(r.rank_score, 9)) for r in search_index.search_index(now, path, text).collect()] == [(r.seq, round(r.rank_score, 9)) for r in store.search_text(now, text).collect()]
    counts = search_index.phrase_counts(spark, path, [["heat"]], store.WEIGHTS)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=)", plan), plan
    assert "StringStartsWith(token,heat)" in plan or "startswith" in plan.lower()


# --- stores in folders by key


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_change_rewrites_its_folders_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "old") for i in range(2000)], "seq long, url string, policy_name string")
    made = BucketedStore.like(df, str(tmp_path / "s"), parts=16, buckets=2)
    made.insert_new(df)
    before = files_of(tmp_path / "s")
    change = spark.createDataFrame([(5000 + i, u, "new") for i, u in enumerate(["u7", "brand-new", None])], df.schema)
    made.upsert(change)
    after = files_of(tmp_path / "s")
    folder = lambda f: f.split("store_part=")[1].split("/")[0]
    touched = {folder(f) for f in set(before) ^ set(after)} | {folder(f) for f in before if f in after and before[f] != after[f]}
    assert 1 <= len(touched) <= 2
    rows = {r.url: r.policy_name for r in made.read().collect()}
    assert len(rows) == 2001 and rows["u7"] == rows["brand-new"] == "new" and rows["u8"] == "old"
    made.insert_new(change)
    made.upsert(change)
    assert made.read().count() == 2001
    # what is joined with the store is dealt like it: there is no exchange between the join and the store's scan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = made.rest_of(made._dealt(change))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = plan[plan.index("SortMergeJoin") : plan.index("FileScan")]
    assert "Exchange" not in left and plan.count("Exchange hashpartitioning") == 1 and "PartitionFilters" in plan, plan


def test_a_reader_keeps_the_snapshot_it_has(spark, tmp_path):
    path = str(tmp_path / "queue")
    bucketed.write_snapshot(spark.range(5), path)
    reader = bucketed.read_snapshot(spark, path)
    bucketed.write_snapshot(spark.range(100, 103), path)
    assert reader.count() == 5 and sorted(r.id for r in bucketed.read_snapshot(spark, path).collect()) == [100, 101, 102]
    with pytest.raises(Exception):
        bucketed.write_snapshot(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert bucketed.read_snapshot(spark, path).count() == 3
    bucketed.write_snapshot(spark.range(1), path)
    assert len([p for p in (tmp_path / "queue").iterdir() if p.is_dir() and list(p.glob("_SUCCESS"))]) == 2


# --- streams in parts


def test_rows_in_order_by_runs_on_disk():
    rng = random.Random(3)
    rows = [(rng.randrange(50), i) for i in range(2500)]
    frames = lambda: (pd.DataFrame(rows[k : k + 130], columns=["a", "i"]) for k in range(0, len(rows), 130))
    for held in (100, 700, 10_000):
        assert [tuple(map(int, r)) for r in streams.in_order(frames(), ["a", "i"], held)] == sorted(rows)
    assert list(streams.in_order(iter(()), ["a"])) == []


def test_idle_records_are_forgotten(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    parts = [[("a", 1, "x", day(0)), ("b", 2, "y", day(9))], [("a", 3, "x", day(10)), ("b", 4, "y", day(10)), ("c", 5, None, day(10))], [("c", 6, None, day(11)), ("b", 7, "z", day(11))]]
    out, source, at = [], tmp_path / "in", str(tmp_path / "at")
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "record_id string, seq long, change_hash string, ts timestamp")
        df.write.parquet(str(source / str(k)))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(source))
        streams.drain(streams.stream_changed(stream, "5 days"), "append", lambda b, _: out.extend(tuple(r) for r in b.collect()), at)
    assert sorted(out, key=lambda r: r[1]) == [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x"), ("c", 5, None), ("b", 7, "z")]


def test_language_sends_python_small_rows(spark, monkeypatch):
    texts = ["", None, "a", "der und die " * 200, "the of \n and " * 100, "日本語😀" * 50, "x", "le les des " * 3000, "ab"]
    docs = spark.createDataFrame([(2**53 + i, t, "de" if i % 2 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    sent = language._sent(docs, ["doc_id"], "text").agg(F.max(F.length("_piece")), F.count_distinct("doc_id")).first()
    assert tuple(sent) == (language.SENT, len(texts))
    for most, rows in ((language.SENT, "10000"), (1, "3"), (5, "7")):  # texts end anywhere in a batch, or go over several
        monkeypatch.setattr(language, "SENT", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            model = language.fit(docs)
            sums = {k: sum((language.counts(t) for i, t in enumerate(texts) if t and (i % 2 == 1) == (k == "de")), start=language.counts("")) + 1 for k in ("de", "en")}
            assert model.languages == ["de", "en"] and all((model.shares[i] == language.np.log(sums[k] / sums[k].sum())).all() for i, k in enumerate(("de", "en")))
            got = {r.doc_id: (r.language, r.score) for r in language.score_rows(docs.drop("lang"), model).collect()}
            want = {r.doc_id: (r.f.language, r.f.score) for r in docs.select("doc_id", language.score(F.col("text"), model).alias("f")).collect()}
            assert got == want and len(got) == len(texts)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_language_of_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) > 50")
    model = language.fit(docs.filter("doc_id % 5 <> 0"))
    held = docs.filter("doc_id % 5 = 0").select(F.avg((language.detect(F.col("text"), model) == F.col("lang")).cast("int"))).first()[0]
    assert held > 0.98
    long = " ".join(r.text for r in docs.filter("lang = 'de'").limit(40).collect())
    assert (language.counts(long).sum(), language.counts("").sum(), language.counts(None).sum()) == (3 * len(long) - 3, 0, 0)
    piece, language.PIECE = language.PIECE, 97
    try:
        pieced = language.counts(long)
    finally:
        language.PIECE = piece
    assert (pieced == language.counts(long)).all()
    none = language.fit(docs.limit(0))
    assert docs.select(language.detect(F.col("text"), none)).distinct().collect()[0][0] is None
