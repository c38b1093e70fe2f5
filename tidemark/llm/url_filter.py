"""URL filters: a rule table first, then a logistic regression on hashed character n-grams.

The model is trained on the driver from a small table of labelled URLs of a fixed size: sites written out in
`url_table`, and names composed by `composed_urls` from lists of words, so every run gives the same weights. Scoring takes whole batches: n-grams
of all hosts and paths are hashed at once and summed as one sparse product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_table
from .common import only

#: (pattern, action): the host up to the first "/", and with it the start of the path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
BUCKETS, GRAMS, PATH_WEIGHT, THRESHOLD = 1 << 14, (3, 4, 5), 0.3, 0.5

# Words of the training table's sites and paths. The last line of WANTED holds words that look like unwanted ones.
UNWANTED = """casino poker slots betting bets jackpot roulette blackjack bingo gambling lottery porn xxx sexy sexcam adult nude webcams escort hookup fetish
    viagra cialis pharma pills meds steroids weightloss payday loans debtfix forex crypto doubler ads adserver adclick banners popup tracker pixel affiliate
    clickbait spam linkfarm seo backlinks malware phishing warez crack keygen torrents pirate cheats replica counterfeit prizes winner giveaway freegift""".split()
WANTED = """library museum university college school council city town village county parliament ministry court law review journal press gazette times herald news
    weather climate energy water river forest mountain garden farm bakery kitchen recipes bread coffee travel railway harbour airport theatre music orchestra
    opera poetry novel books chess cycling football hiking sailing history archive heritage science physics chemistry biology astronomy statistics data docs wiki
    software python linux health hospital clinic charity church trust foundation photo design craft pottery textile gov edu standards
    sussex essex alphabet betty winter windows pillow cameron campus adelaide advent address analysis therapist cocktail class hackney torrential loanwords""".split()
NEUTRAL = "online club shop world hub zone direct my the go best top house point live day new group".split()
ENDINGS = ["com", "org", "net", "info", "co.uk", "io", "com", "net", "de", "fr", "eu"]
PATHS = ["/", "/about", "/index.html", "/", "/p/12", "/a/b", "/2021/05/title", ""]
UNWANTED_PATHS = ["/click/1", "/win/now", "/free/bonus", "/aff/77", "/track/px.gif", "/ads/show"]
WANTED_PATHS = ["/docs/guide", "/news/2020/08", "/research/paper.pdf", "/events", "/contact", "/history"]
SITES = (5, 6)  # of each wanted and unwanted word
#: Characters of URLs hashed at a time; a longer URL is hashed alone.
AT_ONCE = 1 << 17


def composed_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): so many names for each word, joined with another of its kind or a neutral one.

    One path in four is of its site's kind; the others are plain, as are endings, and decide nothing.
    """
    out = []
    for label, words, own in ((1, UNWANTED, UNWANTED_PATHS), (0, WANTED, WANTED_PATHS)):
        for i, word in enumerate(words):
            for j in range(SITES[label]):
                other = words[(i * (j + 2) + 7 * j + 3) % len(words)] if j % 2 else NEUTRAL[(3 * i + 5 * j) % len(NEUTRAL)]
                first, second = (other, word) if (i + j) % 3 == 0 else (word, other)
                name = first + ("-", "", "", str(i % 9 + 1))[(i + j) % 4] + second
                host = ("", "www.", "", "m.", "blog.")[(i + 2 * j) % 5] + f"{name}.{ENDINGS[(i + 4 * j) % len(ENDINGS)]}"
                out.append((host, own[i % len(own)] if j == 3 else PATHS[(i + 3 * j) % len(PATHS)], label))
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """The training table: sites written out, and composed names."""
    return url_table.rows() + composed_urls()


def ngrams(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the n-grams of all texts, a bucket once for each row; a row's values have length one."""
    framed = [f"^{t}$" for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in framed], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # code points to the text's end
    found = []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 1469598103934665603 + 31 * seed + n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        found.append(row[at] * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    row, bucket = np.divmod(pairs, BUCKETS)
    return row, bucket, 1 / np.sqrt(np.bincount(row, minlength=len(texts)))[row]


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of hosts and paths; a path weighs less than its host."""
    host, path = ngrams(hosts, 0), ngrams(paths, 1)
    return np.concatenate([host[0], path[0]]), np.concatenate([host[1], path[1]]), np.concatenate([host[2], PATH_WEIGHT * path[2]])


def train(rows: list[tuple[str, str, int]] | None = None, l2: float = 0.02, steps: int = 12) -> np.ndarray:
    """Weights of the buckets, then the bias: Newton steps in the space of the rows, of which there are few."""
    rows = labelled_urls() if rows is None else rows
    x = np.zeros((len(rows), BUCKETS + 1))
    row, bucket, value = features([r[0] for r in rows], [r[1] for r in rows])
    np.add.at(x, (row, bucket), value)
    x[:, BUCKETS] = 1
    y, kernel, a = np.array([r[2] for r in rows], float), x @ x.T, np.zeros(len(rows))
    for _ in range(steps):
        f = kernel @ a
        p = 1 / (1 + np.exp(-f))
        v = np.maximum(p * (1 - p), 1e-6)
        a = np.linalg.solve(kernel + l2 * np.diag(1 / v), f + (y - p) / v)
    return x.T @ a


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Odds in (0, 1) that each URL is unwanted."""
    if not hosts:
        return np.zeros(0)
    row, bucket, value = features(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, weights[bucket] * value, len(hosts)) + weights[BUCKETS])))


def scorer(weights: np.ndarray):
    @F.pandas_udf("double")
    def unwanted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            h, p = hosts.tolist(), paths.tolist()
            group = (hosts.str.len() + paths.str.len() + 4).to_numpy(np.int64).cumsum() // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(h)]
            yield pd.Series(np.concatenate([np.zeros(0), *(scores(weights, h[i:j], p[i:j]) for i, j in zip(cuts, cuts[1:]))]))

    return unwanted


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Pattern and action of the longest rule that fits, else null."""
    found, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, action = F.when(fits, pattern).otherwise(found), F.when(fits, what).otherwise(action)
    return found, action


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, weights: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's, for every url) of every row.

    A null url, or one without "://", has an empty host and path, fits no rule and gets the
    model's verdict on the empty host. Urls of any length are judged whole. Of rules that fit, the longest wins (of
    equally long ones the last in order). Repeated rows each get their row; an empty table gives none; further columns of
    `pages` are ignored.
    """
    host, path = host_path(F.col("url"))
    at = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = at.withColumn("score", scorer(train() if weights is None else weights)("host", "path"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
