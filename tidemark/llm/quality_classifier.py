"""Quality scores by a regularised quadratic discriminant on transformed document statistics.

Each text gives a vector of transformed statistics (one pass, no sample). Per class,
means and covariances come from one aggregation over all labelled training rows; two
rows reach the driver. Covariances shrink towards the pooled one and its diagonal, and
their Cholesky factors are worked out once. A score is the logistic function of the
difference of the two Mahalanobis log densities plus the classes' log odds, times a
fixed temperature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, only

#: Share of the pooled covariance, share of its diagonal, floor of a standard deviation (in pooled ones), divisor of log density differences.
POOLED, DIAGONAL, FLOOR, TEMPERATURE = 0.1, 0.1, 0.05, 6.0
THRESHOLD = 0.7
#: Statistics are fitted in whole numbers of 1/STEP, so that sums don't depend on how rows are dealt.
STEP = 4096
FEATURES = ["f_words", "f_length", "f_symbols", "f_shouts", "f_upper", "f_digits", "f_distinct", "f_top", "f_adjacent", "f_lines", "f_dup_lines", "f_worst"]
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of a text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), sum(map(len, words))
    rate = lambda chosen, total, soft: log(0.5 + 1000 * chosen / (total + soft))
    marks = lambda b, which: len(b) - len(b.translate(None, which))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    worst = max((marks(x, _SYMBOLS + b"!") / (len(x) + 40) for x in lines), default=0.0)
    counts = Counter(words)
    return (
        log(50 + n),
        log((chars + 250) / (n + 50)),
        rate(marks(raw, _SYMBOLS), chars, 50),
        rate(marks(raw, b"!"), chars, 50),
        rate(marks(raw, _UPPER) + 3, chars, 200),
        rate(marks(raw, _DIGITS), chars, 50),
        log(20 + len(counts)) / log(20 + n),
        rate(max(counts.values(), default=0) + 5, n, 100),
        rate(sum(map(eq, words, words[1:])), n, 50),
        log((n + 100) / (len(lines) + 3)),
        rate(len(lines) - len(set(lines)), len(lines), 10),
        log(0.5 + 1000 * worst),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the columns FEATURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sums and sums of products of the features, exact; one aggregation of rows with `n` labels each, two rows to the driver."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    whole = rows.filter("quality in (0, 1)").selectExpr("quality", "n", *(f"cast(round({f} * {STEP}) as long) AS {f}" for f in FEATURES))
    total = lambda x: F.expr(f"sum(cast({x} AS decimal(25, 0)))")
    got = whole.groupBy("quality").agg(F.sum("n"), *(total(f"n * {f}") for f in FEATURES), *(total(f"n * {FEATURES[i]} * {FEATURES[j]}") for i, j in pairs)).orderBy("quality").collect()
    out = {}
    for r in got:
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[2 + d :]):
            second[i, j] = second[j, i] = float(v) / STEP**2
        out[int(r[0])] = (float(r[1]), np.array([float(v) / STEP for v in r[2 : 2 + d]]), second)
    return out


def fit(stats: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> dict | None:
    """Means, inverse Cholesky factors and log determinants of both classes; None if a class has fewer than two rows."""
    if len(stats) < 2 or min(v[0] for v in stats.values()) < 2:
        return None
    mean = {c: s / n for c, (n, s, _) in stats.items()}
    scatter = {c: m - n * np.outer(mean[c], mean[c]) for c, (n, _, m) in stats.items()}
    total = sum(v[0] for v in stats.values())
    pooled = sum(scatter.values()) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model = {}
    for c, (n, _, _) in stats.items():
        own = scatter[c] / n / np.outer(scale, scale)
        base = pooled / np.outer(scale, scale)
        cov = (1 - POOLED - DIAGONAL) * own + POOLED * base + DIAGONAL * np.diag(np.diag(own)) + FLOOR**2 * np.eye(len(scale))
        factor = np.linalg.cholesky(cov)
        model[c] = (mean[c] / scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), log(n / total))
    return {"scale": scale, "classes": model}


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Probability-like score of class 1 for each row of features; 0.5 without a model."""
    if model is None:
        return np.full(len(x), 0.5)
    z = x / model["scale"]
    density = {c: prior - 0.5 * (logdet + (((z - mu) @ inv.T) ** 2).sum(1)) for c, (mu, inv, logdet, prior) in model["classes"].items()}
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Labels count only where crc32 of the doc_id as text, mod 4, isn't 2, and where quality is 0 or 1;
    a label or document that is repeated counts as often. A null or empty text has the statistics
    of no words; a text of any length is read whole. Equal texts have equal scores, also in a rerun. A null doc_id is scored and not held out. If a class has fewer than two training rows, all
    scores are 0.5. An empty table gives no rows; further columns are ignored.
    """
    stats = durable(with_statistics(docs))
    known = only(labels, "doc_id", "quality").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id", "quality").agg(F.count("*").alias("n"))
    model = fit(moments(stats.join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, x))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
