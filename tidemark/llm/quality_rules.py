"""Quality rules: fixed limits first, then robust multivariate outliers; DataFrame operations only.

Each text gives word, symbol, line and repetition counts. Rows within the limits are
judged by the minimum-covariance-determinant estimate of their language and source:
the mean and covariance of that share of the group's rows which has the smallest
determinant; rows far from it (Mahalanobis distance) are rejected.

Each language and source has its own estimate, whatever its size. It is shrunk towards its language's, which is found in the same way from all
rows of the language, as if `PRIOR` more rows had that one's mean and covariance: few rows of a source say little against it, many outweigh it.

The transformed statistics are whole numbers (eighths of the deviation that is tolerated
anyway, FLOORS), so sums are exact and reruns agree. All iterations work on the counts of cells (rows
with like statistics). From two starts (medians and median deviations; mean and covariance of all)
concentration steps repeat until no group's determinant falls any more: fit, measure the
cells' distances, keep the nearest `SHARE` of the rows. Distances are counted in `BINS` to a doubling, so which are
nearest is told from a few counts a group, not by sorting its cells. The fit with the
smallest determinant wins. FLOORS**2 is added to the variances, as some statistics are
nearly constant in clean text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, drop_rows, durable, join_spread, let, only, row_key

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: Rows that the estimate of the language counts for in that of a source.
PRIOR = 50
#: By how much less the logarithm of a determinant's root doesn't count as falling.
STILL = 1e-2
#: Share of a group's rows that is fitted, the factor that makes its covariance that of all, bins of distances, and the largest squared distance (of a chi-square variable with five degrees, one in 100,000 lies beyond it).
SHARE, CONSISTENCY, BINS, CUTOFF = 0.6, 1.66, 64, 30.9
FEATURES = ["z_length", "z_symbols", "z_shouts", "z_lines", "z_repeats"]
FLOORS = [0.1, 0.8, 0.4, 0.9, 2.45]
UNITS = 8  # whole numbers to a floor
_D = len(FEATURES)
_M, _T = [f"m{i}" for i in range(_D)], [f"t{i}{j}" for i in range(_D) for j in range(i + 1)]


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Only texts with a repeated window have theirs sorted.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + WINDOW) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        near = F.transform(s, lambda e, i: F.when((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["p"]))
        return let(F.sort_array(F.array_compact(near)), covered)

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, marked))

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.when(i + WINDOW <= F.size(w), F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))
        return let(F.array_compact(hashes), of)

    return let(F.transform(words, lambda x: F.xxhash64(x)), windows)


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, lang, source and the counts of every row."""
    rows = only(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lacks = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = F.array_remove(F.split(text, SPACE), "")
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    out = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "lang", "source", let(words, counts).alias("w"), let(full, lines).alias("l"), lacks(r"[#*$%&|<>]").alias("n_symbols"), lacks(r"[\p{Lu}!]").alias("n_shouts"))
    return out.select("doc_id", "row_key", "lang", "source", "w.*", "l.*", "n_symbols", "n_shouts")


def with_features(counts: DataFrame) -> DataFrame:
    """Adds base_failed, group and the transformed statistics, as whole numbers."""
    c = F.col
    rate = lambda x, total, scale: F.log(F.lit(0.5) + F.lit(scale) * x / total)
    values = [
        F.log((c("word_chars") + 250) / (c("n_words") + 50)),
        rate(c("n_symbols"), c("word_chars") + 50, 1000),
        rate(c("n_shouts") + 3, c("word_chars") + 200, 1000),
        rate(c("n_dup_lines"), c("n_lines") + 10, 100),
        F.sqrt(1000 * c("n_repeat_words") / (c("n_words") + 50)),
    ]
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED * c("n_words"))
    # keys that tell a null from any text, and a language from a group
    key = lambda level, *columns: F.concat(F.lit(level), F.to_json(F.struct(*columns)))
    return counts.select("*", failed.alias("base_failed"), key("group", "lang", "source").alias("group"), key("lang", "lang").alias("of_lang"), *(F.round(v * (UNITS / f)).cast("long").alias(z) for z, v, f in zip(FEATURES, values, FLOORS)))


_C = [f"c{i}{j}" for i in range(_D) for j in range(i + 1)]


def _moments(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, mean m0.. and covariance c00.. of cells of `w` rows."""
    # expressions as SQL text, which is built and planned quickly
    pairs = [(i, j) for i in range(_D) for j in range(i + 1)]
    sums = [F.expr(f"sum(w * {z})").alias(f"s{i}") for i, z in enumerate(FEATURES)]
    products = [F.expr(f"sum(w * {FEATURES[i]} * {FEATURES[j]})").alias(f"p{i}{j}") for i, j in pairs]
    out = chosen.groupBy(*keys).agg(F.expr("sum(w)").alias("n"), *sums, *products)
    return out.selectExpr(*keys, "n", *(f"s{i} / n AS m{i}" for i in range(_D)), *(f"{CONSISTENCY}D * (p{i}{j} / n - s{i} / n * s{j} / n) AS c{i}{j}" for i, j in pairs))


def _shrunk(own: DataFrame, language: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of groups (with `of_lang`) after PRIOR more rows with their language's mean and covariance; `language` has these as `pool`."""
    told = language.selectExpr("pool AS of_lang", *(k for k in keys if k != "pool"), *(f"{c} AS prior_{c}" for c in (*_M, *_C)))
    share, other = f"(n / (n + {PRIOR}D))", f"({PRIOR}D / (n + {PRIOR}D))"
    cov = lambda i, j: f"{share} * c{i}{j} + {other} * prior_c{i}{j} + {share} * {other} * (m{i} - prior_m{i}) * (m{j} - prior_m{j}) AS c{i}{j}"
    joined = own.join(told, ["of_lang", *(k for k in keys if k != "pool")])
    return joined.selectExpr(*keys, "n", *(f"{share} * m{i} + {other} * prior_m{i} AS m{i}" for i in range(_D)), *(cov(i, j) for i in range(_D) for j in range(i + 1)))


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: mean m0.., inverse Cholesky factor t00.., log determinant of the floored covariance."""
    out = moments.selectExpr(*keys, *_M, *(f"c{i}{j} + {UNITS**2 if i == j else 0} AS c{i}{j}" for i in range(_D) for j in range(i + 1)))
    # the Cholesky factor column by column, then its inverse diagonal by diagonal
    for j in range(_D):
        rest = lambda i, k=j: " - ".join([f"c{i}{k}", *(f"l{i}{m} * l{k}{m}" for m in range(k))])
        root = f"sqrt(greatest({rest(j)}, 1e-6D))"
        out = out.selectExpr("*", f"{root} AS l{j}{j}", *(f"({rest(i)}) / {root} AS l{i}{j}" for i in range(j + 1, _D)))
    out = out.selectExpr("*", *(f"1 / l{i}{i} AS t{i}{i}" for i in range(_D)))
    for off in range(1, _D):
        out = out.selectExpr("*", *(f"-({' + '.join(f'l{i}{k} * t{k}{i - off}' for k in range(i - off, i))}) * t{i}{i} AS t{i}{i - off}" for i in range(off, _D)))
    return out.selectExpr(*keys, *_M, *_T, " + ".join(f"ln(l{i}{i})" for i in range(_D)) + " AS logdet")


def _estimate(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates of the pools of `chosen` (keys, of_lang, FEATURES, w): those of languages, where `of_lang` is null, and those of groups, shrunk to them.

    The moments, a row per pool, are written once: what follows has short plans of its own.
    """
    moments = durable(_moments(chosen, [*keys, "of_lang"]))
    language = moments.filter("of_lang is null").drop("of_lang")
    return _factored(language.unionByName(_shrunk(moments.filter("of_lang is not null"), language, keys)), keys)


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's features from its estimate."""
    parts = [" + ".join(f"t{i}{j} * ({FEATURES[j]} - m{j})" for j in range(i + 1)) for i in range(_D)]
    return F.expr(" + ".join(f"({p}) * ({p})" for p in parts))


def _nearest(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of smallest `d` that hold SHARE of a group's rows, all of those in the last bin included."""
    binned = cells.withColumn("_bin", F.floor(F.log2(1 + F.col("d")) * BINS))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = binned.groupBy(*keys, "_bin").agg(F.sum("w").alias("_w")).select(*keys, "_bin", F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(W.partitionBy(*keys)).alias("_all"))
    last = counts.filter(F.col("_upto") >= F.ceil(F.col("_all") * SHARE)).groupBy(*keys).agg(F.min("_bin").alias("_last"))
    return binned.join(last, keys).filter(F.col("_bin") <= F.col("_last")).drop("_bin", "_last")


def _medians(cells: DataFrame, value: str) -> DataFrame:
    """Weighted lower median of `value` per pool and axis."""
    order = W.partitionBy("pool", "axis").orderBy(value)
    counted = cells.groupBy("pool", "axis", value).agg(F.sum("w").alias("w"))
    ranked = counted.select("*", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_upto"), F.sum("w").over(W.partitionBy("pool", "axis")).alias("_all"))
    return ranked.filter("2 * _upto >= _all").groupBy("pool", "axis").agg(F.min(value).alias("median"))


def _fits(start: DataFrame) -> DataFrame:
    """pool, start and the estimate of the nearest cells of each, written to the shared folder."""
    return durable(_estimate(_nearest(start, ["pool", "start"]), ["pool", "start"]))


def concentrate(cells: DataFrame) -> DataFrame:
    """Per pool the minimum-covariance-determinant estimate (m0.., t00.., logdet) of its cells (pool, of_lang, FEATURES, w): of_lang is null for a language's."""
    axes = cells.select("pool", "w", F.posexplode(F.array(*FEATURES)).alias("axis", "z"))
    middle = durable(_medians(axes, "z"))
    away = axes.join(middle, ["pool", "axis"]).withColumn("off", F.abs(F.col("z") - F.col("median")))
    spread = _medians(away, "off").withColumnRenamed("median", "mad")
    robust = middle.join(spread, ["pool", "axis"]).groupBy("pool").agg(*(F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}") for i in range(_D) for c in ("median", "mad")))
    from_medians = F.lit(0.0)
    for i, z in enumerate(FEATURES):
        from_medians = from_medians + ((F.col(z) - F.col(f"median{i}")) / F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(float(UNITS)))) ** 2
    first = cells.join(robust, "pool").select(*cells.columns, F.lit(0).alias("start"), from_medians.alias("d"))
    second = cells.join(_estimate(cells, ["pool"]), "pool").select(*cells.columns, F.lit(1).alias("start"), _distance().alias("d"))
    now = _fits(first.union(second))
    seen = now
    while True:
        now = _fits(cells.join(now, "pool").select(*cells.columns, "start", _distance().alias("d")))
        least = seen.groupBy("pool", "start").agg(F.min("logdet").alias("least"))
        lower = now.join(least, ["pool", "start"]).filter(F.col("logdet") < F.col("least") - STILL)
        seen = seen.union(now)
        if lower.isEmpty():
            break
    values = [*_M, *_T]
    return seen.groupBy("pool").agg(F.min(F.struct("logdet", "start", *values)).alias("b")).select("pool", *(F.col(f"b.{c}").alias(c) for c in [*values, "logdet"]))


def estimates(rows: DataFrame) -> DataFrame:
    """Per group: n (its rows), m0.., t00.. of its estimate."""
    cells = durable(rows.groupBy("group", "of_lang", *FEATURES).agg(F.count("*").alias("w")))
    own = cells.select(F.col("group").alias("pool"), "of_lang", *FEATURES, "w")
    language = cells.groupBy(F.col("of_lang").alias("pool"), *FEATURES).agg(F.sum("w").alias("w")).select("pool", F.lit(None).cast("string").alias("of_lang"), *FEATURES, "w")
    sizes = cells.groupBy("group").agg(F.sum("w").alias("n"))
    return durable(sizes.join(concentrate(durable(own.union(language))), F.col("group") == F.col("pool")).select("group", "n", *_M, *_T))


def _judged(docs: DataFrame) -> DataFrame:
    rows = durable(with_features(with_counts(docs)))
    fit = rows.filter("not base_failed")
    seen = join_spread(fit, estimates(fit), "group", "n").withColumn("distance", _distance())
    return seen.select(*rows.columns, "distance", (F.col("distance") <= CUTOFF).alias("kept")).union(rows.filter("base_failed").select("*", F.lit(None).cast("double"), F.lit(False)))


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance of every row of `docs`.

    A null or empty text has no words and fails the limits; texts of any length are counted whole. Null languages and
    sources are groups of their own. Repeated rows each get their row and weigh as often; a few like rows alone in a table
    are kept, as the estimate is at these rows. Ties: rows with like statistics are kept or rejected together. An empty
    table gives no rows; further columns are ignored.
    """
    return _judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns; nulls, empty texts and repeated rows as in `apply_rules`."""
    rejected = durable(_judged(docs).filter("not kept").select("doc_id", "row_key"))
    return drop_rows(docs, rejected)
