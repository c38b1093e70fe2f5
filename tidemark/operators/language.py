"""EX-03: the language of a text by naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features, of n-grams of one to three characters; smoothing adds one to each.
FEATURES, LONGEST = 4096, 3
#: Characters of a text that are looked at together.
PIECE = 1 << 20
#: Characters that a row to Python holds at most, so that an Arrow batch (a number of rows) is small whatever the texts and the partitions are.
SENT = 512


class Model(NamedTuple):
    """Languages in order, and the logarithm of each feature's share in each."""

    languages: list[str]
    shares: np.ndarray


def counts(text: str | None, before: int = 0) -> np.ndarray:
    """How often each feature comes: of the n-gram with the code points a, b, c number ((a * 31 + b) * 31 + c) * 3 + n - 1, modulo FEATURES.
    N-grams that end in the first `before` characters, fewer than LONGEST, are left out."""
    out = np.zeros(FEATURES, np.int64)
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    for low in range(before, len(points), PIECE):
        part = points[max(0, low - LONGEST + 1) : low + PIECE].astype(np.int64)
        back = min(low, LONGEST - 1)  # characters of the piece before, for n-grams that end in this one
        value = np.zeros(len(part), np.int64)
        for n in range(1, LONGEST + 1):
            value = (value[:-1] if n > 1 else value) * 31 + part[n - 1 :]
            first = max(0, back - n + 1)
            out += np.bincount((value[first:] * 3 + n - 1) % FEATURES, minlength=FEATURES)
    return out


def _sent(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns `keep`, and each text in pieces, row by row and in order; null and empty texts have one row."""
    return texts.select(*keep, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{SENT}}}"), F.lit(0))).alias("_at", "_piece"))


def _counted(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Of the rows of `_sent`, each text's kept values and counts, one text at a time."""
    head: tuple | None = None
    n, tail = np.zeros(FEATURES, np.int64), ""
    for b in batches:
        parts: list[str] = []
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_at", "_piece", *keep)]
        for at, piece, *kept in zip(*columns):
            if not at:
                if head is not None:
                    yield head, n + counts(tail + "".join(parts), len(tail))
                head, n, tail, parts = tuple(kept), np.zeros(FEATURES, np.int64), "", []
            parts.append(piece or "")
        held = tail + "".join(parts)
        n, tail = n + counts(held, len(tail)), held[-(LONGEST - 1) :]
    if head is not None:
        yield head, n


def fit(texts: DataFrame, language: str = "lang", text: str = "text") -> Model:
    """The model of the texts whose language is known: one aggregation, of at most FEATURES rows per language and task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(FEATURES, np.int64))
        for (lang,), n in _counted(batches, ["lang"]):
            sums[lang] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "feature": at.astype(np.int32), "n": n[at]})

    known = texts.select(F.col(language).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    rows = _sent(known, ["lang"], "text").mapInArrow(tally, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    table = np.ones((len(languages), FEATURES))
    for r in rows:
        table[languages.index(r["lang"]), r["feature"]] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def _best(n: np.ndarray, model: Model) -> tuple[str | None, float | None]:
    if not model.languages or not n.any():
        return None, None
    sums = model.shares @ n
    return model.languages[int(np.argmax(sums))], float(sums.max() / n.sum())


def score_rows(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """What `score` gives, for whole tables: `texts` with language and score in place of the text. Python holds a few MB of texts at a time, `score` 10,000 of them."""
    keep = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([*(b.schema.field(c) for c in keep), ("language", pa.string()), ("score", pa.float64())])
                yield b

        each = ((*kept, *_best(n, model)) for kept, n in _counted(watched(), keep))
        while rows := list(islice(each, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)
    return _sent(texts, keep, text).mapInArrow(run, f"{kinds}, language string, score double")


def score(text: Column, model: Model) -> Column:
    """A struct (language, score): the likeliest language, of like ones the first by name, and its mean log share per n-gram; null for null and empty texts."""

    @F.pandas_udf("language string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_best(counts(t), model) for t in texts], columns=["language", "score"])

    return best(text)


def detect(text: Column, model: Model, least: int = 50) -> Column:
    """EX-03: the likeliest language of texts of more than `least` characters, else null."""
    return F.when(F.length(text) > least, score(text, model)["language"])
