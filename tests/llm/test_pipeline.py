"""The pipeline's stages against their operators, and the registered queries against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, quality_rules, queries, simhash
from tidemark.llm.common import shared_dir

from .test_operators import AWKWARD, DOCS, NAMES


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name == "quality_rules":
            assert ids(out) == ids(quality_rules.apply_rules(docs).filter("kept"))
        elif name == "exact_dedup":
            assert ids(out) == ids(exact_dedup.exact_duplicates(docs).filter("kept"))
        elif name == "simhash_near_dedup":
            assert ids(out) == ids(simhash.near_duplicates(docs).filter("doc_id = component_id"))
        elif name == "source_mixing":
            assert set(ids(out)) <= set(ids(docs))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0 and corpus_pipeline.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(near(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(near(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns from end to end: what comes out is packed whole."""
    words = [f"word{i}" for i in range(400)]
    clean = [(100 + i, " ".join(words[i * 7 : i * 7 + 90]) + ".", "en", "a", 1) for i in range(40)]
    rows = spark.createDataFrame([*AWKWARD, *clean], DOCS)
    for n in (*NAMES, "sequence_id", "_doc"):
        rows = rows.withColumn(n, F.lit("x"))
    rows.write.parquet(str(tmp_path / "odd/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in [*AWKWARD, *clean]} and len({r.doc_id for r in out}) > 20
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)  # no gaps
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    left = [p.name for p in sorted(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*/*")) if p.is_dir()]
    assert set(left) <= {"best_fit_packing"}
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
