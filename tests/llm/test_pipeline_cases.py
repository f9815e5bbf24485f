from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from conftest import SF
from test_llm_operators import prose

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty, repeated and very long texts, and columns named like internal ones."""
    rng = random.Random(1)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(9001, prose(rng, 150_000), "en", "src1", 1), (None, prose(rng, 90), None, None, None), (9002, None, "en", "src1", 0), (9003, "", None, "src2", 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"mine {c}") for c in ("key", "copy", "mix_key", "score", "id", "__id", "__key", "page", "h")}).repartition(3).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_rows_keep_their_columns(spark, odd, name):
    before = {str(r) for r in odd.collect()}
    out = STAGES[name](spark, odd, SF)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and {str(r) for r in rows} <= before
    ids = [r.doc_id for r in rows]
    if name == "near_duplicates":
        assert len(rows) == len(before) or len(rows) < odd.count()
        assert ids.count(odd.first().doc_id) <= 1 and {9002, 9003} <= set(ids)
    if name == "decontamination":
        assert {9001, 9002, 9003, None} <= set(ids)


def test_index_of_odd_rows(spark, odd):
    rows = STAGES["token_shards"](spark, odd, SF).collect()
    assert all(r.intact for r in rows) and {p.doc_id for r in rows for p in r.docs} == {r.doc_id for r in odd.collect()}


def test_near_duplicates_by_brute_force(spark):
    from test_llm_operators import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {c for _, c, _ in brute_classes(rows)}
    assert {r.doc_id for r in STAGES["near_duplicates"](spark, docs, SF).collect()} == want


def test_decontamination_by_brute_force(spark):
    """Every document whose passages are within their edits goes, no other: passages by the full table."""
    from lexloom.llm import decontaminate as D
    from test_passages import best, normal

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    bench = [normal(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    small = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    rows = docs.limit(25).collect()
    want = {r.doc_id for r in rows if not any(len(p) <= 400 and best(p, normal(r.text or ""))[0] <= int(len(p) * D.RATE) for p in bench)}
    kept = {r.doc_id for r in D.drop_contaminated(docs.where(F.col("doc_id").isin([r.doc_id for r in rows])), small).collect()}
    assert all(len(p) <= 400 for p in bench) and kept == want
