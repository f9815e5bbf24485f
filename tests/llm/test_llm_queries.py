from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from lexloom.llm import catalogue, decontaminate

from conftest import SF
from oracle import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) == ([], [])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ngram_join_on_the_documents(spark, texts):
    sets = {i: set(zip(*(WORD.findall(t)[k:] for k in range(5)))) or {tuple(WORD.findall(t))} for i, t in texts.items()}
    links = Counter(i for i in sets for j in sets if i != j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    got = {r.doc_id: r.n_links for r in catalogue.op4_ngram_join(spark, SF).collect()}
    assert got == {i: links[i] for i in texts} and sum(links.values()) > 0


def test_decontamination_finds_the_passages(spark, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in catalogue.op3_decontamination(spark, SF).collect()}
    inside = {(i, b) for i, t in texts.items() for b, p in bench.items() if p in t and len(p) >= decontaminate.LEAST}
    assert inside and inside <= got


def test_shards_are_intact(spark, texts):
    rows = catalogue.op2_token_shards(spark, SF).collect()
    assert all(r.intact for r in rows) and sorted(r.slot for r in rows) == list(range(len(rows))) and {r.offset % 2048 for r in rows} == {0}


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and abs(sizes[4] - sizes[3]) < sizes[3]
    assert corpus_pipeline.run(spark, SF).where("intact").count() > 0


@pytest.mark.parametrize("n", range(5))
def test_stages_take_no_rows(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[n][1](spark, docs, SF).count() == 0
