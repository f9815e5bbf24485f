"""Work that must not grow faster than the input."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import maintained, pruned, retrieval
from lexloom.plans import stored_queries
from lexloom.sources import tables

from conftest import SF


def jobs(spark, name, run) -> int:
    """How many Spark jobs a piece of work takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_pages_take_as_many_jobs_as_one(spark, monkeypatch):
    taken = {}
    for size in (4, 400):
        monkeypatch.setattr(stored_queries, "_PAGE", size)
        rows = []
        taken[size] = jobs(spark, f"pages-{size}", lambda: rows.extend(stored_queries.cursor_pages(spark, SF).collect()))  # noqa: B023
        rows.sort(key=lambda r: r.doc_id)
        assert [r.page for r in rows] == [n // size for n in range(len(rows))] and len(rows) > 50
    assert taken[4] == taken[400]


def test_pages_are_those_of_cursors(spark, tmp_path):
    path = f"file://{tmp_path}/ordered"
    tables.write_ordered(spark.range(0, 300, 3).withColumnRenamed("id", "k"), path, "k", 7)
    after, seen = None, []
    while found := tables.page(spark, path, "k", after, 13).collect():
        seen.append([r.k for r in found])
        after = seen[-1][-1]
    rows = tables.pages(spark, path, "k", 13).collect()
    assert [sorted(r.k for r in rows if r.page == n) for n in range(len(seen))] == seen and len(rows) == 100


def entries(spark, n=60):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 40)}" for _ in range(rng.randrange(0, 30)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string").withColumn("sig", F.sha2("text", 256))


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))
    assert key(a) == key(b)


def test_postings_are_dealt_out_once(spark):
    plan = pruned.blocks(pruned.tokenised(entries(spark)), 10.0)._jdf.queryExecution().sparkPlan().toString()
    full = pruned.blocks(pruned.tokenised(entries(spark)), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and full.count("Exchange ") == 1


@pytest.mark.parametrize("few, words", [(0, 1 << 16), (1 << 18, 3), (0, 3)])
def test_names_of_queries_are_not_carried_along(spark, tmp_path, monkeypatch, few, words):
    path, docs = f"file://{tmp_path}/index", entries(spark)
    maintained.build(docs, path, size=4)
    queries = spark.createDataFrame([(f"a long question {n}", f"w{n} w{n * 3 % 11} w1") for n in range(12)], "qid string, q string")
    kinds, keep = [], pruned.staged
    monkeypatch.setattr(pruned, "staged", lambda df, name: (kinds.append(dict(df.dtypes).get("qid")), keep(df, name))[1])
    monkeypatch.setattr(pruned, "FEW", few)
    monkeypatch.setattr(pruned, "WORDS", words)
    same(pruned.search(queries, maintained.read(spark, path), 3)[0], retrieval.bm25(queries, docs, 3))
    assert set(kinds) == {"bigint"}


def test_stored_words_stay_where_they_are(spark, tmp_path, monkeypatch):
    path, names, keep = f"file://{tmp_path}/index", [], pruned.staged
    maintained.build(entries(spark), path, size=4)
    monkeypatch.setattr(pruned, "staged", lambda df, name: (names.append(name), keep(df, name))[1])
    asked = pruned._asked(spark.createDataFrame([(1, "w1 w2 w2 other")], "qid long, q string"), maintained.read(spark, path), "q")
    # the size of written words is known before the join is planned
    assert names == ["words"] and "BroadcastHashJoin" in asked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.term for r in asked.collect()) == ["w1", "w2"]


def test_exact_scores_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    known, rows = 7, 50
    asked = [sorted(rng.choice(known, rng.integers(1, 5), replace=False)) for _ in range(9)]
    begin, word, idf = np.cumsum([0, *map(len, asked)]), np.concatenate(asked), rng.random(known)
    has = [sorted(rng.choice(known, rng.integers(1, 6), replace=False)) for _ in range(rows)]
    tf, of, dl = [list(map(int, rng.integers(1, 4, len(h)))) for h in has], [sorted(map(int, rng.choice(9, 4, replace=False))) for _ in range(rows)], rng.integers(5, 20, rows)
    batch = pa.RecordBatch.from_arrays([pa.array([[10 * q for q in x] for x in of]), pa.array(range(rows)), pa.array(dl, pa.int32()), pa.array([list(map(int, h)) for h in has], pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["qids", "id", "dl", "n", "tf"])
    monkeypatch.setattr(pruned, "CELLS", 21)
    monkeypatch.setattr(pruned, "PAIRS", 5)
    parts = list(pruned._scored(np.arange(0, 90, 10), begin, word, idf, 11.0, iter([batch])))
    got = {(r["qid"] // 10, r["id"]): r["score"] for p in parts for r in p.to_pylist()}
    part = lambda w, i: idf[w] * tf[i][has[i].index(w)] * 2.2 / (tf[i][has[i].index(w)] + 1.2 * (0.25 + 0.75 * dl[i] / 11.0))
    want = {(q, i): sum(part(w, i) for w in asked[q] if w in has[i]) for i in range(rows) for q in of[i]}
    assert max(p.num_rows for p in parts) <= 5 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_spans_are_bounded_by_rows_and_load():
    load = np.array([1, 1, 5, 9, 0, 0, 2, 2, 2])
    assert list(retrieval._spans(load, 3, 6)) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert list(retrieval._spans(load[:0], 3, 6)) == []


def test_gone_entries_leave_without_their_tokens(spark, tmp_path, monkeypatch):
    path, docs = f"file://{tmp_path}/index", entries(spark)
    maintained.build(docs, path, size=4)
    maintained.refresh(docs.where("id % 5 <> 2").withColumn("sig", F.when(F.col("id") % 5 == 1, "other").otherwise(F.col("sig"))), path, size=4)
    kept, live = [], pruned.Index.live
    monkeypatch.setattr(pruned.Index, "live", lambda self, rows: (kept.append(rows.columns), live(self, rows))[1])
    monkeypatch.setattr(pruned, "FEW", 0)
    queries = spark.createDataFrame([(n, f"w{n} w1") for n in range(6)], "qid long, q string")
    same(pruned.search(queries, maintained.read(spark, path), 3)[0], retrieval.bm25(queries, docs.where("id % 5 <> 2"), 3))
    assert kept and not any("tokens" in columns for columns in kept)
