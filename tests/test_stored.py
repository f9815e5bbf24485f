"""Stored structures: exact pruned search, cells, segments, kept answers, pieces of histories, capped keys, days, copies, cursors."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.operators import cells, events, kept, maintained, pruned, retrieval
from lexloom.sources import tables
from lexloom.streaming import capped


def corpus(spark, n=300, seed=1, words=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.08)), words)}" for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string").withColumn("sig", F.sha2("text", 256))


def asked(spark, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, " ".join(f"w{rng.randrange(0, 70)}" for _ in range(rng.randrange(1, 8)))) for q in range(25)] + [(90, "nothing"), (91, "")], "qid long, q string")


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))
    assert key(a) == key(b)


def test_pruned_search_is_exact_and_follows_changes(spark, tmp_path):
    path, docs, queries = f"file://{tmp_path}/index", corpus(spark), asked(spark)
    maintained.build(docs, path, size=4)
    found, report = pruned.search(queries, maintained.read(spark, path), 3)
    same(found, retrieval.bm25(queries, docs, 3))
    read = report.agg(F.sum("read"), F.sum("had")).first()
    assert 0 < read[0] < read[1]
    # three versions: changed, gone and new entries, also ones that come again
    now = docs
    for n in range(3):
        files = {p: os.stat(p).st_mtime_ns for p in Path(tmp_path / "index").rglob("*.parquet")}
        changed = F.when(F.col("id") % 9 == n, F.concat(F.lit(f"w{n} "), "text")).otherwise(F.col("text"))
        now = now.where(F.col("id") % 11 != n + 5).withColumn("text", changed).unionByName(docs.where(F.col("id") % 11 == n + 4).withColumn("id", F.col("id") + 1000 * (n + 1)))
        now = now.unionByName(docs.where("id % 11 = 6")) if n == 2 else now
        now = tables.staged(now.withColumn("sig", F.sha2("text", 256)), "version")
        changes = {r.id: r.change for r in maintained.refresh(now, path, size=4).collect()}
        index = maintained.read(spark, path)
        same(pruned.search(queries, index, 3)[0], retrieval.bm25(queries, now, 3))
        assert {r.id for r in index.stored.where(F.col("seg") == n + 1).collect()} == {i for i, c in changes.items() if c != "gone"}
        assert all(os.stat(p).st_mtime_ns == t for p, t in files.items())  # nothing stored was touched
    assert maintained.refresh(now, path).count() == 0 and maintained.overhead(spark, path) > 0
    before = sorted(map(tuple, maintained.postings(maintained.read(spark, path)).collect()))
    maintained.compact(spark, path)
    assert maintained.overhead(spark, path) == 0 and sorted(map(tuple, maintained.postings(maintained.read(spark, path)).collect())) == before
    assert maintained.sweep(spark, path) == 4
    same(pruned.search(queries, maintained.read(spark, path), 3)[0], retrieval.bm25(queries, now, 3))


def test_empty_index(spark, tmp_path):
    path, docs = f"file://{tmp_path}/index", corpus(spark)
    maintained.build(docs.limit(0), path)
    assert pruned.search(asked(spark), maintained.read(spark, path), 3)[0].count() == 0
    maintained.refresh(docs, path)
    same(pruned.search(asked(spark), maintained.read(spark, path), 3)[0], retrieval.bm25(asked(spark), docs, 3))


def test_cells_are_exact_and_skip_what_is_far(spark, tmp_path):
    rng = random.Random(5)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.03) for x in middle[i % 12]]) for i in range(600)] + [(900, [0.0] * 8), (901, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    cells.write_cells(v, f"file://{tmp_path}/cells", 20)
    found, report = cells.search(q, cells.Cells.read(spark, f"file://{tmp_path}/cells"), 5)
    same(found, retrieval.dense(q, v, 5))
    total = report.agg(F.sum("scored"), F.sum("had")).first()
    assert total[0] < 0.5 * total[1]


def test_answers_are_kept_by_recency_and_version(spark, tmp_path):
    searched = []

    def search(q):
        searched.append(sorted(r.q for r in q.collect()))
        return q.select("qid", F.length("q").cast("long").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")).where("qid <> 'none'")

    ask = lambda *texts: spark.createDataFrame(list(enumerate(texts, 1)), "qid long, query string")
    store = kept.Answers(spark, f"file://{tmp_path}/answers", most=3)
    rows = lambda df: sorted((r.qid, r.id, r.hit) for r in df.collect())
    assert rows(store.answer(ask("a", "bb", "A?", "none"), "1", search)) == [(1, 1, False), (2, 2, False), (3, 1, False)]
    assert rows(store.answer(ask("ccc", "bb"), "1", search)) == [(1, 3, False), (2, 2, True)]
    assert rows(store.answer(ask("none", "a"), "1", search)) == [(2, 1, False)]  # "a" was the least recent of four
    assert rows(store.answer(ask("a"), "2", search)) == [(1, 1, False)]
    assert searched == [["a", "bb", "none"], ["ccc"], ["a"], ["a"]] and store.held().count() <= 3


def test_pieces_decide_as_whole_histories(spark):
    rng, rows = random.Random(3), []
    for key in (1, 2, None):
        t = 0.0
        for _ in range(200):
            t += rng.choice([1, 1, 2, 5, 9, 10, 11, 40])
            rows.append((key, len(rows), t))
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    want = sorted((r.event_id, r.wait) for r in events.admissions(df.where("user_id is not null"), 2, 10.0).collect())
    got = events.split_admissions(df, 2, 10.0).collect()
    assert sorted((r.event_id, r.wait) for r in got if r.user_id == r.user_id and r.user_id in (1, 2)) == want and len(got) == len(rows)
    assert max(r.piece for r in got) > 20


def test_keys_are_capped_and_expire(spark, tmp_path):
    path, write = f"file://{tmp_path}/capped", capped.admit(f"file://{tmp_path}/capped", 1, 10.0, 2, 100.0)
    batch = lambda *rows: spark.createDataFrame([(k, n, float(t)) for n, (k, t) in enumerate(rows)], "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    write(batch((1, 0), (2, 1), (3, 2), (2, 3)), 0)
    write(batch((1, 4), (3, 5)), 1)  # key 1 was evicted, so its hit at 0 is forgotten; key 3 is held
    write(batch((9, 500)), 2)
    write(batch((9, 505)), 2)  # a batch run again changes nothing
    held = [sorted(r.user_id for r in capped.state(spark, path, n).collect()) for n in range(3)]
    waits = {(r.batch, r.user_id): r.wait for r in spark.read.parquet(f"{path}/decided").where("event_id < 2").collect()}
    assert held == [[2, 3], [1, 3], [9]] and waits[(1, 1)] == 0 and waits[(1, 3)] > 0


def test_days_go_without_touching_others(spark, tmp_path):
    path = f"file://{tmp_path}/daily"
    rows = spark.range(240).select("id", (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,id)")).alias("ts"))
    tables.write_daily(rows, path)
    times = {p: os.stat(p).st_mtime_ns for p in Path(tmp_path / "daily").rglob("*.parquet")}
    touched = tables.expire_daily(spark, path, 3, "2024-01-08 12:00:00")
    assert touched == [f"2024-01-0{d}" for d in range(1, 6)]
    left = spark.read.parquet(path)
    assert sorted(r.id for r in left.collect()) == [r.id for r in rows.where("ts >= '2024-01-05 12:00:00'").orderBy("id").collect()]
    for p, t in times.items():
        day = int(str(p).split("day=2024-01-")[1][:2])
        assert (day > 5) == (p.exists() and os.stat(p).st_mtime_ns == t)
    assert tables.expire_daily(spark, path, 0, "2024-01-08 12:00:00") == [] and tables.expire_daily(spark, path, 3, "2024-01-08 12:00:00") == []


def test_copies_and_cursors(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 7}" if i % 5 else None) for i in range(1000)], "k long, t string")
    df.write.parquet(f"file://{tmp_path}/a")
    assert tables.copy_table(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b") == 1000
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/b").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(OSError):
        tables.copy_table(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")  # what is there stays
    tables.write_ordered(df, f"file://{tmp_path}/o", "k", 10)
    after, seen = None, []
    while page := tables.page(spark, f"file://{tmp_path}/o", "k", after, 130).collect():
        seen += [r.k for r in page]
        after = seen[-1]
    assert seen == list(range(1000))
    deep = tables.page(spark, f"file://{tmp_path}/o", "k", 899, 50)
    assert len(deep.inputFiles()) <= 3 and [r.k for r in deep.collect()] == list(range(900, 950))
