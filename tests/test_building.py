"""Building, refreshing and compacting an index: work and memory of a task don't grow with the corpus."""

from __future__ import annotations

import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import maintained, pruned, segmentation
from lexloom.sources import tables


def entries(spark, n=90):
    rng = random.Random(6)
    rows = [(i, " ".join(["all"] + [f"w{min(int(rng.expovariate(0.1)), 40)}" for _ in range(rng.randrange(0, 30))])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string").withColumn("sig", F.sha2("text", 256))


def test_entries_are_counted_once_and_words_travel_in_lists(spark):
    # an exchange by ranges would work out its rows a second time for its sample
    plan = pruned.blocks(pruned.tokenised(entries(spark)), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange ") == 1
    lists = list(pruned._spans([3, 3, 3, 3], 2, 100))
    assert lists == [(0, 2), (2, 4)]


def test_words_travel_in_one_row_for_each_part(spark):
    forward = pruned.tokenised(entries(spark).coalesce(1))
    rows = forward.mapInArrow(partial(pruned._lists, 3, 1), pruned._listed("long")).collect()  # these few entries are counted at once
    assert sorted(r.part for r in rows) == [0, 1, 2] and all(sum(r.sizes) == len(r.ids) == len(r.tfs) == len(r.dls) for r in rows)
    spread = [r.part for r in forward.mapInArrow(partial(pruned._lists, 3, 1), pruned._listed("long")).select("part", F.explode("terms").alias("t")).distinct().groupBy("t").agg(F.count("*").alias("part")).collect()]
    assert len(spread) == 42 and set(spread) == {1}
    held = sorted((t, i) for r in rows for t, i in zip((t for t, n in zip(r.terms, r.sizes, strict=True) for _ in range(n)), r.ids, strict=True))
    assert held == sorted(map(tuple, forward.select(F.explode(F.array_distinct("tokens")).alias("t"), "id").collect()))


@pytest.mark.parametrize("gone, hot", [(0, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 16), (0, 16)])
def test_compaction_joins_postings_without_counting_again(spark, tmp_path, monkeypatch, gone, hot):
    for name, value in (("GONE", gone), ("HOT", hot), ("COUNTED", 7), ("RANGE", 200)):
        monkeypatch.setattr(pruned, name, value)
    path, docs = f"file://{tmp_path}/index", entries(spark)
    maintained.build(docs, path, size=4)
    now = docs.where("id % 5 <> 2").withColumn("text", F.when(F.col("id") % 5 == 1, F.concat("text", F.lit(" new new"))).otherwise(F.col("text"))).withColumn("sig", F.sha2("text", 256))
    maintained.refresh(now, path, size=4)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(pruned.tokenised(now).select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").count().select("term", "id", "count", "dl"))
    words = sorted({(t, sum(x[0] == t for x in want)) for t, *_ in want})
    counted, count = [], pruned.blocks
    monkeypatch.setattr(pruned, "blocks", lambda *a, **b: (counted.append(1), count(*a, **b))[1])
    for _ in range(2):
        index = maintained.read(spark, path)
        assert rows(maintained.postings(index).select("term", "id", "tf", "dl")) == want and rows(maintained.frequencies(index)) == words
        maintained.compact(spark, path, size=4)
    assert not counted and maintained.read(spark, path).blocks.agg(F.max(F.size("ids"))).first()[0] == 4


def test_many_changes_are_dealt_out_by_the_size_of_the_corpus(spark, tmp_path, monkeypatch):
    for name, value in (("GONE", 0), ("RANGE", 50), ("COUNTED", 7)):
        monkeypatch.setattr(pruned, name, value)
    path, docs = f"file://{tmp_path}/index", entries(spark)
    maintained.build(docs, path, size=4)
    words = maintained.read(spark, path).length
    now = docs.where("id % 5 <> 2").withColumn("sig", F.when(F.col("id") % 5 == 1, "other").otherwise(F.col("sig")))
    assert maintained.refresh(now, path, size=4).groupBy("change").count().sort("change").collect() == [("changed", 18), ("gone", 18)]
    # what carries tokens is sorted in parts of a bounded number of words
    index = maintained.read(spark, path)
    plan = index.forward._jdf.queryExecution().executedPlan().toString()
    assert words > 500 and set(re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)) == {str(-(-index.length // 50))} and "ENSURE_REQUIREMENTS" not in plan
    gone = sorted(r.id for r in spark.read.parquet(f"{path}/seg-1/gone").collect())
    assert gone == [i for i in range(90) if i % 5 in (1, 2)] and index.n_gone == 36 and index.forward.count() == 72


def test_content_is_the_sum_of_hashes(spark):
    df = spark.range(1000, numPartitions=3).select("id", F.col("id").cast("string").alias("s"))
    want = [sum(r.h for r in df.select(F.xxhash64(F.lit(seed), "id", "s").alias("h")).collect()) for seed in (1, 2)]
    assert [int(x) for x in tables.content(df).first()] == [1000, *want]
    assert tables.content(df.limit(0)).first().rows == 0


def test_pieces_of_few_sentences_are_held(monkeypatch):
    texts = ["ab c" * 5] * 40 + ["", "犬"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["h", "target"])
    monkeypatch.setattr(segmentation, "SCANNED", 3 * segmentation.MAX_LENGTH)
    parts = list(segmentation._scanned(np.full(1 << 17, 255, np.uint8), iter([batch])))
    want = [(h, a, t[a : a + k]) for h, t in enumerate(texts) for a in range(len(t)) for k in range(1, segmentation.LONGEST + 1) if a + k <= len(t) and (k > 1 or t == "犬")]
    assert sorted(tuple(r.values()) for p in parts for r in p.to_pylist()) == sorted(want)
    assert len(parts) == 14 and max(len(set(p["h"].to_pylist())) for p in parts) == 3
