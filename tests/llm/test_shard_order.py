"""The training order depends on the rows alone; shards of several blocks; a scalar permutation; odd inputs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import token_shards as T

from test_llm_operators import _texts, docs, prose


def rows():
    rng = random.Random(4)
    return [(i, prose(rng, rng.randrange(1, 120))) for i in range(200)] + [(900, "the same text")] * 60 + [(None, "no id"), (None, "no id"), (7, None), (8, "")]


def held(shards, length=64):
    return {r.slot: bytes(r.ids) for r in shards.read().collect()}


def test_order_does_not_depend_on_the_splits(spark):
    data = rows()
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    one = T.write_shards(docs(spark, data).repartition(2), length=64)
    two = T.write_shards(docs(spark, shuffled).repartition(5), length=64)
    assert one.sequences == two.sequences > 100 and held(one) == held(two)
    meta = lambda s: {r.slot: r.asDict(True) for r in s.manifest().collect()}
    assert meta(one) == meta(two)
    ranks = open(T.VOCABULARY, "rb").read()
    order = one.order.numbers(np.arange(one.sequences))
    stream = np.concatenate([np.frombuffer(held(one)[s], "<u2") for s in np.argsort(order)])[: one.layout.tokens]
    texts = _texts(stream, ranks)
    assert Counter(texts) == Counter(t or "" for _, t in data)
    places = [k for k, t in enumerate(texts) if t == "the same text"]
    assert sum(b - a == 1 for a, b in zip(places, places[1:])) < 30  # copies stand apart


@pytest.mark.parametrize("tasks", [20_000, 3])
def test_shards_of_several_blocks(spark, monkeypatch, tasks):
    monkeypatch.setattr(T, "TASKS", tasks)
    df = docs(spark, rows()).repartition(3)
    plain = T.write_shards(df, length=64)
    many = T.write_shards(df, length=64, block_bytes=128 * 4, shard_bytes=128 * 12)
    lay = many.layout
    assert (lay.per_block, lay.blocks) == (4, 3) and lay.shards > 6 and held(many) == held(plain)
    files = spark.read.format("binaryFile").load(many.path).where(F.col("path").rlike(r"part-")).collect()
    assert len(files) == lay.shards and sum(f.length for f in files) == 128 * lay.sequences + -(-lay.sequences // 4)
    assert [r.slot for r in many.read(30, 11).orderBy("slot").collect()] == list(range(30, 41))
    index = T.shard_index(df, length=64, block_bytes=128 * 4, shard_bytes=128 * 12).collect()
    assert all(r.intact for r in index) and len(index) == lay.sequences


def test_permutation_equals_a_scalar_one():
    mask64 = 2**64 - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask64
        return h ^ (h >> 31)

    for n, key in ((1, 5), (2, 9), (1000, 1234567), (4097, 2**63 + 11)):
        half = 1
        while 4**half < n:
            half += 1
        keys = [mix((key + 0x9E3779B97F4A7C15 * (r + 1)) & mask64) for r in range(6)]

        def slot(x):
            while True:
                left, right = x >> half, x & (2**half - 1)
                for k in keys:
                    left, right = right, left ^ (mix((right + k) & mask64) & (2**half - 1))
                x = right << half | left
                if x < n:
                    return x

        assert T.Feistel(n, key).slots(np.arange(n)).tolist() == [slot(x) for x in range(n)]


def test_damage_is_found(spark):
    shards = T.write_shards(docs(spark, rows()), length=64)
    good = {r.slot: r.found for r in shards.read(checksums=True).collect()}
    ids = np.frombuffer(held(shards)[3], "<u2").copy()
    assert T.checks(ids, np.arange(64)).sum() == good[3]
    ids[[5, 6]] = ids[[6, 5]] if ids[5] != ids[6] else ids[[5, 6]] + 1
    assert T.checks(ids, np.arange(64)).sum() != good[3]


def test_long_texts_and_text_ids(spark):
    long = prose(random.Random(2), 150_000)
    assert len(long.encode()) > 1_000_000
    df = spark.createDataFrame([("a", long), ("b", "short"), (None, long)], "doc_id string, text string")
    index = T.shard_index(df).collect()
    assert all(r.intact for r in index)
    assert sum(p.n_tokens for r in index for p in r.docs if p.doc_id == "a") == sum(p.n_tokens for r in index for p in r.docs if p.doc_id is None) > 100_000


def test_reading_opens_the_wanted_shards_only(spark):
    from lexloom.llm.shared import Workspace

    with Workspace(spark, "t") as work:
        shards = T.write_shards(docs(spark, rows()), length=64, shard_bytes=2048, work=work)
        per, every = shards.layout.per_shard, held(shards)
        assert shards.sequences > 3 * per
        for first, count in ((0, 1), (per, 1), (per - 1, 2), (2 * per + 1, per)):
            part = shards.read(first, count)
            assert len(part.inputFiles()) == len({s // per for s in range(first, first + count)})
            assert {r.slot: bytes(r.ids) for r in part.collect()} == {s: every[s] for s in range(first, first + count)}
        assert shards.read(shards.sequences, 5).count() == 0 and shards.read(0, 0).count() == 0
        assert work.named and all(spark.catalog.tableExists(n) for n in work.named)
    assert not any(spark.catalog.tableExists(n) for n in work.named)
