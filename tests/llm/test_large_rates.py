from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing


def inverse(u, rate):
    """The least k with P(Poisson(rate) <= k) > u, summed from 0 in logarithms."""
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


@pytest.mark.parametrize("rate", [0.3, 31.0, 499.0, 501.0, 744.0, 5000.0])
def test_large_counts_are_inverse_poisson(spark, rate):
    got = spark.range(200).select(mixing.uniform("id", seed=3).alias("u")).select("u", mixing.poisson_count(F.col("u"), F.lit(rate)).alias("k")).collect()
    assert all(abs(r.k - inverse(r.u, rate)) <= (rate > 1000) for r in got) and [r.k for r in got][:20] != [got[0].k] * 20


def test_tiny_sources_meet_their_weights(spark):
    rows = [(i, "x" * 10, "big") for i in range(8000)] + [(10_000 + i, "x" * 10, "tiny") for i in range(4)] + [(20_000, "x" * 10, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = mixing.source_rates(df)
    assert {r.source_key: round(r.rate, 1) for r in rates.collect()} == {"big": 0.3, "tiny": 667.1, "one": 2668.3}
    got = mixing.mix_sources(df, rates).collect()
    n = Counter(r.source for r in got)
    assert all(abs(n[s] - 8005 / 3) < 5 * math.sqrt(8005 / 3) for s in ("big", "tiny", "one"))
    copies = Counter(r.doc_id for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and sorted(r.copy for r in got if r.doc_id == 20_000) == list(range(copies[20_000]))


def test_copies_beyond_one_chunk(spark):
    df = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, spark.createDataFrame([("s", 200_000.0)], "source_key string, rate double"))
    r = got.agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("m")).first()
    assert r.n == r.d == r.m + 1 and abs(r.n - 200_000) < 5 * math.sqrt(200_000)
