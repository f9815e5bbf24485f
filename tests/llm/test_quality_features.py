"""The classifier's pooling, network and temperature against plain loops; its stage against its scores."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lexloom.llm import quality_model as Q
from lexloom.llm.shared import held_out
from lexloom.llm.training import temperature

from conftest import SF
from test_llm_operators import docs, prose, scanned

LEXEME = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff \t-\r]+")


def plain(text, vectors):
    """A document's features, word by word."""
    words = LEXEME.findall(text)
    bucket = {w: int(Q._buckets(*scanned([w]))[0][0]) for w in set(words)}
    v = [vectors[bucket[w]].astype(np.float64) for w in words]
    n = max(len(v), 1)
    mean = sum(v, np.zeros(Q.DIM)) / n
    caps = sum(bool(re.fullmatch("[A-Z]{2,}", w)) for w in words) / n
    parts = [mean + 4 * caps * vectors[Q.CAPS]]
    for lag in Q.LAGS:
        parts.append(sum((a * b for a, b in zip(v, v[lag:])), np.zeros(Q.DIM)) / n)
    return np.concatenate([*parts, [math.log1p(len(v)) / 10]])


def test_pooling_equals_loops():
    rng = random.Random(1)
    texts = [prose(rng, 30), "", "A BB CC, dd!! ÉÉ", "one", "x x x x", "  \n\t", "ab" * 50 + " é—à"]
    vectors = Q.word_vectors(np.random.default_rng(2).normal(size=(Q.BUCKETS + 1, Q.DIM)).astype(np.float32))
    got = Q.pooled(*scanned(texts), vectors)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain(text, vectors), atol=1e-4)


def test_neighbours_equal_loops():
    import pyarrow as pa

    texts = ["a b c d", "c a", "", "b b"]
    got = Q.neighbour_sums(iter([pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["id", "text"])]), 1)
    index, want = Q.index_vectors(), np.zeros_like(Q.index_vectors())
    for text in texts:
        b = Q._buckets(*scanned([text]))[0].tolist()
        for i, x in enumerate(b):
            for j, y in enumerate(b):
                if i != j and abs(i - j) <= 2:
                    want[x] += index[y]
    assert np.allclose(got, want)


def test_logits_and_temperature():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 4))
    weights = (rng.normal(size=4), rng.uniform(1, 2, 4), rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.3))
    mean, scale, w1, b1, w2, b2 = weights
    for row, got in zip(x, Q.QualityModel(None, weights, 0.5).logits(x)):
        hidden = [max(0.0, sum((row[i] - mean[i]) / scale[i] * w1[i, j] for i in range(4)) + b1[j]) for j in range(3)]
        assert got == pytest.approx(sum(h * w for h, w in zip(hidden, w2)) + b2)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 2.5))).astype(float)
    loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - y * z / t))
    best = min(np.exp(np.linspace(-3, 3, 4001)), key=loss)
    assert temperature(z, y) == pytest.approx(best, rel=0.01) and 2 < best < 3


def test_cold_models_stay_cold():
    z = np.array([-1.0, 1.0] * 200)
    assert temperature(z, (z > 0).astype(float)) < 0.1


def test_ids_of_any_type_and_long_texts(spark):
    rng = random.Random(6)
    texts = {f"id{i}": prose(rng, 60) if i % 2 else " | ".join(prose(rng, 60).split()) for i in range(400)}
    df = spark.createDataFrame([*texts.items(), ("long", prose(rng, 150_000)), ("long", prose(rng, 10)), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(k, int(k[2:]) % 2) for k in texts], "doc_id string, quality int")
    got = Q.quality_scores(df, labels).collect()
    assert len(got) == 403 and sum(r.predicted == int(r.doc_id[2:]) % 2 for r in got if r.doc_id in texts) > 380


def test_repeated_ids_stay_bounded(spark):
    from lexloom.llm.shared import Workspace
    from lexloom.llm.training import training_rows

    rows = docs(spark, [(2, f"text {i}") for i in range(500)] + [(3, "b"), (5, "c")])
    labels = spark.createDataFrame([(2, 1), (3, 0), (5, 0)], "doc_id long, quality int")
    assert training_rows(rows, labels, "quality", 100, Workspace(spark, "t")).count() <= 3


def test_stage_keeps_what_scores_well(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.fit(docs_, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in Q.score(docs_, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in corpus_pipeline.good_quality(spark, docs_, SF).collect()} == want


def test_few_labels_and_empty_documents(spark):
    rng = random.Random(8)
    texts = [(3 * i, prose(rng, 40) if i % 2 else " | ".join(prose(rng, 40).split())) for i in range(30)]
    df = docs(spark, texts + [(1000, None), (1001, ""), (1002, " ")])
    for n in (2, 3, 7):  # any number of labels of both classes gives a network
        labels = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(texts)], "doc_id long, quality int").where(~held_out("doc_id")).limit(n)
        model = Q.fit(df, labels)
        assert (model.weights is not None) == (len({r.quality for r in labels.collect()}) == 2) and 0.04 < model.heat < 21
    got = {r.doc_id: r.score for r in Q.quality_scores(df, spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(texts)], "doc_id long, quality int")).collect()}
    assert len({round(got[i], 9) for i in (1000, 1001, 1002)}) == 1 and all(0 <= s <= 1 for s in got.values())
    assert temperature(np.zeros(0), np.zeros(0)) == pytest.approx(1, rel=1e-3)
