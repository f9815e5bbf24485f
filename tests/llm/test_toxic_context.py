"""What the chain and the company of words add; relabelling; odd inputs."""

from __future__ import annotations

import random

import numpy as np

from lexloom.llm import toxicity
from lexloom.llm.shared import held_out

from test_llm_operators import prose


def auc(scores, y):
    values, inverse, times = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def runs_of_words(spark):
    """Toxic texts hold runs of doubtful words; clean texts hold as many of them apart."""
    rng, rows, labels = random.Random(3), [], []
    doubtful = [f"zork{c}" for c in "abcdefgh"]
    for i in range(1500):
        w, toxic = prose(rng, 60).split(), i % 4 == 0
        if toxic:
            at = rng.randrange(50)
            w[at : at + 4] = [rng.choice(doubtful) for _ in range(4)]
        elif rng.random() < 0.15:
            for at in rng.sample(range(0, 60, 6), 4):
                w[at] = rng.choice(doubtful)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_the_chain_matters(spark):
    docs, labels = runs_of_words(spark)
    found = {}
    for name, options in {"field": {}, "words alone": {"chain": False, "rounds": 0}}.items():
        model = toxicity.fit(docs, labels, **options)
        if name == "words alone":  # without what stands around a word, too
            model.weights[-(1 << toxicity.CONTEXT) :] = 0
        got = toxicity.tag(docs, model).join(labels, "doc_id").where(held_out("doc_id")).select("score", "toxic").toPandas()
        found[name] = auc(got.score.to_numpy(), got.toxic.to_numpy())
        if name == "field":
            assert model.trans[1, 1] * model.trans[0, 0] > 2 * model.trans[0, 1] * model.trans[1, 0]  # toxic words come in runs
    assert found["field"] > 0.98 and found["field"] > found["words alone"] + 0.02


def test_labels_are_estimated_given_the_text():
    """Against enumeration: at least one word of a toxic text is toxic, none of a clean one."""
    rng = np.random.default_rng(5)
    length, owner, toxic = np.array([3, 2, 2, 4]), np.array([7, 7, 8, 9]), np.array([True, True, False, True])
    e, trans = rng.normal(-2, 1, 11), np.exp(rng.normal(size=(2, 2)))
    chains = toxicity.Chains(np.zeros((11, toxicity.FEATURES), np.int32), np.zeros(11, bool), length, owner, toxic)
    got = toxicity._relabelled(chains, e, trans)
    want, begin = np.zeros(11), np.cumsum(length) - length

    def paths(k):
        for code in range(2 ** length[k]):
            y = [(code >> t) & 1 for t in range(length[k])]
            yield y, np.exp(sum(e[begin[k] + t] for t in range(length[k]) if y[t])) * np.prod([trans[u, v] for u, v in zip(y, y[1:])])

    for text in (7, 9):
        ks = [k for k in range(4) if owner[k] == text]
        total, sums = 0.0, np.zeros(11)

        def walk(ks, weight, on):
            nonlocal total
            if not ks:
                if on:
                    total += weight
                    sums[on] += weight
                return
            for y, w in paths(ks[0]):
                walk(ks[1:], weight * w, on + [begin[ks[0]] + t for t in range(length[ks[0]]) if y[t]])

        walk(ks, 1.0, [])
        want += sums / total
    assert np.allclose(got, want)


def test_odd_inputs(spark):
    docs, labels = runs_of_words(spark)
    model = toxicity.fit(docs, labels)
    long = prose(random.Random(4), 150_000) + " zorka zorkb zorkc zorkd"
    rows = [("a", long), ("a", long), (None, None), ("b", ""), ("c", "zorka zorkb zorkc zorkd")]
    odd = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "'x' as score", "1 as spans", "'y' as toxic")
    got = [(r.doc_id, r.score, [(s.start, s.end) for s in r.spans]) for r in toxicity.tag(odd, model).collect()]
    assert len(got) == 5 and len({(i, s) for i, s, _ in got}) == 4
    by = {i: (s, spans) for i, s, spans in got}
    assert by[None][0] == by["b"][0] < 0.5 < by["c"][0] and by["c"][1] == [(0, 23)] and by["a"][1][-1] == (len(long) - 23, len(long))
    assert toxicity.tag(odd.limit(0), model).count() == 0
    named = spark.createDataFrame([(f"id{i}", t, y) for i, (t, y) in enumerate([("zork zork zork", 1), ("alpha bravo", 0)] * 200)], "doc_id string, text string, toxic int")
    assert toxicity.toxicity_scores(named.drop("toxic"), named.drop("text")).count() == 400
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
