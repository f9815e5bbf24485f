from __future__ import annotations

import numpy as np

from lexloom.llm import ngram_join


def test_a_pair_at_the_threshold_is_not_lost(spark):
    """Of many pairs at similarity 0.8, those that share no four values of a band of four are linked too."""
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(20_000):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 49)]
        texts += [" ".join(w), " ".join([*w[:24], "other", *w[25:]])]
    raw = [t.encode() for t in texts]
    _, _, grams, per_row = ngram_join._digests(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    sig = ngram_join._signatures(grams, per_row)
    same = sig[::2] == sig[1::2]
    hard = np.flatnonzero(~same.reshape(-1, 16, 4).all(2).any(1))
    assert len(hard) > 0
    rows = [(int(2 * i + k), texts[2 * i + k]) for i in hard for k in (0, 1)]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got)


def test_bands_meet_the_tolerance():
    assert (1 - 0.8**ngram_join.BAND) ** (ngram_join.HASHES // ngram_join.BAND) < 1e-6
