from __future__ import annotations

import random

from lexloom.llm import quality_rules

NONE = dict.fromkeys(quality_rules.RULES, 0)


def test_small_strata_get_rules(spark):
    """200 good labels certify in each of four languages, and a language of ten labels costs the others nothing."""
    rng = random.Random(1)
    words = lambda mark: " ".join(rng.choice(["alpha", "bravo", "delta", "golf"]) + str(rng.randrange(900)) + mark for _ in range(70))
    rows, labels = [], []
    for lang, n in (("a", 330), ("b", 330), ("c", 330), ("d", 330), ("e", 10)):
        for k in range(n + 20):
            rows.append((len(rows), words("" if k < n else "###"), lang))
            labels.append((len(labels), int(k < n)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.rule_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(got[i].base_failed for i in got)
    assert all(got[i].kept == (q == 1 or rows[i][2] == "e") for i, q in labels)


def test_joint_risk_is_held():
    """Rules that reject different good texts are counted together."""
    def safe(symbols, capitals):
        stats = [{"stratum": "x", "n": 1000 - symbols - capitals, **NONE}, {"stratum": "x", "n": symbols, **NONE, "symbols": 10}, {"stratum": "x", "n": capitals, **NONE, "capitals": 10}]
        return {rule for _, rule, _ in quality_rules.certified(stats, 0.03, 0.05)}

    assert safe(15, 0) >= {"symbols", "capitals"} and safe(0, 15) >= {"symbols", "capitals"}
    assert not {"symbols", "capitals"} <= safe(15, 15)
