from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import bytescan as bs
from lexloom.llm import decontaminate, licenses, mixing, ngram_join, quality_model, quality_rules, token_shards, toxicity, url_filter, warc
from lexloom.llm.components import components
from lexloom.llm.shared import Workspace, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def docs(spark, rows):
    """Rows (id, text[, source]) with an extra column whose name clashes with an internal one."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumn("key", F.lit("clash")).withColumn("score", F.lit("clash"))


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "bravo", "delta", "écho", "golf", "hotel", "india", "kilo", "lima", "mike", "oscar", "papa"]) + str(rng.randrange(30)) for _ in range(n))


# words and hashes


@given(st.lists(st.text(alphabet="ab \n\t\u00e9\u3000\x0b|#", max_size=30), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = scanned(texts)
    starts, ends = bs.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for t in texts for w in WORD.findall(t)]
    assert bs.counts(starts, offsets).tolist() == [len(WORD.findall(t)) for t in texts]
    hashes = bs.span_hash(bs.prefix(data), starts, ends)
    assert len(set(hashes.tolist())) == len({w for t in texts for w in WORD.findall(t)})


# 1


def test_license_forms(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 X\n\n" + mit.upper().replace(",", " ;")), (3, mit.replace("sublicense", "sub-licence")), (4, "text\nReleased under the MIT Licence.\nmore\nAll rights reserved."), (5, mit + " extra"), (6, None), (7, ""), (8, "Copyright 2020"), (1, mit), (None, "Licensed under CC BY-NC 4.0.")]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].license for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", "MIT", None, None]
    assert by[4].notices == "MIT,all-rights-reserved" and by[4].n_notice_lines == 2 and by[6].text_digest is None and by[7].license is None and by[8].license is None
    assert by[None].notices == by[None].license == "CC-BY-NC-4.0"
    assert licenses.scan_licenses(docs(spark, rows).limit(0)).count() == 0


# 2


@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    f = token_shards.Feistel(n, key)
    slots = f.slots(np.arange(n))
    assert np.array_equal(np.sort(slots), np.arange(n)) and np.array_equal(f.numbers(slots), np.arange(n))


def test_shards_round_trip(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(60)] + ["", None, "é" * 3000, "same", "same"]
    df = docs(spark, list(enumerate(texts)) + [(None, "null id"), (3, texts[3])]).repartition(3)
    shards = token_shards.write_shards(df, length=64, shard_bytes=64 * 2 * 16)
    held = {r.slot: np.frombuffer(bytes(r.ids), "<u2") for r in shards.read().collect()}
    m = {r.slot: r for r in shards.manifest().collect()}
    assert set(held) == set(m) == set(range(shards.sequences)) and shards.sequences > 32
    assert [r.slot for r in shards.read(20, 7).orderBy("slot").collect()] == list(range(20, 27))
    order = shards.order.numbers(np.arange(shards.sequences))
    stream = [None] * shards.sequences
    for slot, ids in held.items():
        stream[order[slot]] = ids[: m[slot].n_tokens]
    ranks = open(token_shards.VOCABULARY, "rb").read()
    assert Counter(_texts(np.concatenate(stream), ranks)) == Counter([t or "" for t in texts] + ["null id", texts[3]])
    assert token_shards.shard_index(df, length=64, shard_bytes=2048).where("not intact").count() == 0
    assert token_shards.shard_index(df.limit(0)).count() == 0


def _texts(ids, ranks):
    out = np.split(ids, np.flatnonzero(ids == token_shards.END) + 1)
    return [token_shards._encoder(ranks).decode(x[:-1].tolist()) for x in out if len(x)]


# 3

PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box up the jugs, and nobody minds."


def edited(rng, text, k):
    chars = list(text)
    for _ in range(k):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], [chars[at], "q"], ["z"]])
    return "".join(chars)


def distance(p, t):
    """Least edits between p and any piece of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    norm = lambda t: decontaminate.normalise(*scanned([t]))[0].tobytes()
    p = norm(PASSAGE).strip()
    rows = []
    for i in range(80):
        body = edited(rng, PASSAGE, rng.randrange(0, 12)) if i % 2 else ""
        rows.append((i, f"{prose(rng, rng.randrange(0, 60))} {body.upper() if i % 3 else body}, {prose(rng, 5)}"))
    rows += [(100, None), (101, ""), (102, PASSAGE), (102, PASSAGE), (None, "x " + PASSAGE.replace(" ", "\n"))]
    bench = spark.createDataFrame([(7, PASSAGE), (8, None), (9, "short"), (None, PASSAGE)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs(spark, rows), bench).collect())
    k = int(len(p) * decontaminate.RATE)
    want = Counter((i, 7, e) for i, t in rows if (e := distance(p, norm(t or ""))) <= k)
    assert got == want and len({e for _, _, e in want}) > 3
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.count() == len(rows) - sum(want.values()) and kept.columns == docs(spark, rows).columns
    exact = decontaminate.leaks(docs(spark, [(1, "é« " + PASSAGE + " »")]), bench).first()
    assert (exact.start, exact.end) == (3, 3 + len(PASSAGE) - 1)
    assert decontaminate.leaks(docs(spark, rows).limit(0), bench).count() == 0 and decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


# 4


def shingle_set(text):
    w = WORD.findall(text or "")
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, threshold=0.8):
    sets, root, links = [shingle_set(t) for _, t in rows], list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(rows[i][0], rows[find(i)][0], links[i]) for i in range(len(rows))]


def near_rows():
    rng, rows = random.Random(3), []
    for g in range(12):
        base = prose(rng, rng.randrange(30, 120)).split()
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(900, ""), (901, ""), (902, None), (903, "one two"), (904, "one\ttwo"), (905, "three")]


@pytest.mark.parametrize("block", [256, 4])
def test_classes_equal_brute_force(spark, block):
    rows = near_rows()
    got = ngram_join.similarity_classes(docs(spark, rows), block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute_classes(rows))


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    repeated = [*rows, rows[0], rows[0], (rows[1][0], "quite another text under a used id"), (None, "nameless text of six words here"), (None, "nameless text of six words here")]
    for data in (rows, repeated):
        df = docs(spark, data)
        kept = ngram_join.drop_near_duplicates(df)
        texts = [r.text for r in kept.collect()]
        sets = [shingle_set(t) for t in texts]
        assert all(not (a & b) or len(a & b) / len(a | b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
        assert len([t for t in texts if WORD.search(t or "")]) == len({c for i, c, _ in brute_classes([(k, t) for k, (_, t) in enumerate(data) if shingle_set(t)])})
        assert kept.columns == df.columns and sum(not shingle_set(t) for t in texts) == 3
    assert ngram_join.drop_near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_pruning_bound():
    for n in (16, 32, 64):
        m = ngram_join.least_matches(n, 0.8, 1e-6)
        # the posterior by integration over similarities
        s = np.linspace(0, 1, 200_001)
        tail = lambda k: (s**k * (1 - s) ** (n - k))[s >= 0.8].sum() / (s**k * (1 - s) ** (n - k)).sum()
        assert tail(m) >= 1e-6 * 0.99 and tail(m - 1) < 1e-6 * 1.01


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark, spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c")
    assert {r.node: r.root for r in got.collect()} == root


# 5


@given(st.lists(st.text(alphabet="ab# \n\t\u00e9|", max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_counts_equal_brute_force(texts):
    got = list(zip(*quality_rules.count_all(*scanned(texts))))
    for t, row in zip(texts, got):
        w, seen, dup = WORD.findall(t), set(), 0
        lines = [x for x in t.split("\n") if WORD.search(x)]
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = list(zip(w, w[1:], w[2:]))
        times = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        assert tuple(map(int, row[:6])) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), len(lines))


def test_upper_bounds_are_exact():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0 and quality_rules.upper_bound(3, 50, 0.05) == pytest.approx(0.1478, abs=1e-3)


def test_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80)) for i in range(1500)] + [(2000 + i, " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(60)] + [(3000, None), (3001, ""), (3002, prose(rng, 49)), (3003, "a b c " * 40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.rule_quality(docs(spark, rows), labels, risk=0.2).collect()}
    assert all(got[i].kept for i in range(1500)) and not any(got[2000 + i].kept for i in range(60)) and not got[2000].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (3000, 3001, 3002, 3003)) and got[3003].n_repeat_words == 120
    few = quality_rules.rule_quality(docs(spark, rows), labels.limit(10))
    assert few.where("not base_failed and not kept").count() == 0
    assert quality_rules.rule_quality(docs(spark, rows).limit(0), labels).count() == 0


# 6 and 10


def test_quality_is_learnt_from_training_rows_alone(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 2 else " | ".join(prose(rng, 60).split())) for i in range(600)] + [(1000, None), (1001, ""), (None, "x")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.quality_scores(df, labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert 120 < len(held) < 280 and sum(got[i].predicted == i % 2 for i in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and len(got) == 603
    # other labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality_model.quality_scores(df, turned).collect()} == {i: r.score for i, r in got.items()}
    assert {r.score for r in quality_model.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality_model.keep_good(df, quality_model.fit(df, labels)).columns == df.columns


def test_toxic_words_and_spans(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        w = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["Grumblefink,", "snorkwad", "snorkwads"])
        rows.append((i, " ".join(w) + "."))
    rows += [(2000, None), (2001, ""), (2002, "é snorkwad!"), (None, "plain")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs(spark, rows), labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) > 0.98 * len(held) and not got[2000].predicted and not got[2001].predicted
    assert [(s.start, s.end) for s in got[2002].spans] == [(2, 10)]
    assert {r.score for r in toxicity.toxicity_scores(docs(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    length = np.array([4, 1, 3])
    e, trans = rng.normal(size=8), np.exp(rng.normal(size=(2, 2)))
    p, pairs = toxicity._forward_backward(e, trans, np.array([0, 4, 5]), length, pair_sums=True)
    want, sums = np.zeros(8), np.zeros((2, 2))
    for a, n in zip((0, 4, 5), length):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[a + k] for k in range(n) if y[k])) * np.prod([trans[u, v] for u, v in zip(y, y[1:])])
            total += w
            one += w * np.array(y)
            for u, v in zip(y, y[1:]):
                two[u, v] += w
        want[a : a + n] = one / total
        sums += two / total
    assert np.allclose(p, want) and np.allclose(pairs, sums)


# 7


def test_mixing_meets_its_rates(spark):
    rows = [(i, "x" * 10, "big" if i % 4 else "small") for i in range(4000)] + [(5000, None, "big"), (5001, "", None), (5001, "", None)]
    df = docs(spark, rows)
    rates = {r.source_key: r.rate for r in mixing.source_rates(df).collect()}
    assert rates["big"] == pytest.approx(40000 / 3 / 30000) and rates["small"] == pytest.approx(40000 / 3 / 10000) and rates[mixing.NO_SOURCE] == 0
    got = mixing.mix_sources(df, mixing.source_rates(df, {"big": 1.0, "small": 3.0}))
    n = Counter(r.source for r in got.collect())
    assert abs(n["small"] - 3 * n["big"]) < 300 and n[None] == 0 and got.columns == [*df.columns, "copy", "mix_key"]
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix_sources(df.repartition(7), mixing.source_rates(df, {"big": 1.0, "small": 3.0})).collect()))
    counts = spark.range(20000).select(mixing.poisson_count(mixing.uniform("id", seed=1), F.lit(2.5)).alias("k")).toPandas().k
    assert counts.mean() == pytest.approx(2.5, abs=0.05) and counts.var() == pytest.approx(2.5, abs=0.12)
    assert mixing.mix_sources(df.limit(0), mixing.source_rates(df)).count() == 0


# 8


@pytest.mark.parametrize("url, want", [
    ("http://a.example.com/en/1", ("a.example.com", "/en/1", "example.com/en/", "block")), ("http://www.EXAMPLE.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")), ("https://x.com?q=/", ("x.com", "", None, "allow")),
    ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")), ("ftp://b.net/fr/x#y", ("b.net", "/fr/x", "net/fr/", "block")), ("http://cheap-pills.org/", ("cheap-pills.org", "/", None, "block")), ("http://cheap.org/cheap", ("cheap.org", "/cheap", None, "allow")),
    ("http://sussex.org/", ("sussex.org", "/", None, "allow")), ("http://a.org/sex", ("a.org", "/sex", None, "block")), (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("://", ("", "", None, "allow")), ("http://a.org/x://b.com/en/", ("a.org", "/x://b.com/en/", None, "allow")),
])
def test_urls(spark, url, want):
    r = url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


# 9


def test_archives(spark):
    rows = [(3, "http://a/\r\nx", "same é"), (1, "u1", "same é"), (2, "u2", "other\r\n\r\nWARC/1.1"), (5, None, None), (4, "u4", ""), (2, "u2", "other\r\n\r\nWARC/1.1"), (None, "n", "same é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == [
        (1, 7, b32("same é"), "response", None), (2, 17, b32(rows[2][2]), "response", None), (2, 17, b32(rows[2][2]), "response", None), (3, 7, b32("same é"), "revisit", 1), (4, 0, b32(""), "response", None), (5, 0, b32(""), "revisit", 4), (None, 7, b32("same é"), "revisit", 1),
    ]
    assert all(r.record_type == "response" for r in warc.round_trip(pages, least=100).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0
