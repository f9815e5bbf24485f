"""Passages of every length within their whole budget, against full alignment; large blocks; long texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import decontaminate as D

from test_llm_operators import docs, edited, prose, scanned


def normal(text):
    return D.normalise(*scanned([text]))[0].tobytes()


def best(p, t):
    """Fewest edits between p and a piece of t, the earliest end, the latest start: by the full table."""
    row = [(0, -j) for j in range(len(t) + 1)]
    for i, c in enumerate(p, 1):
        new = [(i, 0)]
        for j, x in enumerate(t, 1):
            new.append(min((row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]), (row[j - 1][0] + (c != x), row[j - 1][1])))
        row = new
    edits = min(e for e, _ in row)
    end = next(j for j, (e, _) in enumerate(row) if e == edits)
    return edits, end, -row[end][1]


@pytest.mark.parametrize("size", [1, 3, 7, 10, 12, 13, 19, 23, 24, 25, 28, 38, 39, 50, 60, 63, 110])
def test_every_length_has_its_budget(size):
    rng = random.Random(size)
    base = normal(prose(rng, 40))[: size + 30].decode(errors="ignore").strip()
    passage = base[:size].strip() or "x"
    p = normal(passage).strip()
    k, found = int(len(p) * D.RATE), set()
    block = D.Passages.of([(7, passage)])
    for n in range(60):
        body = edited(rng, passage, rng.randrange(0, min(k + 3, len(passage))))
        text = f"{prose(rng, rng.randrange(0, 6))} {body} {prose(rng, rng.randrange(0, 4))}"
        framed = len(p) < D.WHOLE
        want = best(b" " + p + b" " if framed else p, b" " + normal(text) + b" " if framed else normal(text))
        got = block.search(*scanned([text]))
        assert [(r, i, e) for r, i, e, _, _ in got] == ([(0, 7, want[0])] if want[0] <= k else [])
        if got and not framed:
            a, b = got[0][3:]
            assert normal(text[a:b]).strip() == normal(text)[want[2] : want[1]].strip()
        found |= {e for _, _, e, _, _ in got}
    assert len(found) > min(k, 2)


def test_short_passages_are_whole_words():
    block = D.Passages.of([(1, "cat"), (2, "a b"), (3, "…")])
    rows = ["the cat sat", "concatenate", "cat", "A, b!", "xa b", ""]
    assert sorted((r, i, s, e) for r, i, _, s, e in block.search(*scanned(rows))) == [(0, 1, 4, 7), (2, 1, 0, 3), (3, 2, 0, 4)]


def test_alignment_keeps_to_its_band():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p, t = (bytes(rng.integers(97, 100, n).tolist()) for n in rng.integers(4, 30, 2))
        k = int(rng.integers(0, 4))
        want = best(p, t)
        got = set()
        for low in range(-len(p) - k, len(t) + k + 1, k + 1):  # all half-overlapping bands
            one = list(D.align([p], np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), np.array([low]), np.array([k])))
            got |= {(e, b, -a) for _, e, a, b in one}
        assert (min(got) if got else None) == ((want[0], want[1], -want[2]) if want[0] <= k else None)


def test_many_items_and_rows_do_not_overflow():
    items = [(n, f"w{n:06d} item") for n in range(300_000)]
    rows = ["nothing here"] * 9_998 + ["say w299999 item now", "w000007 item"]
    assert sorted(x[:3] for x in D.Passages.of(items).search(*scanned(rows))) == [(9_998, 299_999, 0), (9_999, 7, 0)]


def test_blocks_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    passages = [prose(rng, 20) for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(passages), (None, "a nameless passage of the benchmark, long enough to tell")], "item_id long, text string")
    long = prose(rng, 150_000)
    assert len(long) > 1_000_000
    rows = [(n, f"{prose(rng, 30)} {passages[n % 12] if n % 2 else ''} {prose(rng, 9)}") for n in range(40)] + [(100, long + " " + passages[3]), (101, long), (102, "x a nameless passage of the benchmark, long enough to tell")] * 2
    df = docs(spark, rows)
    whole = Counter((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in D.leaks(df, bench).collect())
    kept = sorted(r.doc_id for r in D.drop_contaminated(df, bench).collect())
    assert Counter({i: c for (i, *_), c in whole.items()}) == Counter({**{n: 1 for n in range(1, 40, 2)}, 100: 2}) and kept == sorted([*range(0, 40, 2), 101, 101])
    assert all(long[:10] and (rows[40][1][s:e] == passages[3].strip()) for (i, _, _, s, e) in whole if i == 100)
    monkeypatch.setattr(D, "BLOCK", 400)
    assert Counter((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in D.leaks(df, bench).collect()) == whole
    assert sorted(r.doc_id for r in D.drop_contaminated(df, bench).collect()) == kept


def test_passages_with_ids_of_other_types(spark):
    texts = docs(spark, [(1, "x " + "the quick brown fox jumps over the lazy dog again and again " + "y"), (2, "nothing here")])
    bench = spark.createDataFrame([("q0", "The quick brown fox jumps over the lazy dog, again and again!"), (None, "nothing here")], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in D.leaks(texts, bench).collect()] == [(1, "q0", 0)]
    assert D.drop_contaminated(texts, bench).count() == 0
    narrow = bench.selectExpr("cast(7 as int) as item_id", "text").limit(1)
    assert [(r.item_id, t) for r in D.leaks(texts, narrow).collect() for t in [dict(D.leaks(texts, narrow).dtypes)["item_id"]]] == [(7, "int")]
