"""Removal of repeated passages against every window of every text."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest

from lexloom.llm import repeats as R

WIDTH = 50


def brute(rows, width=WIDTH):
    """(id, bytes, removed bytes, runs, digest of the rest) by a table of all windows; null ids are one document after all others."""
    order = lambda i: (i is None, i if i is not None else 0)
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < order(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone)), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, schema="doc_id long, text string", **options):
    found = R.without_repeats(spark.createDataFrame(rows, schema), **options)
    return sorted((tuple(r) for r in R.digests(found).collect()), key=str)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}ö{rng.randrange(words)}" for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_passages_edits_and_copies(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randrange(4, 40)) for _ in range(6)]
    rows = []
    for i in range(80):
        text = prose(rng, rng.randrange(0, 60))
        for s in rng.sample(shared, rng.randrange(0, 4)):
            at = rng.randrange(len(text) + 1)
            cut = rng.randrange(len(s))
            text = text[:at] + rng.choice([s, s[cut:], s[:cut], s[: cut] + "#" + s[cut:]]) + text[at:]
        rows.append((rng.randrange(60), text))
    rows += [(100 + n, rows[n % 7][1]) for n in range(30)]
    assert ours(spark, rows) == brute(rows)


def test_exact_length_borders_and_periods(spark):
    rng = random.Random(9)
    a = prose(rng, 30).encode()[:49].decode(errors="ignore").ljust(49, "x")[:49]
    rows = [(0, "q" + "z" * 49), (1, "z" * 49 + "r"), (2, "z" * 50), (3, "z" * 49), (4, "z" * 500), (5, "ab" * 300), (6, "ba" * 40 + "c" + "ab" * 30), (7, a + "1"), (8, a + "2"), (9, "x" + a + "1y"), (10, "abc" * 400), (11, "cab" * 20)]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("width", [4, 5, 6, 7, 16, 33, 51])
def test_other_widths(spark, width):
    rng = random.Random(width)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(3 * width)))) for i in range(40)] + [(n, "abc" * width) for n in range(3)]
    found = R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
    assert sorted((tuple(r) for r in R.digests(found).collect()), key=str) == brute(rows, width)


def test_nulls_repeated_rows_and_ids_of_text(spark):
    rng = random.Random(4)
    t, u = prose(rng, 40), prose(rng, 30)
    rows = [(None, t), (None, t + u), (3, t), (3, t), (3, u + t), (5, None), (None, None), (6, ""), (7, u)]
    assert ours(spark, rows) == brute(rows)
    named = [("b", t), ("a", "x" + t), ("c", u), ("aa", u)]
    raw = {i: (n, r) for i, n, r, _, _ in ours(spark, named, "doc_id string, text string")}
    assert raw["b"][1] == len(t.encode()) and raw["a"][1] == 0 and raw["c"][1] == len(u.encode()) and raw["aa"][1] == 0
    assert ours(spark, [], "doc_id long, text string") == []


def test_other_columns_stay_out_and_real_outputs(spark):
    t = prose(random.Random(1), 40)
    rows = spark.createDataFrame([(1, t, b"x", 5), (2, "begin " + t + " end", b"y", 6)], "doc_id long, text string, rk binary, spans int")
    found = {r.doc_id: r for r in R.without_repeats(rows).collect()}
    assert found[1].kept.decode() == t and found[2].kept == b"begin  end" and [tuple(x) for x in found[2].removed] == [(6, 6 + len(t.encode()))]


def test_very_long_text(spark):
    rng = random.Random(2)
    long = prose(rng, 60_000)
    rows = [(1, long[300_000:300_700]), (2, long), (3, prose(rng, 20) + long[1000:5000])]
    got = {r[0]: r for r in ours(spark, rows)}
    assert got[1][2] == 0 and got[2][2] == len(long[300_000:300_700].encode()) and got[3][2] == len(long[1000:5000].encode())
