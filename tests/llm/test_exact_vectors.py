"""Codes and clusters of vectors against plain loops over unbounded integers."""

from __future__ import annotations

import math
import random
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from lexloom.llm import centroids as C
from lexloom.llm import exact_vectors as E
from lexloom.llm import vector_codes as V


def integers(v):
    return [math.floor(256 * Fraction(x)) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(points, centers, rounds):
    """(numbers, squared distances, centers) by plain loops."""
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        at = [min(range(len(centers)), key=lambda c: (d2(p, centers[c]), c)) for p in points]
        if r == rounds:
            return at, [d2(p, centers[a]) for p, a in zip(points, at)], centers
        members = [[p for p, a in zip(points, at) if a == c] for c in range(len(centers))]
        centers = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centers)]


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((i, integers(v), label) for i, v, label in rows if good(v))
    size, code, error, books = len(kept[0][1]) // parts, [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        points = [v[p * size : (p + 1) * size] for _, v, _ in kept]
        at, d, centers = lloyd(points, points[:entries], rounds)
        code, error, books = [c + f"{a:02x}" for c, a in zip(code, at)], [e + x for e, x in zip(error, d)], books + centers
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    digest = sha256(",".join(str(x) for row in books for x in row).encode()).hexdigest()
    return sorted((i, c, e, total[label], digest) for (i, _, label), c, e in zip(kept, code, error))


def codes(spark, rows, **options):
    found, books = V.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **options)
    out = V.with_totals(found, books).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(tuple(r) for r in out.collect())


def vectors(seed, n, dim, scale=1.0, step=0.0):
    rng = random.Random(seed)
    one = lambda: rng.gauss(0, scale) if not step else step * rng.randrange(-3, 4)
    return [(i, [one() for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("scale,step", [(0.3, 0), (1.0, 0.25), (1e9, 0)])
def test_codes_equal_plain_loops(spark, scale, step):
    rows = vectors(3, 700, 8, scale, step)
    if scale > 1e6:  # small errors around far places, so that the errors stay longs but bounds don't
        far = [[x * 1e9 for x in v] for _, v, _ in vectors(4, 5, 8)]
        rows = [(i, [a + b / 1e9 for a, b in zip(far[i % 5], v)], label) for i, v, label in rows]
    assert codes(spark, rows, parts=4, entries=20) == plain_codes(rows, 4, 20, 2)


def test_a_tree_assigns_as_full_comparison_does():
    rng = np.random.default_rng(5)
    for size, n, k in ((4, 3000, 64), (2, 500, 7), (4, 1, 3), (1, 17, 1)):
        points, entries = rng.integers(-40, 40, (n, size)), rng.integers(-40, 40, (k, size))
        tree = V.Tree.of(points)
        of, sums, counts = tree.assign(entries)
        want = np.argmin(((tree.points[:, None] - entries[None]) ** 2).sum(2), axis=1)
        assert (of == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == tree.points[want == e].sum(0)).all() for e in range(k)) and (points[tree.rows] == tree.points).all()


def test_odd_rows_of_codes(spark):
    rows = vectors(7, 30, 16)
    odd = rows + [(1, rows[1][1], 9), (1, rows[1][1], 9), (50, None, 1), (51, [1.0] * 15 + [None], 1), (52, [float("nan")] * 16, 1), (53, [float("inf")] * 16, 2), (54, [], 1), (55, [0.5] * 8, 1)]
    assert codes(spark, odd, parts=8, entries=10) == plain_codes([r for r in odd if r[0] < 50], 8, 10, 2)
    few = rows[:3]
    assert codes(spark, few, parts=16) == plain_codes(few, 16, 64, 2)
    assert codes(spark, []) == []
    clash = spark.createDataFrame([(1, [0.5] * 16, 1, 7, 8)], "vec_id long, embedding array<float>, label int, code int, error int")
    assert [r.code for r in V.encode(clash)[0].collect()] == ["00" * 16]


def test_hot_label_without_a_broadcast(spark, monkeypatch):
    rows = vectors(8, 60, 16)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    assert codes(spark, rows, entries=5) == plain_codes(rows, 16, 5, 2)


def plain_clusters(rows, k, rounds, seed=2, dim=8):
    kept = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), v, i) for i, v, _ in rows if v is not None and len(v) == dim and good(v))
    points = [integers(v) for _, v, _ in kept]
    at, d, centers = lloyd(points, points[:k], rounds)
    own = {c: sum(x for x, a in zip(d, at) if a == c) for c in at}
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((i, a, x, own[a], sum(d), digest[a]) for (_, _, i), a, x in zip(kept, at, d))


def clusters(spark, rows, **options):
    found, centers = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), dim=8, **options)
    return sorted(tuple(r) for r in C.with_inertia(found, centers).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("scale,step", [(0.3, 0), (1.0, 0.25), (1e4, 0), (1e5, 0)])
def test_clusters_equal_plain_loops(spark, scale, step):
    rows = vectors(11, 300, 8, scale, step)
    assert clusters(spark, rows, k=9) == plain_clusters(rows, 9, 5)


def test_distances_of_every_kind_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 24, 1 << 29, 1 << 40):
        x, c = rng.integers(-top, top, (20, 8)), rng.integers(-top, top, (5, 8))
        want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
        assert [[int(v) for v in row] for row in C.distances(x, c)] == want
    assert E.floors(np.array([0.1, -0.1, 1e300, -1e308])).tolist() == integers([0.1, -0.1, 1e300, -1e308])


def test_odd_rows_of_clusters(spark):
    rows = vectors(12, 20, 8)
    odd = rows + [(3, rows[3][1], 1), (60, None, 1), (61, [1.0] * 7, 1), (62, [float("nan")] + [0.0] * 7, 1), (63, [None] * 8, 1), (64, [], 1)]
    assert clusters(spark, odd, k=6) == plain_clusters(odd, 6, 5)
    assert clusters(spark, rows[:4], k=40) == plain_clusters(rows[:4], 40, 5)
    assert clusters(spark, []) == []
    null = spark.createDataFrame([(None, [1.0] * 8), (1, [2.0] * 8)], "vec_id long, embedding array<float>")
    assert len(C.cluster(null, dim=8)[0].collect()) == 2
