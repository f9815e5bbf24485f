"""Vector codes: each vector is cut into parts, and each part is named by the nearest entry of its position's codebook.

Codebooks are trained by Lloyd's rounds in the filtering form.  Every partition keeps, for each chunk of its vectors and each
position, a kd-tree over the parts: the parts in tree order, and for each node the bounding box, sum and count.  In a round the
entries go down the tree: of a node's entries one is nearest to the box's middle, and an entry that is farther than that one from
the box's corner in its own direction is farther from every part in the box, so it is dropped.  A node with one entry left is
assigned as a whole by its cached sum and count; in a leaf the parts are compared with the entries that are left.
Trees are built once and written; rounds read them, sums are combined in a tree of tasks, and the driver holds codebooks only.

All values are integers floor(256 x), 64-bit ones where bounds prove them exact and unbounded ones otherwise.

Defined cases: rows whose vector is null or holds null or non-finite components are left out, and so are vectors whose length
differs from that of the smallest id whose length is a positive multiple of ``parts``.  With fewer kept rows than ``entries`` each
row is an entry.  Repeated rows count each; equal ids start in the order of their vectors, null ids come last.  Ties of distance
go to the lower index.  No rows give no rows.  Other columns aren't read.  Errors above 2^63 - 1 can't be returned as longs and raise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_vectors import LONG, floors, group_sums, largest, matrix, tree_sum, whole, wide
from .shared import Workspace, bare

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a chunk, and parts of a leaf at most.
CHUNK, LEAF = 1 << 14, 16
#: Labels up to which their sums are broadcast: a few dozen bytes each.
BROADCAST_LABELS = 50_000
_MAX = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A balanced kd-tree in arrays: ``points`` in tree order, of the rows ``rows``; level l has 2^l nodes."""

    rows: np.ndarray
    points: np.ndarray
    low: list[np.ndarray]  # of each level: corners, sums and counts of the nodes
    high: list[np.ndarray]
    sums: list[np.ndarray]
    begin: np.ndarray  # of each leaf, and the end

    @staticmethod
    def of(points: np.ndarray, leaf: int = LEAF) -> Tree:
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        begin = np.arange(2**depth + 1) * n // 2**depth
        rows = np.arange(n)
        for level in range(depth):
            edge = begin[:: 2 ** (depth - level)]
            node = np.repeat(np.arange(2**level), np.diff(edge))
            now = points[rows]
            spread = np.maximum.reduceat(now, edge[:-1]) - np.minimum.reduceat(now, edge[:-1])
            along = np.argmax(spread, axis=1)[node]
            rows = rows[np.lexsort((now[np.arange(n), along], node))]  # nodes stay where they are
        points = points[rows]
        point_sums = wide(points, largest(points) * max(n, 1) < LONG)
        low, high, sums = [np.minimum.reduceat(points, begin[:-1])], [np.maximum.reduceat(points, begin[:-1])], [np.add.reduceat(point_sums, begin[:-1])]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return Tree(rows, points, low, high, sums, begin)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in tree order, sums of each entry's points, their counts)."""
        k, depth, size = len(entries), len(self.low) - 1, self.points.shape[1]
        # the largest intermediate results are squares of twice a difference, added up over the components
        exact = 16 * size * largest(entries, self.low[0], self.high[0]) ** 2 < LONG
        c = wide(entries, exact)
        norm = (c * c).sum(1)
        of = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros((k, size), object), np.zeros(k, object)
        node, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(depth + 1):
            low, high = wide(self.low[level], exact)[node], wide(self.high[level], exact)[node]
            middle = ((2 * c[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.argmin(np.where(left, middle, _MAX if exact else float("inf")), axis=1)
            away = c[None] - c[best][:, None]
            least = norm[None] - norm[best][:, None] - 2 * np.maximum(away * low[:, None], away * high[:, None]).sum(2)
            # never nearer than the best within the box; where equal, the lower index wins
            left = left & ~((least > 0) | ((least == 0) & (np.arange(k)[None] > best[:, None])))
            single = left.sum(1) == 1
            step = 2 ** (depth - level)
            done, entry = node[single], np.argmax(left[single], axis=1)
            first, last = self.begin[done * step], self.begin[(done + 1) * step]
            s, _ = group_sums(self.sums[level][done], entry, k)
            sums = sums + s
            counts = counts + np.bincount(entry, last - first, k).astype(np.int64).astype(object)
            place = np.repeat(first, last - first) + np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
            of[place] = np.repeat(entry, last - first)
            node, left = node[~single], left[~single]
            if not len(node):
                return of, sums, counts
            if level < depth:
                node, left = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([left, left])
        n = np.diff(self.begin)[node]
        place = np.repeat(self.begin[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        points = wide(self.points, exact)[place]
        d = ((points[:, None] - c[None]) ** 2).sum(2)
        of[place] = np.argmin(np.where(np.repeat(left, n, axis=0), d, _MAX if exact else float("inf")), axis=1)
        s, m = group_sums(self.points[place], of[place], k)
        return of, sums + s, counts + m


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to chunks of ``CHUNK`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = CHUNK - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if room == held[-1].num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _trees(kept: DataFrame, parts: int, dim: int) -> DataFrame:
    """(ids, labels, trees): a row for each chunk of vectors, with a tree for each position."""
    kinds = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            x = floors(matrix(t["v"].combine_chunks(), dim)).reshape(t.num_rows, parts, -1)
            trees = pickle.dumps([Tree.of(x[:, p]) for p in range(parts)], protocol=5)
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.binary())], names=["ids", "labels", "trees"])

    return kept.select("id", "label", "v").mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees binary")


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, work: Workspace | None = None
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of each kept vector, written once; the codebooks as integers: parts x entries x components)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    work = work or Workspace(vectors.sparkSession, "codes")
    kept = whole(bare(vectors, id_col, label_col, vec_col).toDF("id", "label", "v"), "v")
    kept = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    dim = len(first[0].v) if first else parts
    kept = work.table(kept.where(F.size("v") == dim), "vectors")
    begin = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    k, size, kinds = len(begin), dim // parts, dict(kept.dtypes)
    books = floors(np.array([r.v for r in begin], np.float64).reshape(-1, parts, size)).transpose(1, 0, 2)
    trees = work.table(_trees(kept, parts, dim), "trees")
    work.drop("vectors")

    for _ in range(rounds if k else 0):

        def part(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = np.zeros((parts, k, size), object), np.zeros((parts, k), object)
            for batch in batches:
                for one in batch.column(0):
                    for p, tree in enumerate(pickle.loads(one.as_py())):
                        _, s, n = tree.assign(books[p])
                        sums[p] += s
                        counts[p] += n
            return sums, counts

        sums, counts = tree_sum(trees.select("trees"), part, (np.zeros((parts, k, size), object), np.zeros((parts, k), object)))
        moved = books.astype(object)
        used = counts > 0
        moved[used] = sums[used] // counts[used][:, None]
        books = moved if largest(moved) >= LONG else moved.astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(at, 1).flatten() for c in (0, 1))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), object)
                for p, tree in enumerate(pickle.loads(batch.column(2)[at].as_py())):
                    of = tree.assign(books[p])[0]
                    exact = 4 * size * largest(tree.points, books[p]) ** 2 < LONG
                    codes[tree.rows, p] = of
                    error[tree.rows] += ((wide(tree.points, exact) - wide(books[p], exact)[of]) ** 2).sum(1).astype(object)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    found = work.table(trees.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "coded")
    work.drop("trees")
    return found.withColumnsRenamed({"id": id_col, "label": label_col}), books


def with_totals(found: DataFrame, books: np.ndarray, label_col: str = "label", work: Workspace | None = None) -> DataFrame:
    """The coded vectors with their label's summed error and the digest of all codebooks."""
    work = work or Workspace(found.sparkSession, "label-errors")
    sums = work.table(found.groupBy(F.col(label_col).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "sums")
    # more labels than that: both sides are written, so that Spark can split the partition of a hot one
    sums = F.broadcast(sums) if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else sums
    digest = sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return found.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label").withColumn("codebooks_sha256", F.lit(digest))


def oracle_sql(dim: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by every pair of part and entry: for small tables of vectors of one length."""
    size, steps = dim // parts, []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, p, min({{'d': list_dot_product(y.v, y.v) - 2 * list_dot_product(y.v, c.v) + list_dot_product(c.v, c.v), 'c': c.c}}) AS best FROM y JOIN c{r} AS c USING (p) GROUP BY r, p)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, best.c AS c, i.i AS i, sum(v[i.i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r} JOIN y USING (r, p), range(1, {size + 1}) AS i(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, c.c, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT p, c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{r} GROUP BY p, c) AS m USING (p, c))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
y AS MATERIALIZED (SELECT r, p.p AS p, list_slice(v, p.p * {size} + 1, (p.p + 1) * {size}) AS v FROM x, range(0, {parts}) AS p(p)),
c0 AS MATERIALIZED (SELECT p, r AS c, v FROM y WHERE r < {entries}),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', best.c::INTEGER), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda e: e::BIGINT::VARCHAR), ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN x USING (r), b"""
