"""Centroid clustering on exact integers: Lloyd's rounds with distances by matrix products.

Vectors become integers floor(256 x).  A block of vectors meets all centroids in one product: |x|^2 - 2 x.c + |c|^2.  While
d (max|x| + max|c|)^2 stays below 2^53 every term and partial sum is an integer that float64 holds, so BLAS gives the exact
distances in whatever order it adds; beyond that the same expression runs on 64-bit or unbounded integers.  Each partition
adds up its vectors by cluster, ``treeAggregate`` combines the sums, and the driver holds the centroids only.

Defined cases: rows whose vector is null, has another length than ``dim`` or holds null or non-finite components are left out.
With fewer kept rows than ``k`` each row is a centroid.  Repeated rows count each; equal ids start in the order of their vectors,
null ids come last.  Ids may be of any type with a text form.  Ties of distance go to the smaller number.  No rows give no rows.
Other columns aren't read.  A distance or sum above 2^63 - 1 can't be returned as a long and raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_vectors import LONG, floors, group_sums, largest, matrix, tree_sum, whole, wide
from .shared import Workspace, bare, small

DIM, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
#: Vectors of a block.
BLOCK = 4096
_FLOAT = 1 << 53


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exactly."""
    bound = x.shape[1] * (largest(x) + largest(c)) ** 2
    x, c = (x.astype(np.float64), c.astype(np.float64)) if bound < _FLOAT else (wide(x, bound < LONG), wide(c, bound < LONG))
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of ``c``, squared distance) of each row of ``x``; ties go to the smaller number."""
    d = distances(x, c)
    at = np.argmin(d, axis=1)
    return at, np.take_along_axis(d, at[:, None], 1)[:, 0]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), floors(matrix(part.column(1), dim))


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, work: Workspace | None = None
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each kept vector, written once; the centroids as integers)."""
    work = work or Workspace(vectors.sparkSession, "clusters")
    own = bare(vectors, id_col, vec_col).toDF("id", "v")
    kept = work.table(whole(own, "v").where(F.size("v") == dim), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    begin = kept.orderBy(F.asc_nulls_last(order), "v").limit(k).collect()
    centroids = floors(np.array([r.v for r in begin], np.float64).reshape(-1, dim))
    kind, n = dict(kept.dtypes)["id"], len(centroids)

    for _ in range(rounds if n else 0):

        def part(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = np.zeros((n, dim), object), np.zeros(n, object)
            for _, x in _blocks(batches, dim):
                s, m = group_sums(x, nearest(x, c)[0], n)
                sums, counts = sums + s, counts + m
            return sums, counts

        sums, counts = tree_sum(kept, part, (np.zeros((n, dim), object), np.zeros(n, object)))
        moved = centroids.astype(object)
        used = np.flatnonzero(counts > 0)
        moved[used] = sums[used] // counts[used][:, None]
        centroids = wide(moved, False) if largest(moved) >= LONG else moved.astype(np.int64)

    def assign(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            at, d = nearest(x, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array([int(v) for v in d.tolist()], pa.int64())], names=["id", "cluster", "distance"])

    found = work.table(kept.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    work.drop("vectors")
    return found.withColumnRenamed("id", id_col), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with their cluster's and the whole inertia and the digest of their centroid."""
    rows = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    table = [(c, rows.get(c, 0), sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    total = sum(rows.values())
    known = small(found.sparkSession, table, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").withColumn("inertia", F.lit(total).cast("long"))


def oracle_sql(dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by every pair of vector and centroid: for small tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, min({{'d': list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v), 'c': c.c}}) AS best FROM x, c{r} AS c GROUP BY r)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best.c AS c, i.i AS i, sum(v[i.i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (r), range(1, {dim + 1}) AS i(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{r} GROUP BY c) AS m USING (c))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, embedding) - 1 AS c, v FROM x QUALIFY c < {k}),
{", ".join(steps)},
f AS (SELECT vec_id, best.c AS c, best.d::BIGINT AS d FROM a{rounds} JOIN x USING (r))
SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(l.v, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM f JOIN c{rounds} AS l ON l.c = f.c"""
