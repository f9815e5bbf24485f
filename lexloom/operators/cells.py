"""Cosine search over stored cells of vectors, with exact bounds.

Vectors are put on the unit sphere and dealt out to the nearest of a number of centres, which k-means finds on a bounded sample; every
vector lies in one cell, which keeps its centre and its radius, the largest distance of a member.  A query first meets the members of
its nearest cells, as many as hold k vectors; its k-th best score there is a bound.  By the triangle inequality no member of a cell is
nearer to the query than the distance to the centre less the radius, so cells beyond the bound are skipped, and what is found in
the others is the exact answer.  Scores are those of ``retrieval.cosine``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from .retrieval import Best, ranked

#: Vectors of the sample that k-means sees, and its rounds.
SAMPLE, ROUNDS = 20_000, 8
#: Scores are rounded to six decimals; squared distances of unit vectors give way by more than twice that.
SLACK = 1e-5
#: Bytes of query vectors that meet one task's cells at once.
QUERY_BYTES = 32 << 20


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def centres(vectors: DataFrame, cells: int, id_col: str = "id", v_col: str = "v", sample: int = SAMPLE) -> np.ndarray:
    """Centres on the sphere by k-means over the ``sample`` vectors of least hash: the vectors' number doesn't matter to the driver."""
    rows = vectors.where(F.col(v_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(v_col).cast("array<double>").alias("v")).toArrow()
    m = unit(_matrix(rows["v"].combine_chunks())) if rows.num_rows else np.zeros((0, 1))
    c = m[:cells].copy()
    for _ in range(ROUNDS if len(c) else 0):
        at = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, m)
        used = np.bincount(at, minlength=len(c)) > 0
        c[used] = unit(sums[used])
    return c


def write_cells(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "id", v_col: str = "v", sample: int = SAMPLE) -> None:
    """Tables (cell, id, v), dealt out and sorted by cell, and (cell, centre, radius, n).  Without ``cells`` there are about as many as
    the square root of the vectors' number, up to 4,096."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col(v_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(v_col).cast("array<double>").alias("v"))
    cells = cells or int(min(4096, max(1, round(kept.count() ** 0.5))))
    c, kind = centres(kept, cells, sample=sample), dict(kept.dtypes)["id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(_matrix(batch.column(1)))
            at = np.argmax(m @ c.T, axis=1)
            away = np.linalg.norm(m - c[at], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns, pa.array(away)], names=["cell", "id", "v", "away"])

    dealt = kept.mapInArrow(deal, f"cell int, id {kind}, v array<double>, away double")
    dealt.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/members")
    own = spark.read.parquet(f"{path}/members").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cell int, centre array<double>")  # one row for each cell
    known.join(own, "cell").coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class Cells:
    members: DataFrame  # cell, id, v
    cells: DataFrame  # cell, centre, radius, n

    @staticmethod
    def read(spark: SparkSession, path: str) -> Cells:
        return Cells(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells"))


def _distances(queries: DataFrame, cells: Cells) -> DataFrame:
    """(qid, cell, near, n): for each query how near a member of each cell may be; the cells' centres go to every task."""
    known = cells.cells.orderBy("cell").toArrow()  # 4,096 centres at most
    number, c = known["cell"].combine_chunks(), _matrix(known["centre"].combine_chunks()) if known.num_rows else np.zeros((0, 1))
    radius, n = (known[x].to_numpy() for x in ("radius", "n"))
    kind = dict(queries.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(c) else 0, 256):
                part = batch.slice(at, 256)
                q = unit(_matrix(part.column(1)))
                away = np.sqrt(np.maximum(2 - 2 * (q @ c.T), 0))
                near = np.maximum(away - radius, 0)
                rows = np.repeat(np.arange(len(q)), len(c))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), number.take(pa.array(np.tile(np.arange(len(c)), len(q)))), pa.array(near.ravel()), pa.array(away.ravel()), pa.array(np.tile(n, len(q)))], names=["qid", "cell", "near", "away", "n"])

    return queries.select("qid", "qv").mapInArrow(run, f"qid {kind}, cell int, near double, away double, n long")


def _met(queries: DataFrame, pairs: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(qid, id, score): the k best members of each cell for each query that is to meet it (pairs of qid and cell).

    A cell's queries and its members are dealt out in parts of bounded size, and each part of the ones meets each of the others.
    """
    asked = pairs.join(queries.select("qid", "qv"), "qid")
    kinds = dict(cells.members.dtypes) | {"qid": dict(queries.dtypes)["qid"]}
    most = 1 << 16  # members or queries of a part
    qparts = max(1, -(-queries.count() // most))
    sizes = cells.cells.select("cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    members = cells.members.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(qparts - 1))))
    asked = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("qpart", F.pmod(F.xxhash64("qid"), F.lit(qparts)).cast("int"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", left.schema.field("qid").type), ("id", right.schema.field("id").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        m, ids = unit(_matrix(right["v"].combine_chunks())), right["id"].combine_chunks()
        out = []
        step = max(1, min(4096, QUERY_BYTES // (8 * m.shape[1]), (4 << 20) // len(m)))
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step)
            held = Best(part.num_rows, k)
            held.add(0, np.round(unit(_matrix(part["qv"].combine_chunks())) @ m.T, 6) + 0.0, ids.to_numpy(zero_copy_only=False))
            out += list(held.rows(part["qid"].combine_chunks(), ids.type))
        return pa.Table.from_batches(out, schema=schema)

    return asked.select("cell", "part", "qpart", "qid", "qv").groupBy("cell", "part", "qpart").cogroup(members.select("cell", "part", "qpart", "id", "v").groupBy("cell", "part", "qpart")).applyInArrow(best, f"qid {kinds['qid']}, id {kinds['id']}, score double")


def search(queries: DataFrame, cells: Cells, k: int, q_col: str = "qv") -> tuple[DataFrame, DataFrame]:
    """((qid, id, score, rank): the k nearest vectors of each query by cosine, exactly; (qid, had, scored): vectors, and those scored)."""
    asked = staged(queries.where(F.col(q_col).isNotNull()).select("qid", F.col(q_col).cast("array<double>").alias("qv")), "asked")
    all_cells = staged(_distances(asked, cells), "distances")
    by = Window.partitionBy("qid").orderBy("away", "cell")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = staged(all_cells.withColumn("before", before).where(F.col("before") < k).select("qid", "cell", "n"), "first-cells")
    found = staged(_met(asked, first.select("qid", "cell"), cells, k), "first-found")
    bound = ranked(found, k).where(F.col("rank") == k).select("qid", (2 - 2 * F.col("score")).alias("bound"))  # a squared distance
    more = all_cells.join(bound, "qid", "left").where(F.col("bound").isNull() | (F.col("near") * F.col("near") <= F.col("bound") + SLACK))
    more = staged(more.join(first.select("qid", "cell"), ["qid", "cell"], "left_anti").select("qid", "cell", "n"), "more-cells")
    found = found.unionByName(_met(asked, more.select("qid", "cell"), cells, k))
    scored = first.unionByName(more).groupBy("qid").agg(F.sum("n").alias("scored"))
    report = all_cells.groupBy("qid").agg(F.sum("n").alias("had")).join(scored, "qid")
    return ranked(found, k), report
