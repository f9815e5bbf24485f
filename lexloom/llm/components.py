"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round keeps the edge table linear in the number of nodes and is written to the shared folder,
so lineage stays short and nothing is gathered on the driver but two numbers per round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace


def components(spark: SparkSession, edges: DataFrame, work: Workspace, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that some edge names; root is the least node of its component.

    ``edges`` has columns a and b of one orderable type.  Self-loops and repeated edges are harmless;
    edges with a null end are ignored.
    """
    now = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = _state(now)
    for i in range(1, most_rounds + 1):
        large = work.table(_large_star(now, lambda df: work.table(df, f"{name}-{i}-least")), f"{name}-{i}-large")
        now = work.table(_small_star(large, lambda df: work.table(df, f"{name}-{i}-less")), f"{name}-{i}")
        for old in (f"{name}-{i}-least", f"{name}-{i}-large", f"{name}-{i}-less", *([f"{name}-{i - 1}"] if i > 1 else [])):
            work.drop(old)
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


Kept = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, kept: Kept) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and its neighbours.

    The least neighbours are written (``kept``) before they are joined: both sides of the join are then plain shuffles, of
    which Spark can split the partition of a node with very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, kept: Kept) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them (edges point from larger to smaller)."""
    least = kept(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
    moved = edges.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
