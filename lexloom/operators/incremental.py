"""Incremental maintenance: what is new, changed or gone, and which vectors may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(new: DataFrame, stored: DataFrame, full: bool = True, id_col: str = "id") -> DataFrame:
    """(id, change): new, changed (other or no stored signature) and, for a full corpus, gone.  Both sides have the id and sig."""
    a, b = new.select(id_col, F.col("sig").alias("sig_new"), F.lit(True).alias("in_new")), stored.select(id_col, F.col("sig").alias("sig_old"), F.lit(True).alias("in_old"))
    rows = a.join(b, id_col, "full" if full else "left")
    change = F.when(F.col("in_old").isNull(), F.lit("new")).when(F.col("in_new").isNull(), F.lit("gone")).when(~F.coalesce(F.col("sig_new") == F.col("sig_old"), F.lit(False)), F.lit("changed"))
    return rows.select(id_col, change.alias("change")).where("change is not null")


def apply_diff(stored: DataFrame, new: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """The stored rows without what is gone or changed, and the new rows that are new or changed."""
    kept = stored.join(changes.where("change <> 'new'"), id_col, "left_anti")
    return kept.unionByName(new.join(changes.where("change <> 'gone'"), id_col, "left_semi"), allowMissingColumns=True)


def reusable(old: Column, new: Column) -> Column:
    """Why a stored vector can't be kept: null if it can.

    Meanings must agree, and the text that was embedded: the sparse text, or for old rows without it the display text.
    """
    return (
        F.when(~old["meanings"].eqNullSafe(new["meanings"]), F.lit("meanings"))
        .when(old["sparse_text"].isNull(), F.when(~old["text"].eqNullSafe(new["text"]), F.lit("legacy text")))
        .when(~old["sparse_text"].eqNullSafe(new["sparse_text"]), F.lit("sparse text"))
    )


def reuse_decisions(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, decision): reuse, unseen, or drift with its reason."""
    pack = lambda df, name: df.select(id_col, F.struct("meanings", "sparse_text", "text").alias(name))
    rows = pack(new, "n").join(pack(old, "o"), id_col, "left")
    reason = reusable(F.col("o"), F.col("n"))
    return rows.select(id_col, F.when(F.col("o").isNull(), F.lit("unseen")).when(reason.isNull(), F.lit("reuse")).otherwise(F.concat(F.lit("drift: "), reason)).alias("decision"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


def transplant(decisions: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """The stored vectors that may be kept."""
    return vectors.join(decisions.where("decision = 'reuse'"), id_col, "left_semi")


def seeded(new: DataFrame, other_entries: DataFrame, other_vectors: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(vectors, decisions): what another store's vectors give to new entries, and why the rest must be encoded."""
    decisions = reuse_decisions(other_entries, new, id_col)
    return transplant(decisions, other_vectors, id_col), decisions
