"""Answers kept between batches: a bounded table of results by question and index version.

A question that an earlier batch asked under the same version is answered from the table; the others are searched, equal ones once.
The table keeps the answers of the ``most`` questions that were asked last, so it is small whatever was asked; another
version of the index makes all of it void.  Each batch writes a new table and then moves on the pointer to it, so a batch that
fails leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables

MOST = 512


@dataclass
class Answers:
    """Kept under ``path``: batch-<n> has rows (key, version, batch, place, found), a list of (id, score, rank) for each question."""

    spark: SparkSession
    path: str
    most: int = MOST

    def _batches(self) -> list[int]:
        return sorted(int(n.removeprefix("batch-")) for n in tables.names(self.spark, self.path) if n.startswith("batch-"))

    def held(self) -> DataFrame | None:
        last = self._batches()
        return self.spark.read.parquet(f"{self.path}/batch-{last[-1]}") if last else None

    def answer(self, questions: DataFrame, version: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(qid, id, score, rank, hit) of questions (qid, query); ``hit`` tells that the answer was kept.

        ``search`` takes questions (qid, q) and gives (qid, id, score, rank).  Questions without results are kept too, and give no rows.
        """
        batch = (self._batches() or [-1])[-1] + 1
        asked = tables.staged(questions.select("qid", T.normalise("query").alias("key")), "asked")
        once = asked.groupBy("key").agg(F.max("qid").alias("place"))
        held = self.held()
        known = None if held is None else held.where(F.col("version") == version)
        old = once.select("key").join(known.select("key", "found"), "key") if known is not None else None
        missing = once.select("key") if known is None else once.select("key").join(known.select("key"), "key", "left_anti")
        missing = tables.staged(missing, "missing")
        found = search(missing.select(F.col("key").alias("qid"), F.col("key").alias("q")))
        lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # a question's results
        new = missing.join(lists, F.col("key") == F.col("qid"), "left").select("key", "found")
        both = new.withColumn("hit", F.lit(False))
        both = both if old is None else both.unionByName(old.withColumn("hit", F.lit(True)))
        both = tables.staged(both, "answers")
        now = both.join(once, "key").select("key", F.lit(version).alias("version"), F.lit(batch).alias("batch"), F.col("place").cast("string").alias("place"), "found")
        if known is not None:
            now = now.unionByName(known.join(once.select("key"), "key", "left_anti"))
        order = [F.desc("batch"), F.desc(F.length("place")), F.desc("place"), "key"]  # numbers as text: the longer one is the larger
        now.orderBy(*order).limit(self.most).coalesce(1).write.parquet(f"{self.path}/new")
        tables.move(self.spark, f"{self.path}/new", f"{self.path}/batch-{batch}")
        for n in self._batches()[:-2]:  # the last but one stays for those who read it
            tables.remove(self.spark, f"{self.path}/batch-{n}")
        return asked.join(both, "key").select("qid", F.explode("found").alias("f"), "hit").select("qid", "f.id", "f.score", "f.rank", "hit")
