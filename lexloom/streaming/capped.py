"""A rate limit on a stream with a bounded number of keys: idle keys expire, and of too many the least recently active go.

The state is a table (key, held, last) under a folder, one version for each batch: the last admitted times and the last activity.  A batch
joins its keys' rows with the version before, decides each key's hits in order, and writes the next version: keys idle for longer than
``idle`` seconds of the stream's time go, and then the least recently active ones beyond ``cap``.  A version is named by its batch and made
visible by a rename, so a batch that is run again after a failure starts from the same version and writes the same one.  The state's
rows are ``cap`` at most, so finding the least active ones is bounded however many keys the stream has had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import SlidingWindow
from ..sources import tables

_STATE = "user_id long, held array<double>, last double"


def state(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The keys held after a batch; none before the first."""
    return spark.read.schema(_STATE).parquet(f"{path}/state-{batch_id}") if tables.exists(spark, f"{path}/state-{batch_id}") else spark.createDataFrame([], _STATE)


def admit(path: str, limit: int, window: float, cap: int, idle: float) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over events (user_id, event_id, ts): decisions go to path/decided, keys to path/state-<batch>."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate = None, None
        rest: tuple[int, list[float], float] | None = None
        for pdf in batches:
            out = []
            for key, event, t, held in zip(pdf["user_id"], pdf["event_id"], pdf["t"], pdf["held"]):
                if gate is None or key != now:
                    if rest:
                        out.append((rest[0], None, None, rest[1], rest[2]))
                    now, gate = key, SlidingWindow(limit, window, None if held is None else list(held))
                out.append((key, event, gate.hit(t), None, None))
                rest = (key, gate.held, t)
            yield pd.DataFrame(out, columns=["user_id", "event_id", "wait", "held", "last"])
        if rest:
            yield pd.DataFrame([(rest[0], None, None, rest[1], rest[2])], columns=["user_id", "event_id", "wait", "held", "last"])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if tables.exists(spark, f"{path}/state-{batch_id}"):
            return  # decided before a failure further on
        before = state(spark, path, batch_id - 1)
        rows = batch.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).join(before.select("user_id", "held"), "user_id", "left")
        rows = rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
        done = tables.staged(rows.mapInPandas(decide, "user_id long, event_id long, wait double, held array<double>, last double"), "decided")
        done.where("event_id is not null").select("user_id", "event_id", "wait").write.mode("overwrite").parquet(f"{path}/decided/batch={batch_id}")
        keys = before.join(batch.select("user_id").distinct(), "user_id", "left_anti").unionByName(done.where("event_id is null").select("user_id", "held", "last"))
        newest = keys.agg(F.max("last")).first()[0]
        kept = keys.where(F.col("last") > newest - idle) if newest is not None else keys
        folder = tables.scratch(spark, "state")
        kept.orderBy(F.desc("last"), "user_id").limit(cap).write.parquet(folder)
        tables.move(spark, folder, f"{path}/state-{batch_id}")

    return write
