"""Telemetry tables: shaping, retention, migration, feedback joins, recent lists, and admission in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_prefix


def iso(ts: Column) -> Column:
    """ISO-8601 text in seconds, UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def as_json(df: DataFrame) -> DataFrame:
    """(value): one JSON line for each event."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def retained(events: DataFrame, days: int, now: Column, ts_col: str = "ts") -> DataFrame:
    """Events not older than ``days`` (the edge stays); 0 or less keeps all."""
    return events if days <= 0 else events.where(F.col(ts_col) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def hashed(events: DataFrame, *columns: str) -> DataFrame:
    """Raw texts replaced by hashes under <name>_hash, as the migration does."""
    return events.withColumns({f"{c}_hash": hash_prefix(c) for c in columns}).drop(*columns)


def with_feedback(feedback: DataFrame, searches: DataFrame, explanations: DataFrame) -> DataFrame:
    """Feedback rows with the row of the kind they refer to; a missing one leaves nulls."""
    s = searches.select(F.col("id").alias("ref_id"), F.lit("search").alias("kind"), F.col("ts").alias("ref_ts"))
    e = explanations.select(F.col("id").alias("ref_id"), F.lit("explanation").alias("kind"), F.col("ts").alias("ref_ts"))
    return feedback.join(s.unionByName(e), ["kind", "ref_id"], "left")


def recent(visits: DataFrame, n: int = 8, key: str = "user_id", item: str = "item", ts_col: str = "ts", most_bytes: int | None = None) -> DataFrame:
    """(key, rank, item, ts): each key's last n different items, newest first, within a budget of bytes if there is one."""
    last = visits.groupBy(key, item).agg(F.max(ts_col).alias(ts_col))
    w = Window.partitionBy(key).orderBy(F.desc(ts_col), item)
    rows = last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if most_bytes is not None:
        used = F.sum(F.octet_length(F.col(item).cast("string")) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__used", used).where(F.col("__used") <= most_bytes).drop("__used")
    return rows


class SlidingWindow:
    """Admission of one key's hits in order of time: at most ``limit`` in any window; rejected hits leave no trace.

    Only the last ``limit`` admitted times matter: a hit is admitted when the oldest of them has left the window.
    """

    def __init__(self, limit: int, window: float, held: list[float] | None = None):
        self.limit, self.window, self.last = limit, window, deque(held or (), maxlen=limit)

    @property
    def held(self) -> list[float]:
        return list(self.last)

    def hit(self, now: float) -> float:
        """0 if admitted, else the seconds until a place is free."""
        if len(self.last) == self.limit and self.last[0] > now - self.window:
            return max(self.last[0] + self.window - now, 0.001)
        self.last.append(now)
        return 0.0


def admissions(events: DataFrame, limit: int, window: float, key: str = "user_id", id_col: str = "event_id", ts_col: str = "ts") -> DataFrame:
    """(key, id, wait): each event's wait, 0 if admitted, deciding each key's events in order.

    Rows are dealt out by key and streamed in order, so only one key's window is held at a time, however many events it has.  The
    rule is sequential: whether a hit is admitted depends on all the key's hits before it, so one key's events are one task's.
    A limit of 0 or less admits all.
    """
    kinds = dict(events.dtypes)
    seconds = F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6
    rows = events.select(key, id_col, seconds.alias("t"))
    if limit <= 0:
        return rows.select(key, id_col, F.lit(0.0).alias("wait"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, gate = object(), None
        for pdf in batches:
            waits = []
            for k, t in zip(pdf[key], pdf["t"]):
                if k != now_key:
                    now_key, gate = k, SlidingWindow(limit, window)
                waits.append(gate.hit(t))
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "wait": waits})

    return rows.repartition(key).sortWithinPartitions(key, "t", id_col).mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, wait double")


def quiet_pieces(events: DataFrame, window: float, key: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """``events`` with ``t`` in seconds and ``piece``: a key's history is cut where nothing happened for a window or longer.

    Such a gap lies between two slots of the window's length, as the two events are a slot apart, and they are the last of the one and the
    first of the other.  So gaps are found among the slots' first and last times, which are summed up before a key's rows meet.
    """
    rows = events.withColumn("t", F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).withColumn("__slot", F.floor(F.col("t") / window))
    slots = rows.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__at")).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
    by = Window.partitionBy("__key").orderBy("__at")
    quiet = F.coalesce(~(F.lag("__last").over(by) > F.col("__first") - window), F.lit(True))
    slots = slots.withColumn("__new", quiet.cast("int")).withColumn("piece", F.sum("__new").over(by)).select("__key", "__at", "piece")
    return rows.join(slots, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slot") == F.col("__at"))).drop("__key", "__at", "__slot")


def split_admissions(events: DataFrame, limit: int, window: float, key: str = "user_id", id_col: str = "event_id", ts_col: str = "ts") -> DataFrame:
    """(key, id, piece, wait) as ``admissions`` decides, each piece of a key's history by itself: after a gap no earlier hit counts.

    So a key with a long history is many tasks' work; one task has a piece's rows, not a key's.
    """
    kinds = dict(events.dtypes)
    rows = quiet_pieces(events.select(key, id_col, ts_col), window, key, ts_col).select(key, id_col, "piece", "t")
    if limit <= 0:
        return rows.select(key, id_col, "piece", F.lit(0.0).alias("wait"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate = None, None
        for pdf in batches:
            waits = []
            for k, p, t in zip(pdf[key], pdf["piece"], pdf["t"]):
                if gate is None or (k, p) != now:
                    now, gate = (k, p), SlidingWindow(limit, window)
                waits.append(gate.hit(t))
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "piece": pdf["piece"], "wait": waits})

    return rows.repartition(key, "piece").sortWithinPartitions(key, "piece", "t", id_col).mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, piece long, wait double")
