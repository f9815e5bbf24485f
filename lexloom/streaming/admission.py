"""Rate limiting on Structured Streaming: a list state of admitted hits for each group of keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.events import SlidingWindow

#: The state store that transformWithState needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys. A group is one call with one state, whose fixed costs are shared by its keys; take more for many millions of keys, as a
#: group's admitted hits are held at once. A stream keeps the number that it began with.
GROUPS = 1024


class Admission(StatefulProcessor):
    """Decides hits of a group of keys in order; idle keys expire by the times of their last hits where the query has processing time."""

    def __init__(self, limit: int, window: float, ttl: bool = False):
        self.limit, self.window, self.ttl = limit, window, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # seen: when the key's hits were last decided, by the clock
        schema = StructType([StructField("user_id", LongType()), StructField("t", DoubleType()), StructField("seen", DoubleType())])
        self.hits = handle.getListState("hits", schema, ttlDurationMs=int(self.window * 1000) + 1) if self.ttl else handle.getListState("hits", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["user_id", "t", "event_id"])
        now = timerValues.getCurrentProcessingTimeInMs() / 1000 if self.ttl else 0.0
        held: dict[int, tuple[list[float], float]] = {}
        for user, t, seen in self.hits.get():
            if not self.ttl or seen >= now - self.window:
                held.setdefault(user, ([], seen))[0].append(t)
        waits, last, gate = [], None, None
        for user, t in zip(pdf["user_id"], pdf["t"]):
            user = int(user)  # noqa: PLW2901
            if user != last:
                last, gate = user, SlidingWindow(self.limit, self.window, held.get(user, ((), 0.0))[0])
                held[user] = (gate.last, now)
            waits.append(gate.hit(t))
        self.hits.put([(user, t, seen) for user, (times, seen) in held.items() for t in times])
        users = pdf["user_id"].to_numpy() if key[0] >= 0 else pd.array([None] * len(pdf), dtype="Int64")
        yield pd.DataFrame({"user_id": users, "event_id": pdf["event_id"].to_numpy(), "wait": waits})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limit: int, window: float, ttl: bool = False, groups: int = GROUPS) -> DataFrame:
    """(user_id, event_id, wait) of a stream of events (user_id, event_id, ts)."""
    # the null key is a group of its own and goes as 0, as pandas rounds large keys beside nulls
    group = F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    rows = events.select(F.coalesce("user_id", F.lit(0)).alias("user_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), group.alias("group"))
    return rows.groupBy("group").transformWithStateInPandas(Admission(limit, window, ttl), "user_id long, event_id long, wait double", "Append", "ProcessingTime" if ttl else "None")
