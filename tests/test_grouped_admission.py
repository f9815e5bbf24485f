from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from lexloom.operators import events
from lexloom.streaming import admission


def test_groups_of_keys_decide_as_keys(spark, tmp_path):
    rng = random.Random(8)
    keys = [None, 1, 2, 3, 2**60 + 1, 2**60 + 2]
    hits = [(rng.choice(keys), n, n * 0.7) for n in range(240)]
    schema = "user_id long, event_id long, s double"
    for at in range(0, 240, 80):  # batches of two files
        part = spark.createDataFrame(hits[at : at + 80], schema).select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
        part.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        waits = admission.admission_stream(stream, 2, 10.0, groups=2)
        query = waits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.createDataFrame(hits, schema).withColumn("ts", F.timestamp_seconds("s"))
    want = events.admissions(rows.withColumn("user_id", F.coalesce("user_id", F.lit(-1))), 2, 10.0).collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((-1 if r.user_id is None else r.user_id, r.event_id, round(r.wait, 6)) for r in got) == sorted((r.user_id, r.event_id, round(r.wait, 6)) for r in want)
    assert any(r.wait for r in got)


class Held:
    """A list state, its handle, and a clock."""

    def __init__(self):
        self.rows, self.ms = [], 0

    def getListState(self, name, schema, ttlDurationMs=None):  # noqa: N802, N803
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def test_idle_keys_of_a_group_expire():
    state, gate = Held(), admission.Admission(1, 10.0, True)
    gate.init(state)
    ask = lambda *rows: list(next(gate.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["user_id", "event_id", "t"])]), state))["wait"])
    assert ask((1, 1, 0.0), (2, 2, 1.0)) == [0, 0]
    state.ms = 6000
    assert ask((2, 3, 2.0)) == [9.0]  # rejected, but seen
    state.ms = 12000
    assert ask((3, 4, 2.5)) == [0] and sorted(r[0] for r in state.rows) == [2, 3]
