"""Explanation fragments as a stream: re-framed to lines and tidied, keyed by explanation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.explanations import LineStream, Tidier

_STATE = StructType([StructField("rest", StringType()), StructField("blanks", IntegerType()), StructField("seen", StringType())])


class TidyLines(StatefulProcessor):
    """State of an explanation: the unfinished line, pending blanks and patterns seen."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tidy", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("seq")
        held = self.state.get() if self.state.exists() else ("", 0, "")
        stream = LineStream(Tidier(self.most, set(filter(None, held[2].split("\x00")))), held[0], held[1])
        text = "".join(map(stream.feed, pdf["delta"]))
        done = bool(pdf["done"].any())
        if done:
            text += stream.close()
            self.state.clear()
        else:
            self.state.update((stream.rest, stream.blanks, "\x00".join(sorted(stream.tidier.seen))))
        yield pd.DataFrame({"explanation_id": [key[0]], "last_seq": [int(pdf["seq"].max())], "text": [text], "done": [done]})

    def close(self) -> None:
        pass


def event_rows(tidied: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """(explanation_id, seq, kind, data) of tidied fragments: a text event for each that isn't empty, then one done or error event.

    ``finished`` (explanation_id, error, latency_ms) says how explanations ended; without it the done event has no data.
    """
    text = tidied.where("text <> ''").select("explanation_id", F.col("last_seq").alias("seq"), F.lit("text").alias("kind"), F.to_json(F.struct("text")).alias("data"))
    last = tidied.where("done").select("explanation_id", (F.col("last_seq") + 1).alias("seq"))
    if finished is None:
        return text.unionByName(last.select("explanation_id", "seq", F.lit("done").alias("kind"), F.lit("{}").alias("data")))
    ends = last.join(finished, "explanation_id", "left")
    kind = F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("done"))
    data = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(F.col("explanation_id").alias("id"), "latency_ms")))
    return text.unionByName(ends.select("explanation_id", "seq", kind.alias("kind"), data.alias("data")))


def event_writer(path: str, finished: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer of the events of tidied fragments; a batch that is run again replaces its own folder."""
    from .sinks import append_to

    write = append_to(path)
    return lambda batch, batch_id: write(event_rows(batch, finished), batch_id)


def tidy_stream(deltas: DataFrame, most: int) -> DataFrame:
    """(explanation_id, last_seq, text, done) of a stream of (explanation_id, seq, delta, done)."""
    return deltas.groupBy("explanation_id").transformWithStateInPandas(TidyLines(most), "explanation_id long, last_seq long, text string, done boolean", "Append", "None")
