"""Event sinks: streams of JSON lines or rows appended to tables; a failing sink doesn't stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = logging.getLogger(__name__)

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Event tables and their columns.
TABLES = {
    "searches": "id bigint, ts timestamp, query string, rewritten_query string, rewritten boolean, query_hash string, rewritten_query_hash string, rewrite_method string, mode string, num_results int, result_count int, top_result string, latency_ms int, cached boolean, route string, embed_ms int, retrieve_ms int",
    "feedback": "id bigint, ts timestamp, kind string, ref_id bigint, rating int, query_hash string",
    "kanji_lookups": "id bigint, ts timestamp, kanji string, source string",
    "explanations": "id bigint, ts timestamp, sentence_hash string, jlpt_level string, model string, latency_ms int, ok boolean",
}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines that appear in a folder."""
    return spark.readStream.schema(schema).json(path)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends to a table; a batch that is run again replaces its own folder, so each is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def isolated(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Run every writer; failures are logged and don't reach the others or the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for w in writers:
                try:
                    w(held, batch_id)
                except Exception:
                    LOG.exception("an event sink failed on batch %s", batch_id)
        finally:
            held.unpersist()

    return write


def append_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is and stop."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append_to(path)).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n) with a watermark: an extension, no part of the event tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
