"""Queries of telemetry: shaping, retention, joins, recent lists and rate limiting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_prefix
from ..operators import evaluate, events
from ..sources import tables
from ..streaming import admission, sinks
from .registry import Registry, table

query = Registry()
DAY = 86400.0


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts, json_extract_string(props, '$.k')::INTEGER AS k, substr(sha256(event_type), 1, 12) AS type_hash FROM events""")
def event_append_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", events.iso(F.col("ts")).alias("ts"), k.alias("k"), hash_prefix("event_type").alias("type_hash"))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    newest = rows.agg(F.max("ts").alias("newest"))
    return events.retained(rows.crossJoin(F.broadcast(newest)), 7, F.col("newest")).select("event_id", "user_id")


_ADMITTED = """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, t, n, [t] AS held, true AS admitted FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.t, o.n, CASE WHEN len(list_filter(r.held, lambda x: x > o.t - 86400)) < 2 THEN list_append(list_filter(r.held, lambda x: x > o.t - 86400), o.t) ELSE list_filter(r.held, lambda x: x > o.t - 86400) END,
len(list_filter(r.held, lambda x: x > o.t - 86400)) < 2 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, admitted FROM r"""


@query(_ADMITTED)
def rate_limit_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = events.admissions(table(spark, d, "events"), 2, DAY)
    return rows.select("user_id", "event_id", (F.col("wait") == 0).alias("admitted"))


@query("""WITH s AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'click'), e AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'view'),
f AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'explanation' END AS kind, event_id - 1 AS ref_id FROM events WHERE event_type = 'purchase')
SELECT f.id, f.kind, f.ref_id, coalesce(s.ts, e.ts) AS ref_ts FROM f LEFT JOIN s ON f.kind = 'search' AND s.id = ref_id LEFT JOIN e ON f.kind = 'explanation' AND e.id = ref_id""")
def feedback_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    of = lambda kind: rows.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "ts")
    feedback = of("purchase").select("id", F.when(F.col("id") % 2 == 0, F.lit("search")).otherwise(F.lit("explanation")).alias("kind"), (F.col("id") - 1).alias("ref_id"))
    return events.with_feedback(feedback, of("click"), of("view")).select("id", "kind", "ref_id", "ref_ts")


@query("""SELECT user_id, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS rank FROM
(SELECT user_id, json_extract_string(props, '$.k') AS item, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE rank <= 8""")
def mru_recent(spark: SparkSession, d: str) -> DataFrame:
    visits = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("item"), "ts")
    return events.recent(visits).select("user_id", "item", "rank")


@query("SELECT event_type, median(value) AS median_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(table(spark, d, "events").withColumnRenamed("value", "latency_ms"), "event_type")


# streams: each is run to its end over files in the shared folder


def _states(spark: SparkSession) -> None:
    """Custom state needs this store; a setting of the session that has one stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, admission.STATE_STORE)


def _drained(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    checkpoint = checkpoint or tables.scratch(stream.sparkSession, "stream")
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


@query(_ADMITTED)
def streamed_admission(spark: SparkSession, d: str) -> DataFrame:
    """The rate limit on a stream of the events in three batches in time order."""
    _states(spark)
    rows, path, out = table(spark, d, "events").select("user_id", "event_id", "ts"), tables.scratch(spark, "hits"), tables.scratch(spark, "admitted")
    edges = [F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz"), F.lit("2024-01-21").cast("timestamp_ntz")]
    checkpoint = tables.scratch(spark, "stream")
    for n in range(3):  # a batch is what has come since the last one, in any number of files
        part = rows if n == 0 else rows.where(F.col("ts") >= edges[n])
        part = part if n == 2 else part.where(F.col("ts") < edges[n + 1])
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        _drained(admission.admission_stream(stream, 2, DAY), sinks.append_to(out), checkpoint)
    return spark.read.parquet(out).select("user_id", "event_id", (F.col("wait") == 0).alias("admitted"))


@query("SELECT event_id, user_id, event_type FROM events")
def event_sink(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines as they come appended to a table; a sink that fails doesn't keep the rows from the other, and a second run adds nothing."""
    rows, path, out, checkpoint = table(spark, d, "events"), tables.scratch(spark, "json-lines"), tables.scratch(spark, "sink"), tables.scratch(spark, "sink-state")
    events.as_json(rows.select("event_id", "user_id", "event_type")).write.text(path)
    stream = sinks.read_json_lines(spark, path, "event_id bigint, user_id bigint, event_type string")

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("this sink is down")

    for _ in range(2):
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sinks.isolated(broken, sinks.append_to(out))).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """An extension: counts by hour on a stream; the last hours, which no watermark has passed, come from a closing event far ahead."""
    rows, path, out = table(spark, d, "events").select("event_id", "ts", "event_type"), tables.scratch(spark, "hours"), tables.scratch(spark, "counts")
    rows.coalesce(1).write.parquet(path)
    for n in (1, 2):
        spark.sql(f"select -{n}L as event_id, timestamp_ntz'2100-01-0{n} 00:00:00' as ts, 'close' as event_type").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _drained(sinks.hourly_counts(stream, "1 hour"), sinks.append_to(out))
    return spark.read.parquet(out).where("event_type <> 'close'").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


QUERIES, ORACLE_SQL = query.queries, query.sql
