"""Queries of storage and evaluation over the given tables: loads, round trips, copies, expiry, reports, kept vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entries, evaluate, incremental, keys, retrieval
from ..sources import tables
from . import search_queries
from . import sqltext as S
from .registry import Registry

query = Registry()


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT -1, 'added'")
def stored_entries(spark: SparkSession, d: str) -> DataFrame:
    """A table that is written, replaced as a whole by its next version, and read again."""
    docs, path = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "lang"), tables.scratch(spark, "table")
    tables.replace_table(docs, path)
    new = docs.where("id % 10 <> 7").withColumn("lang", F.when(F.col("id") % 10 == 3, F.lit("new")).otherwise(F.col("lang"))).unionByName(spark.createDataFrame([(-1, "added")], "id long, lang string"))
    sig = lambda df: df.withColumn("sig", entries.signature(["lang"]))
    stored, now = tables.staged(sig(spark.read.parquet(path)), "old"), sig(new)
    tables.replace_table(incremental.apply_diff(stored, now, incremental.diff(now, stored)).drop("sig"), path)
    return spark.read.parquet(path)


@query("SELECT doc_id AS id FROM documents WHERE n_chars <= 2400 ORDER BY doc_id LIMIT 25")
def loaded_subset(spark: SparkSession, d: str) -> DataFrame:
    """The first common entries of a written table."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(False).alias("is_common"), F.ceil(F.col("n_chars") / 100).cast("int").alias("freq_band"), F.array().cast("array<string>").alias("example_sentences"))
    path = tables.scratch(spark, "chunks")
    tables.replace_table(docs, path)
    return tables.load_entries(spark, path, common_only=True, limit=25).select("id")


@query("SELECT doc_id AS id, lang, n_chars FROM documents")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "n_chars"), tables.scratch(spark, "json")
    tables.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query("SELECT doc_id AS id, source FROM documents")
def verified_copy(spark: SparkSession, d: str) -> DataFrame:
    """What a copy holds whose sizes, digests and rows have been compared."""
    one, two = tables.scratch(spark, "copy-from"), tables.scratch(spark, "copy-to")
    tables.replace_table(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source"), one)
    tables.copy_table(spark, one, two)
    return spark.read.parquet(two)


@query("SELECT DISTINCT lang AS form, min(doc_id) OVER (PARTITION BY lang) AS id FROM documents")
def index_write(spark: SparkSession, d: str) -> DataFrame:
    """A written form index, looked up by form."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("kanji_form"), F.lit(None).cast("string").alias("reading"), F.array().cast("array<string>").alias("kanji_forms"), F.array().cast("array<string>").alias("readings"))
    path = tables.scratch(spark, "index")
    tables.write_index(keys.form_index(docs), path)
    return spark.read.parquet(path).select("form", "id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY")
def expired_events(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "events")
    tables.replace_table(spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts"), path)
    tables.expire(spark, path, 10, "2024-01-25 00:00:00")
    return spark.read.parquet(path).select("event_id")


@query("SELECT '1' AS schema_version, '2024-03-05' AS dictionary_date, count(*)::VARCHAR AS rows_documents, true AS current, false AS other FROM documents")
def metadata_row(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "metadata")
    tables.write_metadata(spark, path, {"documents": spark.read.parquet(f"{d}/documents.parquet")}, dictionary_date="2024-03-05")
    same, other = tables.up_to_date(spark, path, dictionary_date="2024-03-05"), tables.up_to_date(spark, path, dictionary_date="2025-01-01")
    return spark.read.json(path).withColumns({"current": F.lit(same), "other": F.lit(other)})


@query("SELECT 'csv' AS kind, lang, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'json', lang, count(*) FROM documents GROUP BY 2")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"))
    out = []
    for kind in ("csv", "json"):
        path = tables.scratch(spark, kind)
        tables.write_report(rows, path, kind)
        read = spark.read.schema(rows.schema).option("header", "true")
        out.append((read.csv(path) if kind == "csv" else read.json(path)).select(F.lit(kind).alias("kind"), "lang", "n"))
    return out[0].unionByName(out[1])


@query("SELECT vec_id AS id, 'kept' AS state FROM embeddings WHERE vec_id % 4 = 2 UNION ALL SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'unseen' WHEN 1 THEN 'drift: meanings' ELSE 'drift: sparse text' END FROM embeddings WHERE vec_id % 4 <> 2")
def vector_transplant(spark: SparkSession, d: str) -> DataFrame:
    """Another store's vectors for new entries: those whose meanings and text agree."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("meanings"), F.col("label").cast("string").alias("sparse_text"), F.lit("t").alias("text"), F.col("embedding").alias("v"))
    k = F.col("id") % 4
    other = rows.where(k != 0).withColumns({"meanings": F.when(k == 1, F.array(F.lit("other"))).otherwise(F.col("meanings")), "sparse_text": F.when(k == 3, F.lit("other")).otherwise(F.col("sparse_text"))})
    vectors, decisions = incremental.seeded(rows, other, rows.select("id", "v"))
    kept = vectors.join(rows.select("id", F.col("v").alias("own")), "id").where(F.col("v") == F.col("own")).select("id", F.lit("kept").alias("state"))
    return kept.unionByName(decisions.where("decision <> 'reuse'").select("id", F.col("decision").alias("state")))


@query("""WITH near AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label = b.label AS rel, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id < 40),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS near_rank FROM near),
own AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY near_rank) AS rank FROM top WHERE near_rank <= 11 AND qid <> id), first AS (SELECT qid, min(rank) AS first FROM own WHERE rel AND rank <= 10 GROUP BY 1)
SELECT vec_id AS qid, coalesce(first <= 1, false)::INTEGER AS hit1, coalesce(first <= 5, false)::INTEGER AS hit5, coalesce(first <= 10, false)::INTEGER AS hit10 FROM embeddings LEFT JOIN first ON vec_id = qid WHERE vec_id < 40""")
def dense_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of forty: hits by label."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = rows.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")
    found = retrieval.dense(queries, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 11).where("qid <> id")
    found = found.join(queries.select("qid", "label"), "qid").join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    found = found.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"), (F.col("label") == F.col("own")).alias("rel"))
    return evaluate.flagged_metrics(found, queries, 10).select("qid", "hit1", "hit5", "hit10")


@query(f"""WITH f AS (SELECT doc_id, unnest(list_distinct({S.tokens("text")})) AS form FROM documents), w AS (SELECT DISTINCT unnest({S.tokens("text")}) AS form FROM benchmark)
SELECT form, min(doc_id) AS ord, count(*) AS n FROM f WHERE form IN (SELECT form FROM w) GROUP BY 1""")
def form_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark looked up in a written index of the documents' words, beside words that aren't there: joined, and few of them by filter."""
    words = lambda name, c: spark.read.parquet(f"{d}/{name}.parquet").select(c, F.explode(F.array_distinct(T.tokens("text"))).alias("form"))
    path = tables.scratch(spark, "forms")
    tables.write_index(words("documents", F.col("doc_id").alias("id")).groupBy("form").agg(F.min("id").alias("ord"), F.count("*").alias("n")), path)
    wanted = words("benchmark", "item_id").select("form").distinct()
    few = wanted.orderBy("form").limit(50)
    found = tables.staged(tables.lookup(spark, path, wanted.unionByName(wanted.select(F.concat(F.lit("~"), "form").alias("form")))), "found")
    by_filter = tables.lookup(spark, path, few.unionByName(few.select(F.concat(F.lit("~"), "form").alias("form"))))
    same = tables.content(by_filter.select("form", "ord", "n")).first() == tables.content(found.join(few, "form", "left_semi").select("form", "ord", "n")).first()
    return found.select("form", "ord", "n").where(F.lit(same))


@query(f"""WITH g AS (SELECT DISTINCT item_id, {S.gloss_key("s")} AS k FROM (SELECT item_id, unnest(string_split_regex(text, '[.\n]')) AS s FROM benchmark)),
f AS (SELECT DISTINCT doc_id, {S.gloss_key("s")} AS k FROM (SELECT doc_id, unnest(string_split_regex(text, '[.\n]')) AS s FROM documents)) SELECT DISTINCT item_id AS qid, doc_id AS id FROM g JOIN f USING (k) WHERE k <> ''""")
def relevant_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of which some form is one of a query's expected answers: sentences of documents and of benchmark items."""
    gold = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.transform(F.split("text", r"[.\n]"), T.gloss_key).alias("expected"))
    forms = search_queries.sentence_keys(search_queries.texts(spark, d)).where(F.col("kind") == keys.ALL).select(F.col("key").alias("form"), "id")
    return evaluate.gold_relevance(gold.select("qid", F.filter("expected", lambda k: k != "").alias("expected")), forms)


QUERIES, ORACLE_SQL = query.queries, query.sql
