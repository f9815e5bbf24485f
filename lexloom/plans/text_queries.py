"""Queries of the text, numeral, markup and conjugation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import japanese as J
from ..functions import text as T
from ..operators import conjugation, evaluate, explanations, segmentation
from ..sources import markup, tables
from . import sqltext as S
from .registry import Registry, table

query = Registry()


@query(f"""SELECT doc_id, {S.gloss_key("text")} AS key, CASE WHEN {S.gloss_key("text")} LIKE 'to %' THEN substr({S.gloss_key("text")}, 4) END AS bare_key, {S.normalise("text")} AS normal FROM documents""")
def normalise_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.gloss_key("text").alias("key"), T.normalise("text").alias("normal"))
    return rows.select("doc_id", "key", F.get(T.keys_of(F.col("key")), F.lit(1)).alias("bare_key"), "normal")


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS hash FROM documents")
def hash_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.hash_prefix("text").alias("hash"))


@query(f"""
WITH q AS (SELECT conv_id, turn, {S.stripped("text")} AS original FROM conversations WHERE role = 'user'),
f AS (SELECT *, {S.normalise("original")} AS normal, {S.frame("original")} AS asked FROM q),
g AS (SELECT *, nullif(regexp_replace(regexp_replace({S.stripped("asked")}, '{T.ARTICLE}', ''), '[\\s?!.。、]+$', ''), '') AS found FROM f)
SELECT conv_id, turn, CASE WHEN original = '' THEN original ELSE coalesce(found, normal) END AS query, CASE WHEN found IS NOT NULL AND NOT {S.is_ja("original")} THEN 'heuristic' ELSE 'none' END AS method FROM g""")
def heuristic_rewrite(spark: SparkSession, d: str) -> DataFrame:
    r = T.rewrite("text")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", r["query"].alias("query"), r["method"].alias("method"))


@query(f"""SELECT 'conversation' AS source, conv_id AS id, turn, {S.route("text")} AS route FROM conversations UNION ALL SELECT 'benchmark', item_id, 0, {S.route("text")} FROM benchmark""")
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations").select(F.lit("conversation").alias("source"), F.col("conv_id").alias("id"), "turn", T.route("text").alias("route"))
    return talk.unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("turn"), T.route("text").alias("route")))


@query(f"SELECT doc_id, (length(text) > 150 OR ({S.is_ja('text')} AND length({S.normalise('text')}) > 100)) AS too_long FROM documents")
def length_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.too_long("text").alias("too_long"))


@query("""SELECT d.doc_id, coalesce(l.quality, 0) = 1 AS is_common, CAST(floor(n_chars / 100) AS INTEGER) + 1 AS freq_band FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(l.quality, 0) = 1 OR floor(n_chars / 100) + 1 <= 24""")
def common_subset(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.entries import common_subset as kept

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.array().cast("array<string>").alias("example_sentences")
    rows = rows.select("doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("is_common"), (F.floor(F.col("n_chars") / 100).cast("int") + 1).alias("freq_band"), none)
    return kept(rows).drop("example_sentences")


@query(f"""SELECT doc_id, regexp_matches(text, '[{S.HAN}]') AS has_kanji, regexp_matches(text, '[{S.JA}]') AS has_japanese, {S.is_ja("text")} AS is_japanese, len(regexp_extract_all(text, '[{S.HAN}]')) AS n_kanji FROM documents""")
def kanji_class_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", J.has_kanji("text").alias("has_kanji"), T.contains_japanese("text").alias("has_japanese"), T.is_japanese("text").alias("is_japanese"), F.size(J.kanji_in("text")).cast("long").alias("n_kanji"))


@query(f"""SELECT conv_id, turn, role, {S.n_words("text")} AS words, len(regexp_extract_all(text, '{T.JARGON}')) AS jargon, regexp_matches(text, '{T.ANALOGY}') AS analogy FROM conversations""")
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = T.text_metrics("text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", *[m[c].cast("long" if c != "analogy" else "boolean").alias(c) for c in ("words", "jargon", "analogy")])


@query(f"""WITH m AS (SELECT role, {S.n_words("text")} AS words, len(regexp_extract_all(text, '{T.JARGON}')) AS jargon, regexp_matches(text, '{T.ANALOGY}') AS analogy FROM conversations)
SELECT role, count(*) AS n, round(avg(words), 1) AS avg_words, round(avg(jargon), 1) AS avg_jargon, round(avg(analogy::INTEGER), 2) AS analogy_rate, NULL::DOUBLE AS judge_level_fit, NULL::DOUBLE AS judge_accuracy FROM m GROUP BY role""")
def prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    m = T.text_metrics("text")
    rows = table(spark, d, "conversations").select("role", m["words"].alias("words"), m["jargon"].alias("jargon"), m["analogy"].alias("analogy"), F.lit(None).cast("double").alias("level_fit"), F.lit(None).cast("double").alias("accuracy"))
    return evaluate.prompt_summary(rows, "role")


@query("""SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN (n // 1000)::VARCHAR || ',' || lpad((n % 1000)::VARCHAR, 3, '0')
  ELSE (n // 1000000)::VARCHAR || ',' || lpad((n // 1000 % 1000)::VARCHAR, 3, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0') END AS western,
  translate(CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 100000 THEN (n // 1000)::VARCHAR || ',' || lpad((n % 1000)::VARCHAR, 3, '0')
  ELSE (n // 100000)::VARCHAR || ',' || lpad((n // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0') END, '0123456789', '०१२३४५६७८९') AS indian
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def number_format(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long")
    return table(spark, d, "orders").select("o_orderkey", T.localised_number(n, F.lit("en")).alias("western"), T.localised_number(n, F.lit("hi")).alias("indian"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>', 0)) AS paragraphs FROM pages WHERE html LIKE '%<title>%'""")
def markup_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as one file of elements and read element by element."""
    pages = table(spark, d, "pages").where("html like '%<title>%'")
    path = tables.scratch(spark, "pages")
    element = F.concat(F.lit("<page id='"), F.col("page_id").cast("string"), F.lit("'><![CDATA["), F.replace("html", F.lit("]]>"), F.lit("]] >")), F.lit("]]></page>"))
    pages.select(element.alias("value")).write.text(path)
    xml = markup.elements(spark, path, "page")
    return xml.select(
        F.regexp_extract("xml", "^<page id='(-?\\d+)'", 1).cast("long").alias("page_id"), F.regexp_extract("xml", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("xml", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"),
    )


@query("""
WITH l AS (SELECT conv_id, turn, x.i AS i, list_extract(string_split(text, chr(10)), x.i) AS line FROM conversations, range(1, len(string_split(text, chr(10))) + 1) x(i)),
s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS lead FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lead ORDER BY i) AS nth FROM s WHERE lead <> '' AND NOT regexp_matches(lead, '^[。、…‥・ー「」『』 ,.!?:;—-]+$')),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS kept FROM f WHERE nth = 1)
SELECT conv_id, turn, string_agg(lead, chr(10) ORDER BY i) AS bullets FROM k WHERE kept <= 3 GROUP BY 1, 2""")
def tidy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line as a bullet: repeated and empty ones go, three stay."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.stripped), lambda x: x != "")
    bullets = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- **"), F.replace(x, F.lit("*"), F.lit("＊")), F.lit("**"))), "\n")
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), bullets.alias("text"))
    kept = explanations.tidy_texts(rows.select(F.to_json("id").alias("id"), "text"), 3)
    at = F.from_json("id", "conv_id long, turn long")
    plain = F.replace(F.regexp_replace("text", r"(?m)^- \*\*(.*)\*\*$", "$1"), F.lit("＊"), F.lit("*"))
    return kept.select(at["conv_id"].alias("conv_id"), at["turn"].alias("turn"), plain.alias("bullets")).where("bullets <> ''")


def _word_index(spark: SparkSession, d: str) -> DataFrame:
    """Document words as an index of forms, one candidate for each language."""
    words = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(T.tokens("text"))).alias("form"))
    counts = words.groupBy("form", "lang").agg(F.count("*").alias("n"))
    return counts.select("form", F.ascii("lang").cast("long").alias("ord"), F.col("form").alias("kanji_form"), F.col("lang").alias("reading"), F.array("lang").alias("meanings"), (F.col("n") >= 10).alias("is_common"), F.ln(F.col("n") + 1.0).alias("wf_score"))


@query(f"""WITH RECURSIVE words AS (SELECT DISTINCT form FROM (SELECT unnest({S.tokens("text")}) AS form FROM documents)),
turns AS (SELECT conv_id || '/' || turn AS id, x.n::INTEGER AS sentence, {S.stripped("list_extract(string_split_regex(lower(text), '[.\n]'), x.n + 1)")} AS s FROM conversations, range(0, len(string_split_regex(lower(text), '[.\n]'))) x(n)),
kept AS (SELECT * FROM turns WHERE s <> '' AND length(s) <= 100 AND s NOT IN (SELECT form FROM words)),
pieces AS (SELECT id, sentence, s, a.place, k.k, substr(s, a.place, k.k) AS form FROM kept, range(1, length(s) + 1) a(place), range(1, 9) k(k) WHERE a.place + k.k - 1 <= length(s) AND (k.k > 1 OR regexp_matches(substr(s, a.place, 1), '[{S.HAN}]'))),
m AS (SELECT id, sentence, s, place, max(k) AS k FROM pieces JOIN words USING (form) GROUP BY ALL),
nx AS (SELECT a.id, a.sentence, a.s, a.place, a.k, min(b.place) AS nxt FROM m a LEFT JOIN m b ON b.id = a.id AND b.sentence = a.sentence AND b.place >= a.place + a.k GROUP BY ALL),
first AS (SELECT id, sentence, min(place) AS place FROM m GROUP BY 1, 2),
chain AS (SELECT nx.*, 0 AS pos FROM nx JOIN first USING (id, sentence, place) UNION ALL SELECT nx.*, chain.pos + 1 FROM chain JOIN nx ON nx.id = chain.id AND nx.sentence = chain.sentence AND nx.place = chain.nxt)
SELECT id, sentence, pos, substr(s, place, k) AS text, true AS approx FROM chain WHERE (SELECT count(*) FROM chain c WHERE c.id = chain.id AND c.sentence = chain.sentence) > 1""")
def greedy_segment(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every turn, numbered from 0; the operator's guard gives none for those above its length."""
    turns = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("turn_id"), F.posexplode(F.split(F.lower("text"), r"[.\n]")).alias("n", "sentence"))
    rows = turns.select(F.concat_ws("/", "turn_id", "n").alias("id"), T.stripped(F.col("sentence")).alias("sentence")).where("sentence <> ''")
    found = segmentation.segment_sentences(rows, tables.staged(_word_index(spark, d), "word-index"))
    at = F.length("id") - F.length(F.substring_index("id", "/", -1))
    return found.select(F.substring(F.col("id"), F.lit(1), at - 1).alias("id"), F.substring_index("id", "/", -1).cast("int").alias("sentence"), "pos", "text", "approx")


QUERIES, ORACLE_SQL = query.queries, query.sql
