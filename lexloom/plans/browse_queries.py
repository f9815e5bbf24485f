"""Queries of browsing, enrichment and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, entries, incremental
from ..sources import tables
from . import sqltext as S
from .registry import Registry, table

query = Registry()

#: Language names and tags of the test tables' codes.
NAMES, TAGS = {"en": "English", "fr": "French", "de": "German"}, {"en": "en", "fr": "fr", "de": "de"}


def _literal_map(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


@query("SELECT p_size AS value, count(*) AS count FROM part WHERE p_size IS NOT NULL AND p_size <> 0 GROUP BY 1")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return browse.facet_counts(table(spark, d, "part"), "p_size")


@query("SELECT b.v AS value, count(p_partkey) AS count FROM (VALUES (100), (250), (500), (1000), (1500), (2000), (2500)) b(v) LEFT JOIN part ON p_partkey <= b.v AND p_partkey <> 0 GROUP BY 1")
def cumulative_bands(spark: SparkSession, d: str) -> DataFrame:
    return browse.cumulative_bands(table(spark, d, "part"), "p_partkey")


_CHARS = "SELECT p_partkey AS literal, p_size % 30 AS stroke_count, p_size % 11 AS grade, p_size % 5 AS jlpt_level, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS freq FROM part"


def _characters(spark: SparkSession, d: str) -> DataFrame:
    """Parts as characters: size gives strokes, grade and level, the key a frequency rank for two of three."""
    p, size = table(spark, d, "part"), F.col("p_size")
    return p.select(F.col("p_partkey").alias("literal"), (size % 30).alias("stroke_count"), (size % 11).alias("grade"), (size % 5).alias("jlpt_level"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("freq"))


@query(f"""WITH k AS ({_CHARS}) SELECT 'strokes' AS "by", stroke_count AS value, count(*) AS count, stroke_count AS ord FROM k WHERE stroke_count <> 0 GROUP BY 2
UNION ALL SELECT 'grade', grade, count(*), grade FROM k WHERE grade <> 0 GROUP BY 2 UNION ALL SELECT 'jlpt', jlpt_level, count(*), -jlpt_level FROM k WHERE jlpt_level <> 0 GROUP BY 2
UNION ALL SELECT 'freq', b.v, count(freq), b.v FROM (VALUES (100), (250), (500), (1000), (1500), (2000), (2500)) b(v) LEFT JOIN k ON freq <= b.v GROUP BY b.v""")
def character_facets(spark: SparkSession, d: str) -> DataFrame:
    return browse.character_facets(_characters(spark, d))


@query(f"WITH k AS ({_CHARS}) SELECT *, (SELECT count(*) FROM k WHERE stroke_count = 7) AS total FROM (SELECT * FROM k WHERE stroke_count = 7 ORDER BY coalesce(freq, 1000000000), literal LIMIT 20 OFFSET 5)")
def group_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.character_group(_characters(spark, d), "strokes", "7", 20, 5)


@query(f"WITH k AS ({_CHARS}) SELECT *, (SELECT count(*) FROM k WHERE freq <= 300) AS total FROM (SELECT * FROM k WHERE freq <= 300 ORDER BY freq, literal LIMIT 40)")
def frequency_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.character_group(_characters(spark, d), "freq", 300)


def _borrowed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as loanwords: their language, the source's number as a second language, every seventh source made at home."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    item = lambda lang, wasei: F.struct(lang.alias("lang"), F.lit("").alias("text"), F.lit(None).cast("string").alias("type"), wasei.alias("wasei"))
    items = F.array(item(F.col("lang"), F.lit(False)), item(F.concat(F.lit("s"), (n % 3).cast("string")), n % 7 == 0), item(F.col("lang"), F.lit(False)))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("kanji_form"), F.col("lang").alias("reading"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_common"), F.round(F.log1p("n_chars"), 3).alias("wf_score"), items.alias("lsource"))


_LOANS = """WITH d AS (SELECT doc_id AS id, source, lang AS own, coalesce(quality, 0) = 1 AS is_common, round(ln(1 + n_chars), 3) AS wf, regexp_extract(source, '(\\d+)', 1)::INTEGER AS n FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT *, own AS lang FROM d UNION ALL SELECT *, 's' || (n % 3) FROM d UNION ALL SELECT *, 'wasei' FROM d WHERE n % 7 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY is_common DESC, wf DESC, source, own, id) AS ord FROM b)"""


@query(f"{_LOANS} SELECT lang, count(*) AS count FROM o WHERE lang <> 'wasei' GROUP BY 1")
def lang_facets(spark: SparkSession, d: str) -> DataFrame:
    return browse.loanword_counts(_borrowed(spark, d))


@query(f"{_LOANS} SELECT id, ord, (SELECT count(*) FROM o WHERE lang = 'wasei') AS total FROM o WHERE lang = 'wasei' AND ord BETWEEN 11 AND 60")
def lang_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.loanword_page_of(_borrowed(spark, d), "wasei", 10, 50).select("id", "ord", "total")


@query("""WITH d AS (SELECT doc_id, lang, regexp_extract(source, '(\\d+)', 1)::INTEGER AS n, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS name FROM documents)
SELECT doc_id, lang, CASE WHEN n % 7 = 0 THEN 'Wasei-eigo (Japanese-made English)' WHEN n % 2 = 0 THEN 'Partly from ' || name ELSE 'From ' || name END AS label, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang END AS tag FROM d""")
def dim_enrich(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    item = F.array(F.struct("lang", F.lit("").alias("text"), F.when(n % 2 == 0, F.lit("part")).alias("type"), (n % 7 == 0).alias("wasei")))
    x = browse.enriched_sources(item, _literal_map(NAMES), _literal_map(TAGS))[0]
    return table(spark, d, "documents").select("doc_id", "lang", x["label"].alias("label"), x["tag"].alias("tag"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, max(coalesce(quality, 0)) = 1 AS is_common FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY is_common DESC, n DESC, lang) AS r FROM c)
SELECT source, array_to_string(list(lang || ' — ' || lang ORDER BY r), ' / ') AS options FROM o GROUP BY 1""")
def ambiguous_order(spark: SparkSession, d: str) -> DataFrame:
    """Each source as a form, its languages as the candidates: common first, then frequent."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    c = docs.groupBy("source", "lang").agg((F.max(F.coalesce("quality", F.lit(0))) == 1).alias("is_common"), F.count("*").cast("double").alias("wf_score"))
    cands = c.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("reading"), F.array("lang").alias("meanings"), "is_common", "wf_score"))).alias("c"))
    return cands.select("source", F.array_join(browse.ambiguous_options(F.col("c")), " / ").alias("options"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents now, and as they were stored: some not yet there, some with other text, some without signature, some since gone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    sig = lambda t: F.substring(F.sha1(F.concat_ws("|", t, "lang")), 1, 16)
    new = docs.where("id % 10 <> 9").select("id", sig(F.col("text")).alias("sig"))
    old = docs.where("id % 10 <> 0").select("id", F.when(F.col("id") % 10 == 1, F.lit(None)).otherwise(sig(F.when(F.col("id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).alias("sig"))
    return new, old


@query("SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 9 THEN 'gone' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2, 9)")
def diff_new_changed_vanished(spark: SparkSession, d: str) -> DataFrame:
    return incremental.diff(*_snapshots(spark, d))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 6
    new = docs.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("meanings"), F.concat_ws(": ", "source", "lang").alias("sparse_text"), F.col("text"))
    old = docs.where(k != 0).select(
        F.col("doc_id").alias("id"), F.when(k == 1, F.array("lang")).otherwise(F.array("lang", "source")).alias("meanings"),
        F.when(k.isin(2, 3), F.lit(None)).when(k == 4, F.col("lang")).otherwise(F.concat_ws(": ", "source", "lang")).alias("sparse_text"), F.when(k == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"),
    )
    return old, new


@query("""SELECT CASE doc_id % 6 WHEN 0 THEN 'unseen' WHEN 1 THEN 'drift: meanings' WHEN 3 THEN 'drift: legacy text' WHEN 4 THEN 'drift: sparse text' ELSE 'reuse' END AS decision, count(*) AS n FROM documents GROUP BY 1""")
def reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    return incremental.decision_counts(incremental.reuse_decisions(*_versions(spark, d)))


@query("""SELECT doc_id AS id, substr(sha1('{"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'), 1, 16) AS sig FROM documents""")
def content_signature(spark: SparkSession, d: str) -> DataFrame:
    """The signature of the whole row, its text included."""
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").alias("id"), entries.signature([c for c in rows.columns if c != "doc_id"], rows).alias("sig"))


_MSG = "SELECT lang AS locale, source AS key, 'n' || count(*)::VARCHAR || CASE WHEN count(*) % 2 = 0 THEN ' {x}' ELSE '' END AS text FROM documents WHERE length(source) <= 4 OR lang <> 'es' GROUP BY 1, 2"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Counts by language and source as messages of four locales; one locale lacks some keys."""
    docs = table(spark, d, "documents").where("length(source) <= 4 or lang <> 'es'").groupBy(F.col("lang").alias("locale"), F.col("source").alias("key")).agg(F.count("*").alias("n"))
    return docs.select("locale", "key", F.concat(F.lit("n"), F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, F.lit(" {x}")).otherwise(F.lit(""))).alias("text"))


@query(f"""WITH m AS ({_MSG}), l AS (SELECT DISTINCT locale FROM m WHERE locale <> 'en'), k AS (SELECT key FROM m WHERE locale = 'en')
SELECT l.locale, k.key, 'missing' AS problem FROM l, k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.locale = l.locale AND m.key = k.key) UNION ALL SELECT locale, key, 'extra' FROM m WHERE locale <> 'en' AND key NOT IN (SELECT key FROM k)""")
def key_parity(spark: SparkSession, d: str) -> DataFrame:
    return browse.key_parity(_messages(spark, d), "en")


@query(f"WITH m AS ({_MSG}) SELECT a.locale, a.key FROM m a JOIN m b ON a.key = b.key AND b.locale = 'en' WHERE a.locale <> 'en' AND contains(a.text, '{{x}}') <> contains(b.text, '{{x}}')")
def placeholder_parity(spark: SparkSession, d: str) -> DataFrame:
    return browse.placeholder_parity(_messages(spark, d), "en")


@query(f"WITH m AS ({_MSG}) SELECT key, max(CASE WHEN locale = 'en' THEN text END) AS en, max(CASE WHEN locale = 'de' THEN text END) AS de, max(CASE WHEN locale = 'es' THEN text END) AS es, max(CASE WHEN locale = 'fr' THEN text END) AS fr FROM m GROUP BY 1")
def tsv_pivot(spark: SparkSession, d: str) -> DataFrame:
    return tables.export_messages(_messages(spark, d), ["en", "de", "es", "fr"])


@query("""SELECT p_partkey AS id, greatest(CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 0.5 ELSE 0 END, coalesce(CASE WHEN p_size % 2 = 0 THEN round(0.75 * (49 - (p_size % 48 + 1)) / 48, 4) END, 0))::DOUBLE AS commonness,
CASE WHEN p_size % 2 = 0 THEN p_size % 48 + 1 END AS freq_band FROM part""")
def commonness_prior(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes as markers: a tier by the rest of three, a band for even sizes."""
    size = F.col("p_size")
    tier = F.when(size % 3 == 0, F.lit("ichi1")).when(size % 3 == 1, F.lit("news2"))
    marks = F.array_compact(F.array(tier, F.when(size % 2 == 0, F.format_string("nf%02d", size % 48 + 1))))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), marks.alias("marks"))
    band = entries.frequency_band(F.col("marks"))
    return rows.select("id", entries.commonness(F.col("marks"), band).alias("commonness"), band.alias("freq_band"))


_GLOSSES = f"""SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda s: {S.gloss_key("s")}), lambda k: k <> '') AS keys FROM documents"""
_HEADS = "list_transform(list_filter(keys, lambda k: contains(k, ' ') AND NOT regexp_matches(k, '^(to |and |or |be )') AND regexp_matches(string_split(k, ' ')[1], '^\\p{L}+$')), lambda k: string_split(k, ' ')[1])"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(keys, list_transform(list_filter(keys, lambda k: k LIKE 'to %'), lambda k: substr(k, 4))), {_HEADS}))), '|') AS keys FROM ({_GLOSSES})""")
def gloss_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as glosses: their keys, those without "to ", and head words."""
    return table(spark, d, "documents").select("doc_id", F.array_join(entries.key_set(F.split("text", r"[.\n]")), "|").alias("keys"))


@query("""WITH w AS (SELECT l_partkey AS term, l_orderkey AS id, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT term, rank, id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY o_totalprice DESC, id) AS rank FROM w JOIN orders ON o_orderkey = id) WHERE rank <= 10""")
def top_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries, their parts as characters: the ten dearest orders of each part."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))  # an order has at most seven lines
    orders = table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "parts", "o_totalprice")
    return browse.inverted_top(orders, F.col("parts"), [F.col("o_totalprice")])


QUERIES, ORACLE_SQL = query.queries, query.sql
