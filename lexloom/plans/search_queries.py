"""Queries of the retrieval engine: keys, postings, arms, fusion, the routed search and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, evaluate, keys, retrieval
from ..sources.tables import staged
from . import sqltext as S
from .registry import Registry, table

query = Registry()


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries with priors; labels cover a part of them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return docs.join(labels, "id", "left").withColumns({"commonness": F.coalesce(F.col("quality"), F.lit(0)).cast("double"), "wf_score": F.round(F.log1p("n_chars"), 3), "is_common": F.coalesce(F.col("quality") == 1, F.lit(False))})


def sentence_keys(docs: DataFrame) -> DataFrame:
    """(kind, key, id): each sentence is a gloss; the first sentence is the primary and head gloss too."""
    rows = docs.select("id", F.posexplode(F.split("text", r"[.\n]")).alias("n", "s")).select("id", "n", T.gloss_key("s").alias("key"))
    kinds = F.when(F.col("n") == 0, F.array(F.lit(keys.ALL), F.lit(keys.PRIMARY), F.lit(keys.HEAD))).otherwise(F.array(F.lit(keys.ALL)))
    # no filter on the key, which would work it out once more below the projection
    return rows.select(F.explode(F.when(F.col("key") != "", kinds)).alias("kind"), "key", "id")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item asks twice: by its first sentence and by that sentence's first two words."""
    items = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_extract("text", r"^([^.\n]*)", 1)).alias("s"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qv"))
    asked = F.array(F.struct(F.lit(0).alias("k"), F.col("s").alias("query")), F.struct(F.lit(1).alias("k"), F.array_join(F.slice(F.split("s", " "), 1, 2), " ").alias("query")))
    rows = items.join(vectors, "item_id", "left").select("item_id", "qv", F.explode(asked).alias("a"))
    return rows.select((F.col("item_id") * 2 + F.col("a.k")).alias("qid"), F.col("a.query").alias("query"), "qv")


def normal_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).where(~T.too_long("query")).select("qid", T.normalise("query").alias("q"), "qv").withColumn("route", T.route("q"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def store(spark: SparkSession, d: str) -> retrieval.Store:
    """Priors and texts apart, so that no join carries texts."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.Store(entries(spark, d).drop("text"), sentence_keys(texts(spark, d)), vectors, texts=texts(spark, d))


POOL = retrieval.pool_size(5)
_Q = f"""items AS (SELECT item_id, trim(regexp_extract(text, '^([^.\\n]*)', 1)) AS s FROM benchmark),
asked AS (SELECT item_id * 2 AS qid, item_id, s AS query FROM items UNION ALL SELECT item_id * 2 + 1, item_id, array_to_string(list_slice(string_split(s, ' '), 1, 2), ' ') FROM items),
questions AS (SELECT qid, item_id, {S.normalise("query")} AS q, {S.gloss_key(S.normalise("query"))} AS k, {S.route(S.normalise("query"))} AS route FROM asked WHERE length(query) <= 150)"""
_KEYS = f"""sentences AS (SELECT doc_id AS id, x.n AS n, {S.gloss_key("list_extract(string_split_regex(text, '[.\\n]'), x.n)")} AS key FROM documents, range(1, len(string_split_regex(text, '[.\\n]')) + 1) x(n)),
flags AS (SELECT qid, id, 1 AS exact, max((n = 1)::INTEGER) AS prim, max((n = 1)::INTEGER) AS head FROM questions JOIN sentences ON k = key WHERE key <> '' GROUP BY 1, 2)"""
_BM25 = f"""words AS (SELECT doc_id AS id, {S.tokens("text")} AS ts FROM documents), size AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM words),
posts AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM words), tf AS (SELECT term, id, dl, count(*) AS tf FROM posts GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wanted AS (SELECT DISTINCT qid, unnest({S.tokens("q")}) AS term FROM questions),
bm AS (SELECT qid, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM wanted JOIN tf USING (term) JOIN df USING (term), size GROUP BY 1, 2)"""


def _top(source: str, k: int, order: str = "score DESC, id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM ({source})) WHERE rank <= {k}"


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_DENSE = f"""near AS (SELECT qid, b.vec_id AS id, {_COS} AS score FROM questions JOIN embeddings a ON a.vec_id = item_id, embeddings b)"""
_PRIOR = "prior AS (SELECT doc_id AS id, coalesce(quality, 0)::DOUBLE AS c, round(ln(1 + n_chars), 3) AS wf FROM documents LEFT JOIN labels USING (doc_id))"


def _fuse(arms: list[tuple[str, float]]) -> str:
    parts = " UNION ALL ".join(f"SELECT qid, id, {w}::DOUBLE / (60 + rank) AS s FROM ({a})" for a, w in arms)
    return f"SELECT qid, id, round(sum(s), 6) AS score FROM ({parts}) GROUP BY 1, 2"


@query(f"SELECT term, id, count(*) AS tf, dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT doc_id AS id, {S.tokens('text')} AS ts FROM documents)) GROUP BY ALL")
def tokenize_postings(spark: SparkSession, d: str) -> DataFrame:
    return keys.postings(table(spark, d, "documents"), "doc_id").select("term", "id", "tf", F.col("dl").cast("long").alias("dl"))


@query(f"""SELECT form, lang AS kanji_form, min(doc_id) AS id FROM (SELECT doc_id, lang, unnest(list_distinct({S.tokens("text")})) AS form FROM documents) WHERE form <> lang GROUP BY 1, 2""")
def form_index(spark: SparkSession, d: str) -> DataFrame:
    """Words as forms of a headword that is the language: the first entry of each (form, headword)."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kanji_form"), F.lit(None).cast("string").alias("reading"), T.tokens("text").alias("kanji_forms"), F.array().cast("array<string>").alias("readings"))
    return keys.form_index(rows).where("form <> kanji_form").select("form", "kanji_form", "id")


@query(f"WITH {_Q}, {_KEYS} SELECT qid, id, exact, prim AS primary, head FROM flags")
def match_keys_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return keys.exact_matches(normal_questions(spark, d), sentence_keys(texts(spark, d)))


@query(f"WITH {_Q}, {_BM25} {_top('SELECT * FROM bm', 5)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(normal_questions(spark, d), texts(spark, d), 5)


@query(f"WITH {_Q}, {_DENSE} {_top('SELECT * FROM near', 5)}")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense(normal_questions(spark, d), store(spark, d).vectors, 5)


@query(f"WITH {_Q}, {_KEYS}, {_PRIOR} {_top('SELECT qid, id, c AS score FROM flags JOIN prior USING (id)', 5)}")
def exact_arm_by_prior(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    flags = keys.exact_matches(normal_questions(spark, d), s.keys).where("exact = 1")
    return retrieval.ranked(flags.join(s.entries.select("id", F.col("commonness").alias("score")), "id").select("qid", "id", "score"), 5)


_EXACT_NEAR = "SELECT f.qid, f.id, score FROM flags f JOIN near USING (qid, id)"


@query(f"WITH {_Q}, {_KEYS}, {_BM25}, {_DENSE} {_top(_fuse([(_top('SELECT * FROM bm', POOL), 1.0), (_top('SELECT * FROM near', POOL), 1.0), (_top(_EXACT_NEAR, POOL), 1.0)]), 5)}")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(normal_questions(spark, d), store(spark, d))


@query(f"WITH {_Q}, {_BM25}, {_DENSE} {_top(_fuse([(_top('SELECT * FROM bm', 50), 1.0), (_top('SELECT * FROM near', 50), 1.0)]), 5)}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    q, s = normal_questions(spark, d), store(spark, d)
    return retrieval.fuse([(retrieval.bm25(q, s.texts, 50), 1.0), (retrieval.dense(q, s.vectors, 50), 1.0)], 5)


@query(f"WITH {_Q}, {_BM25}, {_DENSE} {_top(_fuse([(_top('SELECT * FROM bm', 50), 1.0), (_top('SELECT * FROM near', 50), 2.0)]), 5)}")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    q, s = normal_questions(spark, d), store(spark, d)
    return retrieval.fuse([(retrieval.bm25(q, s.texts, 50), 1.0), (retrieval.dense(q, s.vectors, 50), 2.0)], 5)


def _formula(fused: str, word: bool) -> str:
    more = " + 1.0 * coalesce(exact, 0) + 1.5 * wf * coalesce(head, 0)" if word else ""
    return f"SELECT qid, id, round(score + c + 3.0 * wf * coalesce(prim, 0) * c{more}, 6) AS score FROM ({fused}) JOIN prior USING (id) LEFT JOIN flags USING (qid, id)"


_JA = _top(_fuse([(_top("SELECT * FROM bm", POOL), 1.0), (_top("SELECT qid, id, c AS score FROM flags JOIN prior USING (id)", POOL), 2.0)]), POOL)
_WORD = _top(_fuse([(_top("SELECT * FROM bm", POOL), 1.0), (_top("SELECT bm.* FROM bm JOIN flags USING (qid, id)", POOL), 1.0), (_top("SELECT * FROM near", POOL), 1.0), (_top(_EXACT_NEAR, POOL), 1.0)]), 2 * POOL)
_SENTENCE = _fuse([(_top("SELECT * FROM bm", POOL), 1.0), (_top("SELECT * FROM near", POOL), 2.0)])


@query(f"WITH {_Q}, {_KEYS}, {_BM25}, {_PRIOR} {_top(_formula(_JA, False), 5)}")
def formula_score_ja(spark: SparkSession, d: str) -> DataFrame:
    """The Japanese route's arms and formula, applied to every query."""
    q, s = normal_questions(spark, d).withColumn("route", F.lit("ja")), store(spark, d)
    return retrieval.routed(q, s)


@query(f"WITH {_Q}, {_KEYS}, {_BM25}, {_DENSE}, {_PRIOR} {_top(_formula(_WORD, True), 5)}")
def formula_score_en(spark: SparkSession, d: str) -> DataFrame:
    """The one-word route's arms and formula, applied to every query."""
    q, s = normal_questions(spark, d).withColumn("route", F.lit("en_word")), store(spark, d)
    return retrieval.routed(q, s)


_AUTO = f"""WITH {_Q}, {_KEYS}, {_BM25}, {_DENSE}, {_PRIOR}, scored AS (
SELECT w.* FROM ({_formula(_WORD, True)}) w JOIN questions USING (qid) WHERE route = 'en_word'
UNION ALL SELECT s.* FROM ({_SENTENCE}) s JOIN questions USING (qid) WHERE route = 'en_sentence'
UNION ALL SELECT j.* FROM ({_formula(_JA, False)}) j JOIN questions USING (qid) WHERE route = 'ja'), best AS ({_top("SELECT * FROM scored", 5)})"""


@query(f"{_AUTO} SELECT qid, id, score, rank, q, 'none' AS method FROM best JOIN questions USING (qid)")
def auto_route_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: guard, rewrite, route, arms, fusion, formula, five results for each query."""
    return retrieval.search(questions(spark, d), store(spark, d))


_PIVOT = f"""WITH c AS (SELECT item_id AS qid, x.n AS candidate, trim(list_extract(string_split_regex(text, '[.,\\n]'), x.n + 1)) AS s FROM benchmark, range(0, len(string_split_regex(text, '[.,\\n]'))) x(n)),
sentences AS (SELECT doc_id AS id, {S.gloss_key("s")} AS key FROM (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS s FROM documents)),
hits AS (SELECT DISTINCT qid, candidate, id FROM c JOIN sentences ON {S.gloss_key("c.s")} = key WHERE key <> '')"""


@query(f"{_PIVOT} SELECT * FROM hits WHERE candidate = (SELECT min(candidate) FROM hits h WHERE h.qid = hits.qid)")
def pivot_first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """Each item's pieces are tried in order as exact glosses; the first piece with matches answers."""
    pieces = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.split("text", r"[.,\n]")).alias("candidate", "s"))
    known = sentence_keys(texts(spark, d)).where(F.col("kind") == keys.ALL).select("key", "id")
    hits = pieces.select("qid", "candidate", T.gloss_key(F.trim("s")).alias("key")).join(known, "key").select("qid", F.col("candidate").cast("long").alias("candidate"), "id").distinct()
    return retrieval.first_nonempty(hits)


@query(f"""WITH {_Q}, {_KEYS}, res AS (SELECT qid, id, 1.0 AS score, rank, NULL::VARCHAR AS surface FROM ({_top("SELECT qid, id, 1.0 AS score FROM flags", 5)})),
seg AS (SELECT qid, x.n AS rank, list_extract(string_split(q, ' '), x.n) AS surface FROM questions, range(1, len(string_split(q, ' ')) + 1) x(n))
SELECT * FROM res UNION ALL SELECT qid, NULL, 0.0, rank, surface FROM seg WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM res)""")
def promote_segments(spark: SparkSession, d: str) -> DataFrame:
    q = normal_questions(spark, d)
    found = retrieval.ranked(keys.exact_matches(q, sentence_keys(texts(spark, d))).select("qid", "id", F.lit(1.0).alias("score")), 5)
    return retrieval.promoted(q, found, q.select("qid", F.posexplode(F.split("q", " ")).alias("pos", "surface")))


_TOP10 = f"""SELECT term, rank, id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY c DESC, wf DESC, id) AS rank
FROM (SELECT doc_id AS id, coalesce(quality, 0) AS c, round(ln(1 + n_chars), 3) AS wf, unnest(list_distinct({S.tokens("text")})) AS term FROM documents LEFT JOIN labels USING (doc_id))) WHERE rank <= 10"""


@query(_TOP10)
def inverted_index_top10(spark: SparkSession, d: str) -> DataFrame:
    docs = entries(spark, d)
    return browse.inverted_top(docs, T.tokens("text"), [F.col("commonness"), F.col("wf_score")])


@query(f"""WITH top AS ({_TOP10}), t AS (SELECT item_id AS id, {S.tokens("text")} AS ts FROM benchmark), h AS (SELECT id, unnest(ts) AS term, generate_subscripts(ts, 1) AS n FROM t),
p AS (SELECT h.id, top.id AS other, min(n * 100 + rank) AS pl FROM (SELECT id, term, min(n) AS n FROM h GROUP BY 1, 2) h JOIN top USING (term) GROUP BY 1, 2)
SELECT id, rank, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY pl, other) AS rank FROM p) WHERE rank <= 8""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that an item's words list among their ten best, in the order of the words."""
    top = browse.inverted_top(entries(spark, d), T.tokens("text"), [F.col("commonness"), F.col("wf_score")]).withColumnRenamed("id", "other")
    return browse.related_by_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.tokens("text").alias("terms")), top)


def _vector_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector as a query with the number of its label's other vectors, and its five nearest others with their relevance: the same label."""
    rows = table(spark, d, "embeddings")
    queries = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").cast("string").alias("category"))
    found = retrieval.dense(queries, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 6).where("qid <> id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 5")
    sizes = queries.groupBy("category").agg((F.count("*") - 1).alias("n_relevant"))
    queries = queries.join(sizes, "category").select("qid", "category", "n_relevant")
    own = rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("own"))
    found = found.join(own, "id").join(queries.select("qid", "category"), "qid")
    return queries, found.select("qid", "id", "rank", (F.col("own") == F.col("category")).alias("rel"))


_IR = f"""WITH near AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label = b.label AS rel, {_COS} AS score FROM embeddings a, embeddings b),
six AS ({_top("SELECT * FROM near", 6)}), top AS (SELECT qid, id, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM six WHERE qid <> id),
f AS (SELECT *, sum(rel::INTEGER) OVER (PARTITION BY qid ORDER BY rank) AS found FROM top WHERE rank <= 5),
n AS (SELECT a.vec_id AS qid, a.label::VARCHAR AS category, (SELECT count(*) FROM embeddings b WHERE b.label = a.label) - 1 AS r FROM embeddings a),
m AS (SELECT qid, min(CASE WHEN rel THEN rank END) AS hit, sum(rel::INTEGER) AS hits, sum(CASE WHEN rel THEN 1 / log2(rank + 1) END) AS dcg, sum(CASE WHEN rel THEN found::DOUBLE / rank END) AS p FROM f GROUP BY 1),
q AS (SELECT qid, category, r AS n_relevant, coalesce(hit <= 1, false)::INTEGER AS hit1, coalesce(hit <= 2, false)::INTEGER AS hit2, coalesce(hit <= 3, false)::INTEGER AS hit3, coalesce(hit <= 5, false)::INTEGER AS hit5,
round(coalesce(1.0::DOUBLE / hit, 0), 6) AS rr, round(CASE WHEN r = 0 THEN 0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(r, 5) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg,
round(CASE WHEN r = 0 THEN 0 ELSE coalesce(p, 0) / r END, 6) AS ap, round(CASE WHEN r = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / r END, 6) AS recall, coalesce(hit, 0) AS hit_rank FROM n LEFT JOIN m USING (qid))"""
_MEANS = ", ".join(f"round(avg({c}), 5) AS {c}" for c in ("hit1", "hit2", "hit3", "hit5", "rr", "ndcg", "ap", "recall"))


@query(f"{_IR} SELECT qid, n_relevant, hit1, hit2, hit3, hit5, rr, ndcg, ap, recall FROM q")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, found = _vector_run(spark, d)
    return evaluate.flagged_metrics(found, queries)


@query(f"{_IR} SELECT category, count(*) AS n, {_MEANS} FROM q GROUP BY 1 UNION ALL SELECT NULL, count(*), {_MEANS} FROM q")
def ir_by_category(spark: SparkSession, d: str) -> DataFrame:
    queries, found = _vector_run(spark, d)
    m = staged(evaluate.flagged_metrics(found, queries).join(queries.select("qid", "category"), "qid"), "metrics")
    return evaluate.averages(m, "category").unionByName(evaluate.averages(m.drop("category")).withColumn("category", F.lit(None).cast("string")))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    queries, found = _vector_run(spark, d)
    return evaluate.rank_of_expected(found, queries, F.col("rel")).join(queries.select("qid", "category"), "qid")


_HITS = "count(*) AS n, sum((hit_rank = 1)::INTEGER) AS hit1, sum((hit_rank BETWEEN 1 AND 2)::INTEGER) AS hit2, sum((hit_rank BETWEEN 1 AND 5)::INTEGER) AS hit5"


@query(f"{_IR} SELECT category, {_HITS} FROM q GROUP BY ROLLUP (category)")
def hit_table_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_rollup(_ranks(spark, d))


@query(f"{_IR} SELECT category, {_HITS} FROM q GROUP BY 1 UNION ALL SELECT NULL, {_HITS} FROM q WHERE category <> '9'")
def hit_table_subtotal(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_table(_ranks(spark, d), excluded="9")


_KNOBS = [("flat", 1.0, 1.0), ("text", 3.0, 1.0), ("dense", 1.0, 3.0)]


@query(f"""WITH {_Q}, {_BM25}, {_DENSE}, ranks AS ({" UNION ALL ".join(f"SELECT qid, '{n}' AS variant, rank FROM ({_top(_fuse([(_top('SELECT * FROM bm', 50), a), (_top('SELECT * FROM near', 50), b)]), 20)}) r JOIN questions USING (qid) WHERE r.id = item_id" for n, a, b in _KNOBS)})
SELECT qid, {", ".join(f"coalesce(max(CASE WHEN variant = '{n}' THEN rank END), 0) AS {n}" for n, _, _ in _KNOBS)} FROM questions LEFT JOIN ranks USING (qid) GROUP BY 1""")
def knob_sweep_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The rank of the entry numbered like the item, under three weightings of two arms."""
    q, s = normal_questions(spark, d), store(spark, d)
    text, near = retrieval.bm25(q, s.texts, 50), retrieval.dense(q, s.vectors, 50)
    rows = None
    for name, a, b in _KNOBS:
        found = retrieval.fuse([(text, a), (near, b)], 20)
        part = evaluate.rank_of_expected(found, q, F.col("id") == F.floor(F.col("qid") / 2)).withColumn("variant", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return evaluate.sweep(rows, [n for n, _, _ in _KNOBS])


QUERIES, ORACLE_SQL = query.queries, query.sql
