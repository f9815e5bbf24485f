"""Match keys, form index and postings: the tables that take the place of a store's secondary indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of keys, by what they were taken from.
FORM, ALL, PRIMARY, HEAD, INFLECTED = "form", "all", "primary", "head", "infl"


def match_keys(entries: DataFrame) -> DataFrame:
    """(kind, key, id), one row for each key of an entry.

    One exploded table lets every lookup be an equi-join; an OR over array columns would be a nested loop.
    """
    none = F.array().cast("array<string>")

    def of(kind: str, keys: Column) -> Column:
        return F.transform(F.array_distinct(F.array_compact(F.coalesce(keys, none))), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    have = set(entries.columns)
    forms = F.array_union(F.array_union(F.coalesce("kanji_forms", none), F.coalesce("readings", none)), F.array("kanji_form", "reading"))
    parts = [of(FORM, forms), of(ALL, F.col("gloss_keys")), of(PRIMARY, F.col("primary_gloss_keys")), of(HEAD, F.col("head_gloss_keys"))]
    if "infl_forms" in have:
        parts.append(of(INFLECTED, F.col("infl_forms")))
    return entries.select("id", F.explode(F.concat(*parts)).alias("k")).select("k.kind", "k.key", "id").where("key <> ''")


def exact_matches(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, id, exact, primary, head) of the entries that a query's text or key names; ``queries`` has qid and q.

    Forms and inflections are matched by the text, glosses by its key.  Inflections count for ``exact`` alone.
    """
    wanted = queries.select("qid", F.explode(F.array_distinct(F.array(F.struct(F.lit(True).alias("as_form"), F.col("q").alias("key")), F.struct(F.lit(False).alias("as_form"), T.gloss_key("q").alias("key"))))).alias("w"))
    wanted = wanted.select("qid", "w.as_form", "w.key")
    by_form = F.col("kind").isin(FORM, INFLECTED)
    hits = keys.withColumn("as_form", by_form).join(wanted, ["as_form", "key"])
    flag = lambda c: F.max(c.cast("int"))
    return hits.groupBy("qid", "id").agg(
        flag(F.col("kind").isin(FORM, ALL, INFLECTED)).alias("exact"), flag(F.col("kind").isin(FORM, PRIMARY)).alias("primary"), flag(F.col("kind") == HEAD).alias("head")
    ).where("exact = 1 or primary = 1 or head = 1")


def is_headword(terms: DataFrame, keys: DataFrame, term_col: str = "term") -> DataFrame:
    """The rows of ``terms`` whose term is a written form or reading of some entry."""
    forms = keys.where(F.col("kind") == FORM).select(F.col("key").alias("__form")).distinct()
    return terms.join(forms, terms[term_col] == F.col("__form"), "left_semi")


def form_index(entries: DataFrame, order_col: str = "id") -> DataFrame:
    """(form, ord, id, kanji_form, reading, ...): candidates of each form, the first entry of each (form, kanji_form, reading)."""
    none = F.array().cast("array<string>")
    forms = F.array_distinct(F.array_compact(F.concat(F.array("kanji_form", "reading"), F.coalesce("kanji_forms", none), F.coalesce("readings", none))))
    keep = [c for c in ("id", "kanji_form", "reading", "meanings", "is_common", "wf_score") if c in entries.columns]
    rows = entries.select(F.explode(forms).alias("form"), F.col(order_col).alias("ord"), *keep)
    first = Window.partitionBy("form", "kanji_form", "reading").orderBy("ord", "id")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


#: What the form index is built from.
HEADWORD_COLUMNS = ("kanji_form", "kanji_forms", "reading", "readings", "meanings", "is_common", "wf_score")


def headwords(entries: DataFrame) -> DataFrame:
    """The seven columns that a scan of headwords reads, with the id."""
    return entries.select("id", *HEADWORD_COLUMNS)


def candidates(index: DataFrame) -> DataFrame:
    """(form, candidates): the candidates in their order; a form has a handful of them."""
    rest = [c for c in index.columns if c not in ("form", "ord")]
    return index.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("candidates"))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl) of the texts' tokens; ``terms`` (term) narrows them before anything is shuffled."""
    words = docs.select(F.col(id_col).alias("id"), T.tokens(text_col).alias("ts"))
    rows = words.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_docs, avg_dl): one row."""
    return docs.select(F.size(T.tokens(text_col)).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
