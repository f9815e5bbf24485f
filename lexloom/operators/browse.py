"""Facets, pages, related words, loanword buckets and character groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import japanese as J

#: The cumulative frequency bands.
BANDS = (100, 250, 500, 1000, 1500, 2000, 2500)
#: What characters can be grouped by, with the largest value.
GROUPS = {"strokes": ("stroke_count", 50), "grade": ("grade", 50), "jlpt": ("jlpt_level", 50), "freq": ("freq", 3000)}


def facet_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, count) without nulls and zeros."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("count"))


def cumulative_bands(df: DataFrame, rank: str, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """(value, count): rows of rank at most each bound, in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(((F.col(rank) <= n) & (F.col(rank) != 0)).cast("long")), F.lit(0)).alias(f"b{n}") for n in bands])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("value"), F.col(f"b{n}").alias("count")) for n in bands])).alias("x")).select("x.value", "x.count")


def character_facets(kanji: DataFrame) -> DataFrame:
    """(by, value, count, ord): strokes and grades ascending, levels descending, frequency bands."""
    parts = [facet_counts(kanji, c).select(F.lit(by).alias("by"), F.col("value").cast("int").alias("value"), "count", (-F.col("value") if by == "jlpt" else F.col("value")).cast("int").alias("ord")) for by, (c, _) in GROUPS.items() if by != "freq"]
    parts.append(cumulative_bands(kanji, "freq").select(F.lit("freq").alias("by"), "value", "count", F.col("value").alias("ord")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page and, on each row, the total; the order must be total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def page_count(total: Column, limit: int) -> Column:
    """Pages of ``limit`` rows, one at least."""
    return F.greatest(F.ceil(total / limit), F.lit(1)).cast("int")


def clamped_page(wanted: Column, pages: Column) -> Column:
    """A page number within 1 and the number of pages; 1 where it is no number."""
    return F.greatest(F.least(F.coalesce(wanted.try_cast("int"), F.lit(1)), pages), F.lit(1))


def character_group(kanji: DataFrame, by: str, value: int | str, n: int = 40, offset: int = 0) -> DataFrame | None:
    """A page of a group, most used first; the frequency group is cumulative.  None for an unknown key or a value out of bounds."""
    try:
        v = int(value)
    except ValueError:
        return None
    if by not in GROUPS or not 1 <= v <= GROUPS[by][1]:
        return None
    column = GROUPS[by][0]
    kept = kanji.where(F.col(column) <= v if by == "freq" else F.col(column) == v)
    return page(kept, [F.coalesce(F.when(F.col("freq") != 0, F.col("freq")), F.lit(10**9)), F.col("literal")], offset, n)


def level_characters(kanji: DataFrame, level: str) -> DataFrame:
    """Characters of a new level; none for an unknown one."""
    old = J.NEW_LEVELS.get(level)
    return kanji.where(F.lit(False) if old is None else F.col("jlpt_level") == old)


def random_character(kanji: DataFrame, seed: int) -> DataFrame:
    """One of the characters that have a frequency rank."""
    return kanji.where("freq is not null and freq <> 0").orderBy(F.rand(seed), "literal").limit(1)


def verified_pick(kanji: DataFrame, verified: DataFrame, seed: int, tries: int = 8, constant: str = "日") -> DataFrame:
    """(literal): of ``tries`` random ranked characters the first that ``verified`` (literal) has, else the first, else a constant."""
    drawn = kanji.where("freq is not null and freq <> 0").select("literal", F.rand(seed).alias("r")).orderBy("r", "literal").limit(tries)
    known = drawn.join(verified.select("literal").distinct().withColumn("ok", F.lit(True)), "literal", "left")
    best = known.agg(F.min_by("literal", F.struct(F.col("ok").isNull(), "r", "literal")).alias("literal"))
    return best.select(F.coalesce("literal", F.lit(constant)).alias("literal"))


def own_word_first(literal: Column, words: Column, n: int = 8) -> Column:
    """A character's words, the one that is the character itself before the others, ``n`` of them."""
    keyed = F.transform(words, lambda w: F.struct((w["kanji_form"] != literal).cast("int").alias("other"), w["rank"].alias("rank"), w["kanji_form"].alias("kanji_form"), w["reading"].alias("reading"), w["meanings"].alias("meanings")))
    return F.slice(F.array_sort(keyed), 1, n)


def with_strokes(kanji: DataFrame, drawings: DataFrame | None) -> DataFrame:
    """Characters with their drawings; without any drawings the column is null."""
    if drawings is None:
        return kanji.withColumn("strokes", F.lit(None).cast("struct<view_box:string,strokes:array<string>,numbers:array<struct<x:double,y:double,value:int>>>"))
    return kanji.join(drawings, "codepoint_hex", "left")


def inverted_top(entries: DataFrame, terms: Column, order: list[Column], k: int = 10, id_col: str = "id") -> DataFrame:
    """(term, rank, id): the k best entries of each term.

    A term that an entry repeats counts once, so no entry takes two of the k places.
    """
    rows = entries.select(id_col, *[c.alias(f"__o{i}") for i, c in enumerate(order)], F.explode(F.array_distinct(terms)).alias("term"))
    w = Window.partitionBy("term").orderBy(*[F.col(f"__o{i}").desc() for i in range(len(order))], id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("term", "rank", id_col)


def character_words(entries: DataFrame, k: int = 10) -> DataFrame:
    """(literal, common_words): each character's k most common words, names left out."""
    from .entries import without_names

    rows = without_names(entries)
    best = inverted_top(rows, J.kanji_in("kanji_form"), [F.col("is_common").cast("int"), F.col("commonness"), F.col("wf_score")], k)
    named = best.join(rows.select("id", "kanji_form", "reading", "meanings"), "id")
    return named.groupBy(F.col("term").alias("literal")).agg(F.array_sort(F.collect_list(F.struct("rank", "kanji_form", "reading", "meanings"))).alias("common_words"))


def related(headwords: DataFrame, words: DataFrame, n: int = 8) -> DataFrame:
    """(id, rank, kanji_form, reading): words of the headword's characters in the order of forms and characters, without its own forms.

    ``headwords`` has id and forms; ``words`` (literal, rank, kanji_form, reading) are the characters' common words.
    """
    chars = headwords.select("id", "forms", F.posexplode("forms").alias("f", "form")).select("id", "forms", "f", F.posexplode(J.kanji_in("form")).alias("c", "literal"))
    pool = chars.join(words, "literal").where("kanji_form is not null and kanji_form <> '' and not array_contains(forms, kanji_form)")
    pool = pool.groupBy("id", "kanji_form", "reading").agg(F.min(F.struct("f", "c", "rank")).alias("at"))
    w = Window.partitionBy("id").orderBy("at", "kanji_form", "reading")
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("id", "rank", "kanji_form", "reading")


def related_by_terms(heads: DataFrame, top: DataFrame, n: int = 8) -> DataFrame:
    """(id, rank, other): what the terms of a head list, in the order of terms and then of ranks, each once.

    ``heads`` has id and terms, ``top`` (term, rank, other) a bounded list for each term, so no term's pairs multiply.
    """
    pool = heads.select("id", F.posexplode(F.array_distinct("terms")).alias("t", "term")).join(top, "term")
    first = pool.groupBy("id", "other").agg(F.min(F.struct("t", "rank")).alias("at"))
    w = Window.partitionBy("id").orderBy("at", "other")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("id", "rank", "other")


def _buckets(entries: DataFrame) -> DataFrame:
    """Entries, once for each source language; made-in-Japan words join a bucket of their own."""
    langs = F.transform("lsource", lambda x: F.coalesce(x["lang"], F.lit("")))
    made = F.when(F.exists("lsource", lambda x: F.coalesce(x["wasei"], F.lit(False))), F.array(F.lit("wasei"))).otherwise(F.array().cast("array<string>"))
    return entries.where(F.size("lsource") > 0).withColumn("lang", F.explode(F.array_distinct(F.concat(langs, made))))


def _loan_order() -> list[Column]:
    return [F.coalesce("is_common", F.lit(False)).desc(), F.coalesce("wf_score", F.lit(0.0)).desc(), F.coalesce("kanji_form", "reading", F.lit("")), F.coalesce("reading", F.lit("")), F.col("id")]


def loanwords(entries: DataFrame, most: int | None = None) -> DataFrame:
    """(lang, ord, id, ...): each language's words, best first, the first ``most`` of each if that is given."""
    rows = _buckets(entries).withColumn("ord", F.row_number().over(Window.partitionBy("lang").orderBy(*_loan_order())))
    return rows if most is None else rows.where(F.col("ord") <= most)


def loanword_facets(buckets: DataFrame) -> DataFrame:
    """(lang, count), most first, without the made-in-Japan bucket; ties by language.  ``buckets`` has a row for each word of a language."""
    return buckets.where("lang <> 'wasei'").groupBy("lang").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "lang")


def loanword_counts(entries: DataFrame) -> DataFrame:
    """The facets straight from the entries: counted without an order."""
    return loanword_facets(_buckets(entries))


def loanword_page(buckets: DataFrame, lang: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one language's words with their total; an unknown language has none."""
    return page(buckets.where(F.col("lang") == lang), [F.col("ord")], offset, limit)


def loanword_page_of(entries: DataFrame, lang: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """The same straight from the entries: only the one language's first offset + limit words are ordered."""
    rows = page(_buckets(entries).where(F.col("lang") == lang), _loan_order(), offset, limit)
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*_loan_order())) + offset)  # over one page


def ambiguous_options(cands: Column, most: int = 8) -> Column:
    """array<string>: candidates, common first, then frequent, as "reading — two meanings"; beyond ``most`` a count."""
    keyed = F.array_sort(F.transform(cands, lambda c, i: F.struct((~F.coalesce(c["is_common"], F.lit(False))).cast("int").alias("a"), (-F.coalesce(c["wf_score"], F.lit(0.0))).alias("b"), i.alias("i"), F.concat(F.coalesce(F.when(c["reading"] != "", c["reading"]), F.lit("—")), F.lit(" — "), F.array_join(F.slice(c["meanings"], 1, 2), "; ")).alias("line"))))
    lines = F.transform(F.slice(keyed, 1, most), lambda c: c["line"])
    more = F.array(F.concat(F.lit("… +"), (F.size(cands) - most).cast("string"), F.lit(" more")))
    return F.when(F.size(cands) > most, F.concat(lines, more)).otherwise(lines)


def enriched_sources(lsource: Column, names: Column, tags: Column) -> Column:
    """Etymology items with label and language tag; unknown codes name themselves, and three letters are a tag.  Idempotent."""

    def one(x: Column) -> Column:
        lang = F.coalesce(x["lang"], F.lit(""))
        name = F.coalesce(F.try_element_at(names, lang), lang)
        label = F.when(F.coalesce(x["wasei"], F.lit(False)), F.lit("Wasei-eigo (Japanese-made English)")).when(F.coalesce(x["type"] == "part", F.lit(False)), F.concat(F.lit("Partly from "), name)).otherwise(F.concat(F.lit("From "), name))
        tag = F.coalesce(F.try_element_at(tags, lang), F.when(lang.rlike(r"^\p{L}{3}$"), lang))
        return F.struct(lang.alias("lang"), F.coalesce(x["text"], F.lit("")).alias("text"), x["type"].alias("type"), x["wasei"].alias("wasei"), label.alias("label"), tag.alias("tag"))

    return F.transform(F.coalesce(lsource, F.array().cast("array<struct<lang:string,text:string,type:string,wasei:boolean>>")), one)


def key_parity(messages: DataFrame, base: str) -> DataFrame:
    """(locale, key, problem): keys that a locale lacks against the base, or has beyond it."""
    locales = messages.select("locale").distinct().where(F.col("locale") != base)
    keys = messages.where(F.col("locale") == base).select("key")
    # a handful of locales against the base's keys
    missing = keys.crossJoin(F.broadcast(locales)).join(messages.select("locale", "key"), ["locale", "key"], "left_anti").select("locale", "key", F.lit("missing").alias("problem"))
    extra = messages.where(F.col("locale") != base).select("locale", "key").join(keys, "key", "left_anti").select("locale", "key", F.lit("extra").alias("problem"))
    return missing.unionByName(extra)


def placeholder_parity(messages: DataFrame, base: str) -> DataFrame:
    """(locale, key): messages whose placeholders differ from the base's."""
    marks = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\{\w+\})"), F.lit(1))))
    rows = messages.select("locale", "key", marks.alias("marks"))
    return rows.where(F.col("locale") != base).join(rows.where(F.col("locale") == base).select("key", F.col("marks").alias("own")), "key").where("marks <> own").select("locale", "key")
