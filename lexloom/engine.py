"""The engine over a folder of tables: build, refresh, search, browse and segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import japanese as J
from .functions import text as T
from .functions.providers import Encoder, encoded
from .operators import browse, entries, incremental, keys, maintained, retrieval, segmentation
from .sources import markup, tables

#: The share of stored postings' entries that may have gone before an index is compacted.
WORN = 0.3


@dataclass
class Engine:
    """Tables under one path: entries, match_keys, form_index, the text index in segments, corpus, kanji, and vectors if an encoder was given."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return tables.exists(self.spark, f"{self.path}/{name}")

    # building

    def build(self, dictionary: str, characters: str | None = None, strokes: str | None = None, frequencies: DataFrame | None = None, encoder: Encoder | None = None, common_only: bool = False) -> None:
        """All tables from the sources; each replaces its predecessor as a whole."""
        rows = entries.payload(entries.build_entries(markup.dictionary(self.spark, dictionary), frequencies))
        self._derive(entries.common_subset(rows) if common_only else rows, renew=True)
        if characters:
            kanji = markup.characters(self.spark, characters)
            # missing drawings leave the column empty; a missing character table is an error
            found = markup.stroke_files(self.spark, strokes, kanji) if strokes and tables.exists(self.spark, strokes) else None
            kanji = browse.with_strokes(kanji, found)
            tables.replace_table(kanji.join(browse.character_words(self.table("entries")), "literal", "left"), f"{self.path}/kanji")
        if encoder:
            tables.replace_table(encoded(self.table("entries"), encoder, "id", "text"), f"{self.path}/vectors")
        built = {n: self.table(n) for n in ("entries", "match_keys", "form_index", "kanji", "vectors") if self.has(n)}
        dated = markup.generation_dates(self.spark, dictionary).agg(F.max("date")).first()[0]
        tables.write_metadata(self.spark, f"{self.path}/metadata", built, dictionary=dictionary, dictionary_date=dated or "")

    def _derive(self, rows: DataFrame, renew: bool = False) -> None:
        tables.replace_table(rows, f"{self.path}/entries")
        known = self.table("entries")
        tables.replace_table(keys.match_keys(known).repartitionByRange("key").sortWithinPartitions("key"), f"{self.path}/match_keys")
        words, index = known.select("id", F.col("sparse_text").alias("text"), "sig"), f"{self.path}/index"
        # a new version of the entries writes the postings of what differs; much that doesn't count is cleared away
        if renew or not self.has("index"):
            maintained.build(words, index)
        else:
            maintained.refresh(words, index)
            if maintained.overhead(self.spark, index) > WORN:
                maintained.compact(self.spark, index)
        maintained.sweep(self.spark, index)
        now = maintained.read(self.spark, index)
        tables.replace_table(self.spark.createDataFrame([(now.n_docs, now.avg_dl)], "n_docs long, avg_dl double"), f"{self.path}/corpus")
        tables.replace_table(keys.form_index(known).repartitionByRange("form").sortWithinPartitions("form", "ord"), f"{self.path}/form_index")

    def refresh(self, dictionary: str, frequencies: DataFrame | None = None, encoder: Encoder | None = None, full: bool = True) -> DataFrame:
        """Bring the tables up to a new dictionary: the changes (id, change), of which only new texts are encoded anew."""
        new = tables.staged(entries.payload(entries.build_entries(markup.dictionary(self.spark, dictionary), frequencies)), "refresh")
        old = tables.staged(self.table("entries"), "before")
        changes = tables.staged(incremental.diff(new, old, full), "changes")
        if encoder and self.has("vectors"):
            decided = incremental.reuse_decisions(old, new)
            kept = incremental.transplant(decided, self.table("vectors")).select("id", "v")
            fresh = new.join(decided.where("decision <> 'reuse'"), "id", "left_semi")
            tables.replace_table(kept.unionByName(encoded(fresh, encoder, "id", "text")), f"{self.path}/vectors")
        self._derive(incremental.apply_diff(old, new, changes))
        return changes

    # searching

    def store(self) -> retrieval.Store:
        return retrieval.Store(self.table("entries").withColumn("text", F.col("sparse_text")), self.table("match_keys"), self.table("vectors") if self.has("vectors") else None, index=maintained.read(self.spark, f"{self.path}/index"))

    def search(self, queries: DataFrame, n: int = 10, mode: str = "auto", rewrite_mode: str = "heuristic") -> DataFrame:
        """Results (qid, rank, score, entry fields, variants, ruby, inflection) of queries (qid, query[, qv][, japanese]).

        Counters in digits are looked up in numerals where that is a headword.
        """
        spelt = queries.withColumn("__alias", T.col(J.counter_spelling("query")))
        aliases = keys.is_headword(spelt.where("__alias is not null"), self.table("match_keys"), "__alias").select(F.col("qid").alias("__qid"), F.col("__alias").alias("__known"))
        asked = queries.join(aliases, queries["qid"] == F.col("__qid"), "left").withColumn("query", F.coalesce("__known", "query")).drop("__qid", "__known")
        found = retrieval.search(asked, self.store(), n, mode, rewrite_mode)
        rows = self.table("entries").withColumn("variants", entries.variants())
        head = F.coalesce("kanji_form", "reading")
        return found.join(rows, "id").select(
            "qid", "rank", F.round("score", 4).alias("score"), "q", "method", "id", "kanji_form", "reading", "kanji_forms", "readings", "meanings", "is_common", "text", "example_sentences", "senses", "lsource", "inflected_forms", "variants",
            J.furigana(head, "reading").alias("ruby"), retrieval.inflection_label(F.col("inflected_forms"), F.col("q")).alias("inflection"),
        )

    def segments(self, sentences: DataFrame, id_col: str = "id") -> DataFrame:
        """Chips of sentences (id, sentence[, tokens])."""
        return segmentation.segment_sentences(sentences, self.table("form_index"), id_col)

    def with_segments(self, queries: DataFrame, n: int = 10) -> DataFrame:
        """Search results, and for Japanese queries that find nothing their segments in the place of results."""
        found = self.search(queries, n)
        chips = self.segments(queries.where(T.is_japanese("query")).select(F.col("qid").alias("id"), F.col("query").alias("sentence")))
        return retrieval.promoted(queries, found, chips.select(F.col("id").alias("qid"), "pos", F.col("text").alias("surface")), n)

    def conjugation(self, words: DataFrame) -> DataFrame:
        """(word, inflected_forms) of written words: the first entry with that form, else the first with a table."""
        rows = self.table("form_index").select("form", "ord", "id", "kanji_form").join(words, F.col("form") == F.col("word"))
        known = rows.join(self.table("entries").select("id", "inflected_forms"), "id").where("size(inflected_forms) > 0")
        best = known.groupBy("word").agg(F.min_by("inflected_forms", F.struct((F.coalesce("kanji_form", F.lit("")) != F.col("word")).cast("int"), "ord")).alias("inflected_forms"))
        return best

    # browsing

    def cards(self, characters: DataFrame, words: int = 8) -> DataFrame:
        """(literal, badges, readings, words...) of characters (literal); unknown ones have nulls.  The own word comes first."""
        kanji = self.table("kanji").withColumns({"words": browse.own_word_first(F.col("literal"), F.col("common_words"), words), "badges": J.badges(F.col("stroke_count"), F.col("grade"), F.col("jlpt_level"), F.col("freq")), "on": F.transform("on_yomi", J.reading_chip), "kun": F.transform("kun_yomi", J.reading_chip)})
        return characters.dropDuplicates(["literal"]).join(kanji.drop("common_words"), "literal", "left")

    def group(self, by: str, value: int | str, n: int = 40, offset: int = 0) -> DataFrame | None:
        return browse.character_group(self.table("kanji"), by, value, n, offset)

    def groups(self) -> DataFrame:
        return browse.character_facets(self.table("kanji")).orderBy("by", "ord")

    def verified_character(self, seed: int) -> DataFrame:
        """A random character that has common words, if eight tries find one."""
        return browse.verified_pick(self.table("kanji"), self.table("kanji").where("size(common_words) > 0"), seed)

    def random_character(self, seed: int, level: str | None = None) -> DataFrame:
        """A character with a frequency rank, of a level if that has any."""
        kanji = self.table("kanji")
        within = browse.level_characters(kanji, level).where("freq > 0") if level else kanji
        return browse.random_character(within if within.limit(1).count() else kanji, seed)

    def loanword_facets(self) -> DataFrame:
        return browse.loanword_counts(self.table("entries").where("has_lsource"))

    def loanword_page(self, lang: str, offset: int = 0, limit: int = 50) -> DataFrame:
        return browse.loanword_page_of(self.table("entries").where("has_lsource"), lang, offset, limit)

    def related(self, ids: Column | None = None, n: int = 8) -> DataFrame:
        """Words that share characters with entries, all of them or those of a condition."""
        rows = self.table("entries") if ids is None else self.table("entries").where(ids)
        heads = rows.select("id", F.filter(entries.entry_forms(), lambda f: f.isNotNull()).alias("forms"))
        words = self.table("kanji").select("literal", F.explode("common_words").alias("w")).select("literal", "w.rank", "w.kanji_form", "w.reading")
        return browse.related(heads, words, n)

    def ready(self) -> int:
        """The number of entries; 0 if there are none yet."""
        return self.table("entries").count() if self.has("entries") else 0
