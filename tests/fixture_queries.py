"""Operators over small fixtures in Japanese and in the sources' own formats, which the test tables don't have.

The expected rows are written out by hand from the rules; the fixtures stand in the shared folder while a query reads them.
"""

from __future__ import annotations
import hashlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexloom.functions import japanese as J
from lexloom.functions import providers
from lexloom.functions import text as T
from lexloom.operators import browse, entries, evaluate, explanations, keys, retrieval
from lexloom.sources import markup, tables
from lexloom.plans.registry import Registry

query = Registry()


class _Model:
    """A stand-in for a hosted model that answers what it has learnt."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def reply(self, system: str, user: str) -> str | None:
        return self.known.get(user)


class _Bounded:
    """A stand-in that needs so many tokens for each prompt; prompts that it doesn't know fail."""

    def __init__(self, needs: dict[str, int]):
        self.needs = needs

    def answer(self, system: str, user: str, tokens: int) -> tuple[str, bool] | None:
        need = self.needs.get(user)
        return None if need is None else (f"{user} in {min(need, tokens)}", need > tokens)

def expected(columns: str, *rows: tuple) -> str:
    """SQL of literal rows."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)

    names = [c.strip() for c in columns.split(",")]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(chr(34) + n + chr(34) for n in names)})"


def joined(c, by: str = "|"):
    return F.array_join(c, by)


DICTIONARY = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a small dictionary / Created: 2024-03-05 -->
<!DOCTYPE Dictionary [
<!ENTITY v5k "Godan verb with 'ku' ending">
<!ENTITY adj-i "adjective (keiyoushi)">
<!ENTITY n "noun (common) (futsuumeishi)">
<!ENTITY surname "family or surname">
<!ENTITY uk "word usually written using kana alone">
<!ENTITY rK "rarely used kanji form">
<!ENTITY ksb "Kansai-ben">
<!ENTITY math "mathematics">
<!ENTITY comp "computing">
<!ENTITY zzz "a code that no tag has">
]>
<Dictionary>
<entry><ent_seq>10</ent_seq><k_ele><keb>書く</keb><ke_pri>ichi1</ke_pri><ke_pri>nf05</ke_pri></k_ele><k_ele><keb>画く</keb><ke_inf>&rK;</ke_inf></k_ele>
<r_ele><reb>かく</reb><re_pri>nf12</re_pri></r_ele><r_ele><reb>カク</reb><re_nokanji/></r_ele>
<sense><pos>&v5k;</pos><dial>&ksb;</dial><field>&math;</field><field>&comp;</field><s_inf>of letters</s_inf><xref type="ant" seq="11">犬 [1]</xref><xref type="ant" seq="11">犬</xref><xref xk="描く" xr="えがく" sno="2">x</xref>
<gloss>to write (a letter)</gloss><gloss xml:lang="fre">écrire</gloss><gloss>to compose</gloss>
<example><ex_sent xml:lang="jpn">字を書く。</ex_sent><ex_sent xml:lang="eng">I write.</ex_sent></example><example><ex_sent xml:lang="jpn">x</ex_sent></example></sense>
<sense><pos>&v5k;</pos><pos>&zzz;</pos><stagr>かく</stagr><gloss>to draw</gloss></sense></entry>
<entry><ent_seq>11</ent_seq><r_ele><reb>パン</reb><re_pri>news2</re_pri></r_ele><sense><pos>&n;</pos><misc>&uk;</misc><gloss>bread roll</gloss></sense><lsource xml:lang="por" ls_type="part">pão</lsource><lsource ls_wasei="y">x</lsource><info>note</info></entry>
<entry><ent_seq>12</ent_seq><k_ele><keb>無</keb></k_ele><sense><gloss>no reading, so dropped</gloss></sense></entry>
<entry><ent_seq>13</ent_seq><r_ele><reb>む</reb></r_ele><sense><gloss xml:lang="ger">nur</gloss></sense></entry>
<entry><ent_seq>14</ent_seq><k_ele><keb>翌日</keb></k_ele><k_ele><keb>明日</keb><ke_pri>spec1</ke_pri></k_ele><r_ele><reb>あした</reb><re_restr>明日</re_restr></r_ele><r_ele><reb>よくじつ</reb><re_restr>翌日</re_restr></r_ele><r_ele><reb>あす</reb></r_ele>
<sense><pos>&n;</pos><pos>&zzz;</pos><stagk>明日</stagk><gloss>tomorrow</gloss><gloss>the near future</gloss></sense></entry>
<entry><ent_seq>15</ent_seq><k_ele><keb>田中</keb></k_ele><r_ele><reb>たなか</reb></r_ele><sense><pos>&n;</pos><misc>&surname;</misc><gloss>Tanaka</gloss></sense></entry>
<entry><ent_seq>16</ent_seq><k_ele><keb>高い</keb><ke_pri>nf48</ke_pri></k_ele><r_ele><reb>たかい</reb></r_ele><sense><pos>&adj-i;</pos><gloss>high</gloss><gloss>(of a price) expensive</gloss></sense></entry>
</Dictionary>
"""


CHARACTERS = """<characters>
<character><literal>書</literal><misc><grade>2</grade><stroke_count>10</stroke_count><freq>169</freq><jlpt>4</jlpt></misc><reading_meaning><rmgroup><reading r_type="ja_on">ショ</reading><reading r_type="ja_kun">か.く</reading><reading r_type="pinyin">shu1</reading><meaning>write</meaning><meaning m_lang="fr">écrire</meaning></rmgroup></reading_meaning></character>
<character><literal>犬</literal><misc><grade>1</grade><stroke_count>4</stroke_count><stroke_count>5</stroke_count><freq>1326</freq><jlpt>3</jlpt></misc><reading_meaning><rmgroup><reading r_type="ja_on">ケン</reading><reading r_type="ja_kun">いぬ</reading><reading r_type="ja_kun">いぬ-</reading><meaning>dog</meaning></rmgroup></reading_meaning></character>
<character><literal>𠮟</literal><misc><stroke_count>5</stroke_count></misc></character>
</characters>
"""


def _file(spark: SparkSession, name: str, text: str) -> str:
    return tables.write_file(spark, f"{tables.scratch(spark, 'fixture')}/{name}", text)


def _dictionary(spark: SparkSession) -> str:
    return _file(spark, "dictionary.xml", DICTIONARY)


FREQUENCIES = [("書く", 5.0, 1), ("パン", 4.5, 2), ("高い", 5.25, 1)]


def _entries(spark: SparkSession) -> DataFrame:
    known = spark.createDataFrame(FREQUENCIES, "form string, zipf double, n_tokens int")
    return tables.staged(entries.payload(entries.build_entries(markup.dictionary(spark, _dictionary(spark)), known)), "entries")


@query(expected("id, kanji, readings", ("10", "書く|画く", "かく|カク"), ("11", "", "パン"), ("12", "無", ""), ("13", "", "む"), ("14", "翌日|明日", "あした|よくじつ|あす"), ("15", "田中", "たなか"), ("16", "高い", "たかい")))
def xml_elements(spark: SparkSession, d: str) -> DataFrame:
    raw = markup.parsed(markup.elements(spark, _dictionary(spark), "entry"), "entry", markup.ENTRY_SCHEMA)
    return raw.select(F.col("ent_seq").alias("id"), F.coalesce(joined("k_ele.keb"), F.lit("")).alias("kanji"), F.coalesce(joined("r_ele.reb"), F.lit("")).alias("readings"))


@query(expected("code, text", ("v5k", "Godan verb with 'ku' ending"), ("adj-i", "adjective (keiyoushi)"), ("n", "noun (common) (futsuumeishi)"), ("surname", "family or surname"), ("uk", "word usually written using kana alone"), ("rK", "rarely used kanji form"), ("ksb", "Kansai-ben"), ("math", "mathematics"), ("comp", "computing"), ("zzz", "a code that no tag has")))
def entity_lines(spark: SparkSession, d: str) -> DataFrame:
    return markup.entities(spark, _dictionary(spark))


@query("SELECT DATE '2024-03-05' AS date")
def generation_dates(spark: SparkSession, d: str) -> DataFrame:
    return markup.generation_dates(spark, _dictionary(spark))


@query(expected("literal, codepoint_hex, meanings, on_yomi, kun_yomi, stroke_count, grade, freq, jlpt_level", ("書", "066f8", "write", "ショ", "か.く", 10, 2, 169, 4), ("犬", "072ac", "dog", "ケン", "いぬ|いぬ-", 4, 1, 1326, 3), ("𠮟", "20b9f", "", "", "", 5, None, None, None)))
def character_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = markup.characters(spark, _file(spark, "characters.xml", CHARACTERS))
    return rows.select("literal", "codepoint_hex", *[F.coalesce(joined(c), F.lit("")).alias(c) for c in ("meanings", "on_yomi", "kun_yomi")], "stroke_count", "grade", "freq", "jlpt_level")


_SVG = {
    "072ac.svg": '<svg width="1" viewBox="0 0 10 10"><path id="x:072ac-s10" d="M2"/><path id="x:072ac-s2" type="y" d="M1"/><text transform="matrix(1 0 0 1 4.5 6)">1</text><text transform="matrix(1 0 0 1 7 8.25)">2</text></svg>',
    "066f8.svg": '<svg><path id="x:066f8-s1" d="M3 4"/></svg>', "0ffff.svg": "<svg></svg>", "notes.txt": "<svg></svg>",
}


def _drawings(spark: SparkSession) -> str:
    folder = tables.scratch(spark, "drawings")
    for name, text in _SVG.items():
        tables.write_file(spark, f"{folder}/{name}", text)
    return folder


@query(expected("literal, view_box, strokes, numbers", ("書", "0 0 109 109", "M3 4", ""), ("犬", "0 0 10 10", "M1|M2", "1@4.5,6.0|2@7.0,8.25"), ("𠮟", None, None, None)))
def stroke_drawings(spark: SparkSession, d: str) -> DataFrame:
    """Characters with their drawings: of the folder only wanted ones, and a missing one leaves nulls."""
    kanji = markup.characters(spark, _file(spark, "characters.xml", CHARACTERS))
    rows = browse.with_strokes(kanji, markup.stroke_files(spark, _drawings(spark), kanji))
    number = F.transform("strokes.numbers", lambda n: F.concat(n["value"].cast("string"), F.lit("@"), n["x"].cast("string"), F.lit(","), n["y"].cast("string")))
    return rows.select("literal", F.col("strokes.view_box").alias("view_box"), joined("strokes.strokes").alias("strokes"), joined(number).alias("numbers"))


@query(expected("codepoint_hex, n", ("066f8", 1), ("072ac", 2), ("0ffff", 0)))
def stroke_folder(spark: SparkSession, d: str) -> DataFrame:
    """Every drawing of the folder; files with other names aren't any."""
    return markup.stroke_files(spark, _drawings(spark)).select("codepoint_hex", F.size("strokes.strokes").alias("n"))


@query(expected("literal, hex", ("日", "065e5"), ("𠀀", "20000"), ("a", "00061")))
def wanted_codepoints(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("日",), ("𠀀",), ("a",)], "literal string").select("literal", J.codepoint_hex("literal").alias("hex"))


_GOLD = ["# en_words: plain words", "#ja_words - written words", "# no note here", "", "category\tquery\texpected_answers\tnotes", "en_words\tdog\t犬 (noun) / イヌ\tx", "en_words\tto run\t走る", "ja_words\t犬\t犬 / 狗 /", "en_words\tdog\t狗", "short\tline"]


def _gold(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _GOLD], "value string")


@query(expected("category, query, expected", ("en_words", "dog", "イヌ|犬|狗"), ("en_words", "to run", "走る"), ("ja_words", "犬", "犬|狗")))
def gold_lines(spark: SparkSession, d: str) -> DataFrame:
    return markup.gold_queries(_gold(spark)).select("category", "query", joined("expected").alias("expected"))


@query(expected("category, note", ("en_words", "plain words"), ("ja_words", "written words")))
def category_notes(spark: SparkSession, d: str) -> DataFrame:
    return markup.category_notes(_gold(spark))


@query(expected("locale, key, text", ("en", "a", "x {n}"), ("en", "b", "tab\there"), ("fr", "a", "é {n}"), ("pt-BR", "a", "y")))
def message_files(spark: SparkSession, d: str) -> DataFrame:
    folder = tables.scratch(spark, "messages")
    for name, text in {"en.json": '{"a": "x {n}",\n "b": "tab\\there"}', "fr.json": '{"a": "é {n}"}', "pt-BR.json": '{"a": "y"}', "readme.md": "no"}.items():
        tables.write_file(spark, f"{folder}/{name}", text)
    return markup.messages(spark, folder)


@query(expected("table, row, column, kana, romaji", ("base", 0, 0, "あ", "a"), ("base", 0, 1, "い", "i"), ("base", 1, 0, "か", "ka"), ("small", 0, 0, "ゃ", "ya")))
def kana_cells(spark: SparkSession, d: str) -> DataFrame:
    chart = '{"base": [[{"kana": "あ", "romaji": "a"}, {"kana": "い", "romaji": "i"}], [{"kana": "か", "romaji": "ka"}, null]], "small": [[{"kana": "ゃ", "romaji": "ya"}]]}'
    return markup.kana_chart(spark, _file(spark, "kana.json", chart))


@query(expected(
    "id, kanji_form, reading, kanji_forms, readings, meanings, text, sparse_text, notes, has_lsource",
    (10, "書く", "かく", "書く|画く", "かく|カク", "to write (a letter)|to compose|to draw", "書く [かく]: to write (a letter), to compose, to draw", "書く 画く かく カク: to write (a letter), to compose, to draw", "", False),
    (11, None, "パン", "", "", "bread roll", "パン [パン]: bread roll", "パン: bread roll", "note", True),
    (14, "明日", "あした", "翌日|明日", "あした|よくじつ|あす", "tomorrow|the near future", "明日 [あした]: tomorrow, the near future", "翌日 明日 あした よくじつ あす: tomorrow, the near future", "", False),
    (15, "田中", "たなか", "", "", "Tanaka", "田中 [たなか]: Tanaka", "田中 たなか: Tanaka", "", False),
    (16, "高い", "たかい", "", "", "high|(of a price) expensive", "高い [たかい]: high, (of a price) expensive", "高い たかい: high, (of a price) expensive", "", False),
))
def entry_projection(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark).select("id", "kanji_form", "reading", *[joined(c).alias(c) for c in ("kanji_forms", "readings", "meanings")], "text", "sparse_text", joined("notes").alias("notes"), "has_lsource")


@query(expected("id, is_common, commonness, freq_band, wf_score", (10, True, 1.0, 5, 5.0), (11, False, 0.5, None, 3.5), (14, True, 1.0, None, 0.0), (15, False, 0.0, None, 0.0), (16, False, 0.0156, 48, 5.25)))
def entry_priors(spark: SparkSession, d: str) -> DataFrame:
    """The kana-written パン is counted by its reading, one decade down for its second token."""
    return _entries(spark).select("id", "is_common", "commonness", "freq_band", "wf_score")


@query(expected(
    "id, gloss_keys, primary_gloss_keys, head_gloss_keys",
    (10, "compose|draw|to compose|to draw|to write|write", "compose|to compose|to write|write", "to write|write"), (11, "bread|bread roll", "bread|bread roll", "bread roll"), (14, "the|the near future|tomorrow", "the|the near future|tomorrow", "tomorrow"),
    (15, "tanaka", "tanaka", "tanaka"), (16, "high", "high", "high"),
))
def entry_keys(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark).select("id", *[joined(c).alias(c) for c in ("gloss_keys", "primary_gloss_keys", "head_gloss_keys")])


@query(expected(
    "id, n, glosses, pos, misc, field, dial, s_inf, stagk, stagr, examples",
    (10, 0, "to write (a letter)|to compose", "verb", "", "computing|mathematics", "ksb=Kansai-ben", "of letters", "", "", "字を書く。=I write."), (10, 1, "to draw", "verb", "", "", "", "", "", "かく", ""),
    (11, 0, "bread roll", "noun", "kana", "", "", "", "", "", ""), (14, 0, "tomorrow|the near future", "noun", "", "", "", "", "明日", "", ""), (15, 0, "Tanaka", "noun", "name", "", "", "", "", "", ""), (16, 0, "high|(of a price) expensive", "adj-i", "", "", "", "", "", "", ""),
))
def entry_senses(spark: SparkSession, d: str) -> DataFrame:
    s = _entries(spark).select("id", F.posexplode("senses").alias("n", "s"))
    pairs = lambda c, a, b: joined(F.transform(c, lambda x: F.concat(x[a], F.lit("="), x[b])))
    return s.select("id", "n", *[joined(f"s.{c}").alias(c) for c in ("glosses", "pos", "misc", "field")], pairs("s.dial", "code", "name").alias("dial"), *[joined(f"s.{c}").alias(c) for c in ("s_inf", "stagk", "stagr")], pairs("s.examples", "japanese", "english").alias("examples"))


@query(expected("id, text, type, seq, sno", (10, "犬", "ant", "11", None), (10, "描く", "see", "", "2")))
def entry_references(spark: SparkSession, d: str) -> DataFrame:
    """A repeated reference stays once, without its sense number; a written form comes before a reading and before the text."""
    return _entries(spark).select("id", F.explode("senses").alias("s")).select("id", F.explode("s.xrefs").alias("x")).select("id", "x.text", "x.type", "x.seq", "x.sno")


@query(expected("id, kind, key, forms", (10, "reading", "カク", ""), (10, "label", "画く", "rK"), (14, "reading", "あした", "明日"), (14, "reading", "よくじつ", "翌日")))
def entry_restrictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark)
    part = lambda c, kind: rows.select("id", F.lit(kind).alias("kind"), F.explode(c).alias("key", "v")).select("id", "kind", "key", joined("v").alias("forms"))
    return part("reading_restrictions", "reading").unionByName(part("ke_inf", "label"))


@query(expected("id, form, readings, labels, free, kana_only", (10, "書く", "", "", "かく", "カク"), (10, "画く", "", "rK", "かく", "カク"), (14, "翌日", "よくじつ", "", "あす", ""), (14, "明日", "あした", "", "あす", "")))
def entry_variants(spark: SparkSession, d: str) -> DataFrame:
    v = _entries(spark).select("id", entries.variants().alias("v")).where("v is not null").select("id", F.explode("v.forms").alias("f"), F.col("v.readings").alias("free"), "v.kana_only")
    return v.select("id", "f.form", joined("f.readings").alias("readings"), joined("f.labels").alias("labels"), joined("free").alias("free"), joined("kana_only").alias("kana_only"))


@query(expected("id, lang, text, type, wasei", (11, "por", "pão", "part", None), (11, "eng", "x", None, True)))
def entry_sources(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark).select("id", F.explode("lsource").alias("x")).select("id", "x.lang", "x.text", "x.type", "x.wasei")


@query(expected("id, n, forms", (10, 15, True), (16, 8, True), (11, 0, False), (14, 0, False), (15, 0, False)))
def entry_inflections(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark).select("id", F.size("inflected_forms").alias("n"), (F.array_contains("infl_forms", "書いた") | F.array_contains("infl_forms", "高くない")).alias("forms"))


@query(expected("code, tag", ("vi", "verb"), ("v5k-s", "verb"), ("vs-c", "verb"), ("adj-ix", "adj-i"), ("adj-kari", "adj-i"), ("adj-no", "adj-na"), ("adv-to", "adv"), ("int", "intj"), ("exp", "phrase"), ("n-t", "noun"), ("cop", "other"), ("aux-v", "other"), ("zzz", None)))
def pos_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in ("vi", "v5k-s", "vs-c", "adj-ix", "adj-kari", "adj-no", "adv-to", "int", "exp", "n-t", "cop", "aux-v", "zzz")], "code string")
    return rows.select("code", F.try_element_at(entries.coded_tags(F.array("code"), entries.POS_TAGS), F.lit(1)).alias("tag"))


@query(expected("codes, tags", ("uk|on-mim|uk", "on-mim|kana"), ("vulg|yoji|hon", "idiom|formal|colloquial"), ("surname|arch|none", "archaic|name"), ("sens|X|abbr", "abbr|sensitive|other"), ("none", "")))
def misc_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags once each and in badge order; unknown codes are dropped."""
    rows = spark.createDataFrame([(x,) for x in ("uk|on-mim|uk", "vulg|yoji|hon", "surname|arch|none", "sens|X|abbr", "none")], "codes string")
    return rows.select("codes", joined(entries.coded_tags(F.split("codes", r"\|"), entries.MISC_TAGS)).alias("tags"))


@query(expected("code, count", ("zzz", 2)))
def unmapped_codes(spark: SparkSession, d: str) -> DataFrame:
    raw = markup.dictionary(spark, _dictionary(spark))
    return entries.unmapped_codes(raw, F.flatten(F.transform("sense", lambda s: s["pos"])), entries.POS_TAGS)


@query(expected("entries, common, examples", (5, 2, 1)))
def entry_totals(spark: SparkSession, d: str) -> DataFrame:
    return entries.entry_totals(_entries(spark))


@query(expected("id", (10,), (11,), (14,), (16,)))
def name_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return entries.without_names(_entries(spark)).select("id")


@query(expected("id, forms, score, flag, name, signed", (1, 0, 0.0, False, None, 16), (2, 1, 2.5, True, "x", 16)))
def payload_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, None, None, None, None, None), (2, ["a"], 2.5, True, "x", {"k": ["v"]})], "id long, forms array<string>, score double, flag boolean, name string, m map<string,array<string>>")
    return entries.payload(rows).select("id", F.size("forms").alias("forms"), "score", "flag", "name", F.length("sig").alias("signed"))


@query(expected("a, b, same", (1, 2, True), (1, 3, False), (1, 4, False), (5, 6, True)))
def signature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Equal rows have equal signatures, whatever the order of a map's entries; another value, or null for empty, changes them."""
    rows = spark.sql("""select * from values (1, 'x', map('a', 1, 'b', 2)), (2, 'x', map('b', 2, 'a', 1)), (3, 'x', map('a', 1)), (4, null, map('a', 1, 'b', 2)), (5, null, null), (6, null, null) t(id, name, m)""")
    sig = rows.select("id", entries.signature(["name", "m"], rows).alias("sig"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6)], "a int, b int")
    return pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "x"}), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "y"}), "b").select("a", "b", (F.col("x") == F.col("y")).alias("same"))


@query(expected("term, found", ("かく", True), ("明日", True), ("カク", True), ("パン", True), ("書いた", False), ("bread", False), ("無", False)))
def headword_check(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in ("かく", "明日", "カク", "パン", "書いた", "bread", "無")], "term string")
    found = keys.is_headword(terms, keys.match_keys(_entries(spark))).withColumn("found", F.lit(True))
    return terms.join(found, "term", "left").select("term", F.coalesce("found", F.lit(False)).alias("found"))


@query(expected("id, kanji_form, kanji_forms, reading, readings, meanings, is_common, wf_score", (10, "書く", 2, "かく", 2, 3, True, 5.0), (11, None, 0, "パン", 0, 1, False, 3.5), (14, "明日", 2, "あした", 3, 2, True, 0.0), (15, "田中", 0, "たなか", 0, 1, False, 0.0), (16, "高い", 0, "たかい", 0, 2, False, 5.25)))
def headword_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.headwords(_entries(spark))
    return rows.select("id", "kanji_form", F.size("kanji_forms").alias("kanji_forms"), "reading", F.size("readings").alias("readings"), F.size("meanings").alias("meanings"), "is_common", "wf_score")


@query(expected("form, candidates", ("かく", "10=書く|20=核"), ("書く", "10=書く"), ("画く", "10=書く"), ("カク", "10=書く"), ("核", "20=核")))
def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order of entries; an entry that repeats form, headword and reading is listed once."""
    schema = "id long, kanji_form string, reading string, kanji_forms array<string>, readings array<string>"
    rows = spark.createDataFrame([(10, "書く", "かく", ["書く", "画く"], ["かく", "カク"]), (20, "核", "かく", None, None), (30, "核", "かく", None, None)], schema)
    found = keys.candidates(keys.form_index(rows))
    return found.select("form", joined(F.transform("candidates", lambda c: F.concat(c["id"].cast("string"), F.lit("="), c["kanji_form"]))).alias("candidates"))


@query(expected("line", ("| lang | n |",), ("|---|---|",), ("| de | 1 |",), ("| en |  |",)))
def report_table(spark: SparkSession, d: str) -> DataFrame:
    text = tables.markdown(spark.createDataFrame([("de", 1), ("en", None)], "lang string, n int").orderBy("lang"))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(expected("name, length, whole, sha256", ("a.txt", 9, True, hashlib.sha256(b"<a>\n</a>\n").hexdigest())))
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "a.txt", "<a>\n</a>\n")
    whole = tables.has_end_mark(spark, path, "</a>") and not tables.has_end_mark(spark, path, "</b>")
    return tables.file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.lit(whole).alias("whole"), "sha256")


@query(expected("query, id", ("dog", 1), ("dog", 2), ("dog", 3), ("犬", 1), ("犬", 3)))
def gold_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Entries of which any form is an expected answer, each once."""
    gold = markup.gold_queries(_gold(spark)).where("query <> 'to run'").select(F.col("query").alias("qid"), "expected").where("qid <> 'none'")
    forms = spark.createDataFrame([("犬", 1), ("イヌ", 1), ("イヌ", 2), ("狗", 3), ("猫", 4)], "form string, id long")
    return evaluate.gold_relevance(gold, forms).select(F.col("qid").alias("query"), "id")


@query(expected("japanese, english", ("甲。", "A."), ("乙。", "B."), ("丙。", "C.")))
def evaluation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """First examples of first relevant entries in the order of queries, filled up; a repeated sentence stays once."""
    gold = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    example = "struct<japanese:string,english:string>"
    results = spark.createDataFrame([(1, 2, ("x。", "X.")), (1, 1, ("甲。", "A.")), (2, 1, None), (3, 1, ("甲。", "again")), (4, 3, ("乙。", "B."))], f"qid long, rank int, example {example}")
    rest = spark.createDataFrame([(0, "乙。", "again"), (1, "丙。", "C."), (2, "丁。", "D.")], "ord int, japanese string, english string")
    return evaluate.evaluation_sentences(gold, results, rest, 3)


@query(expected("set, config", ("tie", "usual"), ("fast", "c"), ("hits", "b")))
def best_configuration(spark: SparkSession, d: str) -> DataFrame:
    """The best mean reciprocal rank and hits; of ties the default, else the fastest."""
    schema, out = "config string, mrr double, hit1 double, latency_ms double", None
    for name, rows in {"tie": [("a", 0.9, 0.8, 1.0), ("usual", 0.9, 0.8, 9.0)], "fast": [("b", 0.9, 0.8, 5.0), ("c", 0.9, 0.8, 4.0)], "hits": [("b", 0.9, 0.9, 5.0), ("usual", 0.9, 0.8, 1.0)]}.items():
        part = evaluate.best_config(spark.createDataFrame(rows, schema), "usual").select(F.lit(name).alias("set"), "config")
        out = part if out is None else out.unionByName(part)
    return out


@query(expected("place, subset", (0, "ja_words"), (1, "ja_kana"), (2, "en_words")))
def subset_names(spark: SparkSession, d: str) -> DataFrame:
    names = evaluate.resolve_subsets(["ja", "en_words", "ja_kana"], {"ja": ["ja_words", "ja_kana"]}, ["ja_words", "ja_kana", "en_words"])
    return spark.createDataFrame(list(enumerate(names)), "place int, subset string")


@query(expected("id, level_fit, accuracy, comment", (1, 4.0, 5.0, "ok"), (2, None, None, "no score"), (3, 3.0, None, "part")))
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 'Sure: {"level_fit": 4, "accuracy": 5, "comment": "ok"} done'), (2, "no score"), (3, '{"level_fit": 3, "comment": "part"}')], "id int, reply string")
    return rows.select("id", evaluate.verdict(F.col("reply")).alias("v")).select("id", "v.level_fit", "v.accuracy", "v.comment")


@query(expected("id, english, japanese", (1, "dog", "犬|いぬ"), (2, "small dog", "子犬"), (3, "run fast", ""), (4, "", "走る"), (5, "", "")))
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON, JSON within prose, plain text; five words are no gloss, and headwords lose marks, notes and spaces."""
    replies = [(1, '```json\n{"english": "Dog.", "japanese": ["犬 (noun)", "- いぬ", "a dog"]}\n```'), (2, 'Here: {"gloss": "small dog", "ja": "1. 子犬"}'), (3, "run fast\nmore"), (4, '{"english": "a b c d e", "japanese": ["走る", "走 る"]}'), (5, "one two three four five")]
    rows = spark.createDataFrame(replies, "id int, reply string").select("id", T.parse_reply("reply").alias("r"))
    return rows.select("id", "r.english", joined("r.japanese").alias("japanese"))


@query(expected("id, query, method, japanese", (1, "running quickly", "heuristic", ""), (2, "run fast", "llm", "駆ける"), (3, "dog", "none", ""), (4, "犬", "none", ""), (5, "small", "heuristic", "")))
def rewrite_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A provider's answer counts from three words on, or two after a question frame; never for Japanese."""
    rows = [(1, "what is the word for running quickly", None, None), (2, "how do you say running very quickly", "run fast", ["駆ける"]), (3, "Dog!", "hound", ["犬"]), (4, "犬。", "dog", ["狗"]), (5, "word for small", "tiny", None)]
    q = spark.createDataFrame(rows, "id int, q string, en string, ja array<string>")
    r = q.select("id", T.rewrite("q", "auto", F.col("en"), F.col("ja")).alias("r"))
    return r.select("id", "r.query", "r.method", joined("r.japanese").alias("japanese"))


@query(expected("text, folded", ("カタカナ", "かたかな"), ("ヴァーン", "ゔぁーん"), ("abcアいウ", "abcあいう"), ("漢字", "漢字")))
def kana_folding(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("カタカナ",), ("ヴァーン",), ("abcアいウ",), ("漢字",)], "text string").select("text", J.hiragana("text").alias("folded"))


@query(expected("text, spelt, known", ("25日", "二十五日", False), ("2人", "二人", True), ("100円", "一百円", False), ("0日", None, False), ("12345日", None, False), ("3", None, False), ("7匹目", None, False)))
def counter_aliases(spark: SparkSession, d: str) -> DataFrame:
    """A number with a unit, spelt; an alias only where that is a headword."""
    rows = spark.createDataFrame([(t,) for t in ("25日", "2人", "100円", "0日", "12345日", "3", "7匹目")], "text string").withColumn("spelt", J.counter_spelling("text"))
    known = spark.createDataFrame([("form", "二人"), ("form", "百円"), ("gloss", "七匹")], "kind string, key string").withColumn("id", F.lit(1))
    found = keys.is_headword(rows.where("spelt is not null"), known, "spelt").select("text", F.lit(True).alias("known"))
    return rows.join(found, "text", "left").select("text", "spelt", F.coalesce("known", F.lit(False)).alias("known"))


@query(expected("text, gloss", ("100000", "100,000"), ("007", "7"), ("12", "12"), ("1234567", "1,234,567"), ("1234.5", "1,234.5")))
def number_glosses(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ("100000", "007", "12", "1234567", "1234.5")], "text string").select("text", J.number_gloss("text").alias("gloss"))


@query(expected("surface, reading, ruby", ("食べました", "たべました", "食[た]べました"), ("は", "わ", "は[わ]"), ("いぬ", "いぬ", "いぬ"), ("犬", "いぬ", "犬[いぬ]"), ("お茶", "", "お茶")))
def chip_ruby(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("食べました", "たべました"), ("は", "わ"), ("いぬ", "いぬ"), ("犬", "いぬ"), ("お茶", "")], "surface string, reading string")
    shown = F.transform(J.chip_ruby("surface", "reading"), lambda p: F.when(p["rt"].isNull(), p["text"]).otherwise(F.concat(p["text"], F.lit("["), p["rt"], F.lit("]"))))
    return rows.select("surface", "reading", joined(shown, "").alias("ruby"))


@query(expected("reading, stem, okurigana", ("か.く", "か", "く"), ("いぬ", "いぬ", None), ("あ.か.い", "あ", "か.い")))
def reading_chips(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("か.く",), ("いぬ",), ("あ.か.い",)], "reading string").select("reading", J.reading_chip("reading").alias("c")).select("reading", "c.stem", "c.okurigana")


@query(expected("lang, key, text", ("fr", "a", "3 mots"), ("fr", "b", "only here {x}"), ("en", "a", "3 words"), ("fr", "none", "none"), ("fr", "c", "{n}")))
def translated_messages(spark: SparkSession, d: str) -> DataFrame:
    """The language's message, else the fallback's, else the key; places are filled once, so what they bring isn't filled again."""
    rows = spark.createDataFrame([("fr", "a", {"n": "3"}), ("fr", "b", {"n": "3"}), ("en", "a", {"n": "3"}), ("fr", "none", {}), ("fr", "c", {"m": "{n}", "n": "3"})], "lang string, key string, values map<string,string>")
    as_map = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    en, fr = as_map({"a": "{n} words", "b": "only here {x}", "c": "{m}"}), as_map({"a": "{n} mots"})
    return rows.select("lang", "key", T.translated(F.col("lang"), F.col("key"), F.when(F.col("lang") == "fr", fr).otherwise(en), en, F.col("values")).alias("text"))


@query(expected("kana, label", ("あ", "а"), ("か", "ka"), ("ん", "ん")))
def kana_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("あ", "a"), ("か", "ka"), ("ん", None)], "kana string, romaji string")
    return rows.select("kana", J.kana_label(F.col("kana"), F.col("romaji"), F.create_map(F.lit("あ"), F.lit("а"))).alias("label"))


@query(expected(
    "literal, badges",
    ("書", "10 strokes/strokes=10|Grade 2/grade=2|JLPT N5/jlpt=4|Freq #169/=169"), ("叱", "5 strokes/strokes=5|Grade 8/grade=8|JLPT N1/jlpt=1"), ("亜", "7 strokes/strokes=7|JLPT N2-N3/jlpt=2"), ("x", ""),
))
def character_badges(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("書", 10, 2, 4, 169), ("叱", 5, 8, 1, 0), ("亜", 7, None, 2, None), ("x", None, 0, None, None)], "literal string, strokes int, grade int, jlpt int, freq int")
    b = J.badges(F.col("strokes"), F.col("grade"), F.col("jlpt"), F.col("freq"))
    return rows.select("literal", joined(F.transform(b, lambda x: F.concat(x["label"], F.lit("/"), F.coalesce(x["by"], F.lit("")), F.lit("="), x["value"].cast("string")))).alias("badges"))


@query(expected("level, old, n", ("N5", 4, 1), ("N4", 3, 0), ("N3", 2, 2), ("N2", 2, 2), ("N1", 1, 1), ("N9", None, 0)))
def level_scale(spark: SparkSession, d: str) -> DataFrame:
    kanji, out = spark.createDataFrame([("a", 4), ("b", 2), ("c", 2), ("d", 1)], "literal string, jlpt_level int"), None
    for level in ("N5", "N4", "N3", "N2", "N1", "N9"):
        part = browse.level_characters(kanji, level).agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), J.jlpt_scale(F.lit(level)).alias("old"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(expected("text, starts, holds, apart, kanji", ("犬 dog", True, True, True, True), ("dog 犬", False, True, True, True), ("a犬", False, True, False, True), ("「いぬ」", True, True, True, False), ("dog", False, False, False, False), ("𠮟る", False, True, False, True), ("・abc", False, True, True, False), ("", False, False, False, False)))
def japanese_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in ("犬 dog", "dog 犬", "a犬", "「いぬ」", "dog", "𠮟る", "・abc", "")], "text string")
    return rows.select("text", T.is_japanese("text").alias("starts"), T.contains_japanese("text").alias("holds"), T.has_separate_japanese("text").alias("apart"), J.has_kanji("text").alias("kanji"))


@query(expected("id, sentence, meaning, hint, problem", (1, "犬 だ", "a dog", "x", None), (2, "", "", "", "empty sentence"), (3, "long", "", "", "long sentence"), (4, "犬", "long", "", "long meaning"), (5, "犬", "", "600", None)))
def checked_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, " 犬　 だ ", "a  dog", " x "), (2, " ", None, None), (3, "犬" * 201, "", ""), (4, "犬", "m" * 401, ""), (5, "犬", "", "h" * 700)], "id int, s string, m string, h string")
    c = rows.select("id", T.checked_request("s", "m", "h").alias("c")).select("id", "c.*")
    short = lambda name: F.when(F.length(name) > 200, F.when(F.col(name).startswith("h"), F.length(name).cast("string")).otherwise(F.lit("long"))).otherwise(F.col(name)).alias(name)
    return c.select("id", short("sentence"), short("meaning"), short("hint"), "problem")


@query(expected("id, who", (1, "signed"), (2, "b"), (3, "peer"), (4, "peer"), (5, "c")))
def client_keys(spark: SparkSession, d: str) -> DataFrame:
    """The signed client, else the second address from the right, else the peer."""
    rows = spark.createDataFrame([(1, "a, b", "signed"), (2, "a, b, c", None), (3, "a", None), (4, None, None), (5, "c , , d", None)], "id int, chain string, signed string")
    return rows.select("id", T.client_key(F.col("chain"), F.lit("peer"), 2, F.col("signed")).alias("who"))


@query(expected("id, target, number, url", (1, "/a/b", 3, "%E7%8A%AC"), (2, "/", 7, "a+b"), (3, "/", 7, "x")))
def helper_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "/a/b", "3", "犬"), (2, "//evil", "x", "a b"), (3, "http://x", None, "x")], "id int, target string, number string, url string")
    return rows.select("id", T.safe_redirect("target").alias("target"), T.int_or("number", 7).alias("number"), T.display_url("url").alias("url"))


@query(expected("q, label", ("書いた", "Past"), ("かいた", "Past"), ("書きます", "Polite present"), ("書く", "Dictionary"), ("高くない", "Negative"), ("犬", None)))
def inflection_labels(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(x,) for x in ("書いた", "かいた", "書きます", "書く", "高くない", "犬")], "q string")
    forms = _entries(spark).select("id", "infl_forms", "inflected_forms")
    hit = q.join(forms.select(F.explode(F.array_distinct("infl_forms")).alias("q"), "inflected_forms"), "q", "left")
    return hit.select("q", retrieval.inflection_label(F.col("inflected_forms"), F.col("q")).alias("label"))


_STORE = [
    (1, "犬 いぬ: dog, hound", "犬", "いぬ", ["dog", "hound"], 1.0, 5.0), (2, "子犬 こいぬ: puppy, small dog", "子犬", "こいぬ", ["puppy", "small dog"], 0.0, 3.0), (3, "猫 ねこ: cat", "猫", "ねこ", ["cat"], 1.0, 5.0),
    (4, "二人 ふたり: two people, pair", "二人", "ふたり", ["two people", "pair"], 1.0, 4.0), (5, "走る はしる: to run", "走る", "はしる", ["to run"], 1.0, 5.0), (6, "駆ける かける: to run (race), to dash", "駆ける", "かける", ["to run (race)", "to dash"], 0.0, 3.0),
]


def _store(spark: SparkSession) -> retrieval.Store:
    rows = spark.createDataFrame(_STORE, "id long, text string, kanji_form string, reading string, meanings array<string>, commonness double, wf_score double")
    none = F.array().cast("array<string>")
    first = F.slice("meanings", 1, 1)
    rows = rows.withColumns({"kanji_forms": none, "readings": none, "gloss_keys": entries.key_set(F.col("meanings")), "primary_gloss_keys": entries.key_set(F.col("meanings")), "head_gloss_keys": entries.key_set(first, heads=False)})
    return retrieval.Store(rows.select("id", "text", "commonness", "wf_score"), keys.match_keys(rows))


@query(expected(
    "qid, rank, id, q, method",
    (1, 1, 1, "犬", "none"), (2, 1, 1, "いぬ", "none"), (3, 1, 3, "cat", "heuristic"), (4, 1, 5, "to run", "none"), (4, 2, 6, "to run", "none"), (5, 1, 3, "猫", "llm"), (6, 1, 1, "dog", "none"), (6, 2, 2, "dog", "none"), (7, 1, 1, "dog", "none"), (7, 2, 2, "dog", "none"), (9, 1, 2, "puppy", "none"),
))
def japanese_search(spark: SparkSession, d: str) -> DataFrame:
    """Written forms, readings, questions, verbs, a provider's headwords in order; equal queries are scored once; what is too long has no results."""
    asked = [(1, "犬。", None), (2, "いぬ", None), (3, "What is the Japanese word for cat?", None), (4, "to run", None), (5, "a very small tame animal", ["狼", "猫"]), (6, "Dog", None), (7, " dog ", None), (8, "x" * 200, None), (9, "puppy", None)]
    found = retrieval.search(spark.createDataFrame(asked, "qid long, query string, japanese array<string>"), _store(spark), rewrite_mode="auto")
    return found.select("qid", "rank", "id", "q", "method")


@query(expected("qid, rank, id, surface", (1, 1, 1, None), (2, 1, None, "犬"), (2, 2, None, "と"), (2, 3, None, "猫"), (3, 1, 1, None)))
def segments_promoted(spark: SparkSession, d: str) -> DataFrame:
    """A Japanese sentence that finds nothing by its form shows its segments."""
    from lexloom.operators import segmentation

    s = _store(spark)
    q = spark.createDataFrame([(1, "犬"), (2, "犬と猫"), (3, "dog")], "qid long, q string")
    found = retrieval.ranked(keys.exact_matches(q, s.keys).where("primary = 1").groupBy("qid").agg(F.min("id").alias("id")).withColumn("score", F.lit(1.0)), 5)
    index = spark.createDataFrame([(k, n, k, r, m, True, w) for n, (_, _, k, r, m, _, w) in enumerate(_STORE)], "form string, ord long, kanji_form string, reading string, meanings array<string>, is_common boolean, wf_score double")
    chips = segmentation.segment_sentences(q.where(T.is_japanese("q")).select(F.col("qid").alias("id"), F.col("q").alias("sentence")), index)
    return retrieval.promoted(q, found, chips.select(F.col("id").alias("qid"), "pos", F.col("text").alias("surface"))).select("qid", "rank", "id", "surface")


@query(expected("literal, words", ("犬", "犬|子犬"), ("子", "子犬"), ("人", "二人"), ("走", "走る")))
def own_word_first(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("犬", [(1, "子犬"), (2, "犬")]), ("子", [(1, "子犬")]), ("人", [(1, "二人")]), ("走", [(1, "走る")])], "literal string, w array<struct<rank:int,kanji_form:string>>")
    words = F.transform("w", lambda x: F.struct(x["rank"].alias("rank"), x["kanji_form"].alias("kanji_form"), F.lit("").alias("reading"), F.array(F.lit("")).alias("meanings")))
    return rows.select("literal", joined(F.transform(browse.own_word_first(F.col("literal"), words), lambda x: x["kanji_form"])).alias("words"))


@query(expected("set, literal", ("one verified", "c"), ("none verified", "z"), ("none ranked", "日")))
def verified_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of eight draws the first that is verified; the draw itself if none is; a constant where nothing can be drawn."""
    kanji = spark.createDataFrame([(c, n + 1) for n, c in enumerate("abcdef")], "literal string, freq int")
    known = spark.createDataFrame([("c",)], "literal string")
    part = lambda name, df, ok: browse.verified_pick(df, ok, 5).select(F.lit(name).alias("set"), "literal")
    alone = spark.createDataFrame([("z", 1)], "literal string, freq int")
    return part("one verified", kanji, known).unionByName(part("none verified", alone, known)).unionByName(part("none ranked", kanji.where("freq = 0"), known))


@query(expected("level, most_bullets, bullet_words, words, token_budget", ("N5", 4, 30, 160, 752), ("N4", 4, 24, 130, 686), ("N3", 3, 20, 100, 620), ("N2", 3, 16, 85, 587), ("N1", 3, 18, 70, 554)))
def level_limits(spark: SparkSession, d: str) -> DataFrame:
    return explanations.levels(spark).select("level", "most_bullets", "bullet_words", "words", "token_budget")


@query(expected("id, limits, tokens, user", (1, "At most 4 bullets of at most 30 words, 160 words in all.", 752, "<sentence>犬だ</sentence>\n<meaning>a dog</meaning>\n<analysis>\nMade by a program; where it disagrees, the sentence is right.\n犬 (犬, 名詞)\n</analysis>"), (2, "At most 3 bullets of at most 20 words, 100 words in all.", 620, "<sentence>猫</sentence>\n<meaning>cat</meaning>")))
def explanation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """An unknown level takes the middle one's limits; an empty hint is left out."""
    asked = spark.createDataFrame([(1, "犬だ", "a dog", "N5", "犬 (犬, 名詞)"), (2, "猫", "cat", "x", "")], "id int, sentence string, meaning string, level string, hint string")
    return explanations.prompts(asked).select("id", F.substring_index("system", "\n", -1).alias("limits"), F.col("token_budget").alias("tokens"), "user")


@query(expected("id, reply", (1, "- **犬** — dog."), (2, "- **猫** — cat."), (3, None)))
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """The first model along the ladder that answers; the answer is tidied."""
    asked = spark.createDataFrame([(1, "s", "犬"), (2, "s", "猫"), (3, "s", "鳥")], "id int, system string, user string")
    models = [_Model({"犬": "- **犬** (犬) — dog.\n- **犬** — again."}), _Model({"犬": "no", "猫": "- **猫** — cat."})]
    return explanations.tidy_texts(providers.replies(asked, models, "id", "system", "user"), 3, "id", "reply").select("id", F.col("text").alias("reply"))


@query(expected("id, reply, model, tokens, cut", (1, "a in 90", 0, 100, False), (2, "b in 140", 0, 150, False), (3, "c in 100", 1, 100, False), (4, "d in 100", 1, 100, True), (5, None, None, None, None), (6, "f in 50", 1, 100, False)))
def failover_answers(spark: SparkSession, d: str) -> DataFrame:
    """A cut answer is asked for once more with half as many tokens again; then the next model's turn comes."""
    models = [_Bounded({"a": 90, "b": 140, "f": 400}), _Bounded({"a": 10, "c": 100, "d": 900, "f": 50})]
    asked = spark.createDataFrame([(n, "s", u, 100) for n, u in enumerate("abcdef", 1) if u != "e"] + [(5, "s", "e", 100)], "id int, system string, user string, budget int")
    return providers.answers(asked, models, "id", "system", "user", "budget")


def _engine(spark: SparkSession):
    from lexloom.engine import Engine

    engine = Engine(spark, tables.scratch(spark, "engine"))
    engine.build(_dictionary(spark), _file(spark, "characters.xml", CHARACTERS))
    return engine


@query(expected("name, n", ("ready", 5), ("entries", 5), ("kanji", 3), ("corpus", 1), ("before", 0)))
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a built store; a store that isn't built counts nothing."""
    from lexloom.engine import Engine

    engine = _engine(spark)
    rows = [("ready", engine.ready()), *[(t, engine.table(t).count()) for t in ("entries", "kanji", "corpus")], ("before", Engine(spark, tables.scratch(spark, "none")).ready())]
    return spark.createDataFrame(rows, "name string, n int")


@query(expected("qid, rank, id, reading, inflection", (1, 1, 10, "かく", "Past"), (2, 1, 11, "パン", None), (3, 1, 16, "たかい", None), (4, 1, 14, "あした", None)))
def store_search(spark: SparkSession, d: str) -> DataFrame:
    """A built store answers an inflected form, a question, a gloss and a written form from its stored postings and keys."""
    asked = spark.createDataFrame([(1, "書いた"), (2, "What is the word for bread?"), (3, "high"), (4, "明日")], "qid long, query string")
    return _engine(spark).search(asked).select("qid", "rank", "id", "reading", "inflection")


@query(expected("literal, words", ("書", "書く"), ("犬", None), ("𠮟", None), ("無", None)))
def character_cards(spark: SparkSession, d: str) -> DataFrame:
    """Characters with their common words; an unknown one has nulls."""
    cards = _engine(spark).cards(spark.createDataFrame([("書",), ("犬",), ("𠮟",), ("無",)], "literal string"))
    return cards.select("literal", joined(F.transform("words", lambda w: w["kanji_form"])).alias("words"))


@query(expected("at, n", (0, 1), (9, 1), (10, 2), (20, 2), (30, 4)))
def refreshed_table(spark: SparkSession, d: str) -> DataFrame:
    """A held table is read anew after ten seconds; at 20 that fails, and the old one stays."""
    now, reads = [0], []

    def load() -> DataFrame:
        reads.append(now[0])
        if now[0] == 20:
            raise OSError("the source is down")
        return spark.range(len(reads))

    held, rows = tables.Refreshed(load, 10, lambda: now[0]), []
    for now[0] in (0, 9, 10, 20, 30):
        rows.append((now[0], held.get().count()))
    return spark.createDataFrame(rows, "at int, n int")


QUERIES, ORACLE_SQL = query.queries, query.sql
