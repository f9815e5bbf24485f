"""Sources of nested markup: dictionary and character XML, stroke drawings, gold queries, key-value JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entity that XML doesn't define itself is kept as {code}, which is what later steps want.
_ENTITY = r"&(?!amp;|lt;|gt;|apos;|quot;|#)([A-Za-z0-9-]+);"
_NAMED = "array<struct<_VALUE:string>>"

ENTRY_SCHEMA = (
    "ent_seq string, k_ele array<struct<keb:string,ke_pri:array<string>,ke_inf:array<string>>>, "
    "r_ele array<struct<reb:string,re_pri:array<string>,re_nokanji:string,re_restr:array<string>>>, "
    "sense array<struct<stagk:array<string>,stagr:array<string>,pos:array<string>,xref:array<struct<_VALUE:string,_type:string,_seq:string,_sno:string,_xk:string,_xr:string>>,field:array<string>,misc:array<string>,s_inf:array<string>,dial:array<string>,"
    "gloss:array<struct<_VALUE:string,`_xml:lang`:string>>,example:array<struct<ex_sent:array<struct<_VALUE:string,`_xml:lang`:string>>>>>>, "
    "lsource array<struct<_VALUE:string,`_xml:lang`:string,_ls_type:string,_ls_wasei:string>>, info array<string>"
)
CHARACTER_SCHEMA = (
    "literal string, misc struct<stroke_count:array<int>,grade:int,freq:int,jlpt:int>, "
    "reading_meaning struct<rmgroup:array<struct<reading:array<struct<_VALUE:string,_r_type:string>>,meaning:array<struct<_VALUE:string,_m_lang:string>>>>>"
)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(code, text) of the entity lines of a document type."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*<!ENTITY\s"))
    return lines.select(F.regexp_extract("value", r'<!ENTITY\s+(\S+)\s+"([^"]*)"', 1).alias("code"), F.regexp_extract("value", r'<!ENTITY\s+(\S+)\s+"([^"]*)"', 2).alias("text")).where("code <> ''")


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(xml): one row per element, read as records that end with the closing tag, so splits are independent."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    xml = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)
    return rows.select(F.when(xml != "", F.concat(F.regexp_replace(xml, _ENTITY, "{$1}"), F.lit(f"</{tag}>"))).alias("xml")).where("xml is not null")


def parsed(rows: DataFrame, tag: str, schema: str) -> DataFrame:
    return rows.select(F.from_xml("xml", schema, {"rowTag": tag, "ignoreNamespace": "false", "mode": "PERMISSIVE"}).alias("e")).select("e.*")


def _codes(c: Column) -> Column:
    """Codes of entity texts {code}."""
    return F.transform(_list(c), lambda x: F.regexp_replace(x, r"^\{(.*)\}$", "$1"))


def _list(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries in the shape that ``operators.entries.build_entries`` takes.

    Part-of-speech and usage texts are spelt out from the document's own entity lines, a few hundred at most.
    """
    named = entities(spark, path)
    table = named.agg(F.map_from_entries(F.collect_set(F.struct("code", "text"))).alias("names"))
    raw = parsed(elements(spark, path, "entry"), "entry", ENTRY_SCHEMA).crossJoin(F.broadcast(table))
    spelt = lambda codes: F.transform(codes, lambda c: F.coalesce(F.try_element_at("names", c), c))
    lang = lambda x: x["_xml:lang"]

    def example(e: Column) -> Column:
        def side(code: str) -> Column:
            return F.try_element_at(F.filter(e["ex_sent"], lambda s: F.coalesce(lang(s), F.lit("eng")) == code), F.lit(1))["_VALUE"]

        return F.struct(side("jpn").alias("japanese"), side("eng").alias("english"))

    def sense(s: Column) -> Column:
        pos, misc = _codes(s["pos"]), _codes(s["misc"])
        xrefs = F.transform(s["xref"], lambda x: F.struct(x["_VALUE"].alias("text"), x["_type"].alias("type"), x["_seq"].alias("seq"), x["_sno"].alias("sno"), x["_xk"].alias("xk"), x["_xr"].alias("xr")))
        return F.struct(
            _or_empty(F.transform(s["gloss"], lambda g: F.struct(g["_VALUE"].alias("text"), lang(g).alias("lang"))), "array<struct<text:string,lang:string>>").alias("glosses"),
            pos.alias("pos"), misc.alias("misc"), spelt(pos).alias("pos_text"), spelt(misc).alias("misc_text"), spelt(_codes(s["field"])).alias("field"),
            F.transform(_codes(s["dial"]), lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at("names", c), c).alias("name"))).alias("dial"),
            _list(s["s_inf"]).alias("s_inf"), _list(s["stagk"]).alias("stagk"), _list(s["stagr"]).alias("stagr"),
            _or_empty(F.transform(s["example"], example), "array<struct<japanese:string,english:string>>").alias("examples"), _or_empty(xrefs, "array<struct<text:string,type:string,seq:string,sno:string,xk:string,xr:string>>").alias("xrefs"),
        )

    k = F.transform("k_ele", lambda x: F.struct(x["keb"].alias("keb"), _list(x["ke_pri"]).alias("pri"), _codes(x["ke_inf"]).alias("inf")))
    r = F.transform("r_ele", lambda x: F.struct(x["reb"].alias("reb"), _list(x["re_pri"]).alias("pri"), x["re_nokanji"].isNotNull().alias("nokanji"), _list(x["re_restr"]).alias("restr")))
    source = F.transform("lsource", lambda x: F.struct(lang(x).alias("lang"), x["_VALUE"].alias("text"), x["_ls_type"].alias("ls_type"), x["_ls_wasei"].alias("ls_wasei")))
    return raw.select(
        F.col("ent_seq").alias("id"), _or_empty(k, "array<struct<keb:string,pri:array<string>,inf:array<string>>>").alias("k_ele"), _or_empty(r, "array<struct<reb:string,pri:array<string>,nokanji:boolean,restr:array<string>>>").alias("r_ele"),
        F.coalesce(F.transform("sense", sense), F.array()).alias("sense"), _or_empty(source, "array<struct<lang:string,text:string,ls_type:string,ls_wasei:string>>").alias("lsource"), _list(F.col("info")).alias("info"),
    )


def characters(spark: SparkSession, path: str) -> DataFrame:
    """(literal, codepoint_hex, meanings, on_yomi, kun_yomi, stroke_count, grade, freq, jlpt_level)."""
    from ..functions.japanese import codepoint_hex

    raw = parsed(elements(spark, path, "character"), "character", CHARACTER_SCHEMA)
    groups = F.coalesce(F.col("reading_meaning.rmgroup"), F.array())
    readings, meanings = F.flatten(F.transform(groups, lambda g: g["reading"])), F.flatten(F.transform(groups, lambda g: g["meaning"]))
    of = lambda kind: F.transform(F.filter(readings, lambda x: x["_r_type"] == kind), lambda x: x["_VALUE"])
    english = F.transform(F.filter(meanings, lambda m: m["_m_lang"].isNull() | (m["_m_lang"] == "en")), lambda m: m["_VALUE"])
    return raw.where("literal is not null").select(
        "literal", codepoint_hex("literal").alias("codepoint_hex"), english.alias("meanings"), of("ja_on").alias("on_yomi"), of("ja_kun").alias("kun_yomi"),
        F.try_element_at("misc.stroke_count", F.lit(1)).alias("stroke_count"), "misc.grade", "misc.freq", F.col("misc.jlpt").alias("jlpt_level"),
    )


def strokes(svg: Column) -> Column:
    """struct(view_box, strokes, numbers): path data in stroke order and numbered places, extracted by attribute."""
    box = F.regexp_extract(svg, r'<svg[^>]*\bviewBox="([^"]+)"', 1)
    path = r'<path\b[^>]*\bid="[^"]*-s(\d+)"[^>]*\bd="([^"]+)"'
    order, data = (F.regexp_extract_all(svg, F.lit(path), F.lit(k)) for k in (1, 2))
    drawn = F.array_sort(F.zip_with(order, data, lambda n, d: F.struct(n.cast("int").alias("n"), d.alias("d"))))
    text = r'<text transform="matrix\(1 0 0 1 ([\d.]+) ([\d.]+)\)">([^<]+)</text>'
    x, y, v = (F.regexp_extract_all(svg, F.lit(text), F.lit(k)) for k in (1, 2, 3))
    numbers = F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), v.alias("v")), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), p["v"].try_cast("int").alias("value")))
    return F.struct(F.when(box != "", box).otherwise(F.lit("0 0 109 109")).alias("view_box"), F.transform(drawn, lambda p: p["d"]).alias("strokes"), numbers.alias("numbers"))


def stroke_files(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(codepoint_hex, strokes) of a folder of drawings named by five hex digits; ``wanted`` (codepoint_hex) narrows it."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{5})\.svg$", 1).alias("codepoint_hex"), "value").where("codepoint_hex <> ''")
    if wanted is not None:
        rows = rows.join(wanted.select("codepoint_hex").distinct(), "codepoint_hex", "left_semi")
    return rows.select("codepoint_hex", strokes(F.col("value")).alias("strokes"))


def gold_queries(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(category, query, expected array<string>) of tab-separated lines; comments, blanks and the header are skipped.

    Alternatives are parted by slashes and lose one closing parenthesis; a repeated query merges its alternatives.
    """
    rows = lines.where(~F.col(value_col).rlike(r"^\s*(#|$)")).select(F.split(value_col, "\t").alias("f")).where("size(f) >= 3 and f[0] <> 'category'")
    options = F.filter(F.transform(F.split(F.col("f")[2], "/"), lambda x: F.trim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", ""))), lambda x: x != "")
    rows = rows.select(F.trim(F.col("f")[0]).alias("category"), F.trim(F.col("f")[1]).alias("query"), options.alias("expected"))
    return rows.groupBy("category", "query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("expected")))).alias("expected"))


def category_notes(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(category, note) of comment lines "# name: note"."""
    pattern = r"^#\s*(\w+)\s*[:—-]\s*(.+)$"
    return lines.where(F.col(value_col).rlike(pattern)).select(F.regexp_extract(value_col, pattern, 1).alias("category"), F.trim(F.regexp_extract(value_col, pattern, 2)).alias("note"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(locale, key, text) of files named by locale, each a JSON object of strings."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([\w-]+)\.json$", 1).alias("locale"), F.from_json("value", "map<string,string>").alias("m"))
    return rows.where("locale <> ''").select("locale", F.explode("m").alias("key", "text"))


def kana_chart(spark: SparkSession, path: str) -> DataFrame:
    """(table, row, column, kana, romaji) of a chart of JSON tables of rows of cells; empty cells are skipped."""
    text = spark.read.text(path, wholetext=True)
    tables = text.select(F.explode(F.from_json("value", "map<string,array<array<map<string,string>>>>")).alias("table", "rows"))
    cells = tables.select("table", F.posexplode("rows").alias("row", "cells")).select("table", "row", F.posexplode("cells").alias("column", "cell")).where("cell is not null")
    return cells.select("table", "row", "column", F.col("cell")["kana"].alias("kana"), F.col("cell")["romaji"].alias("romaji"))


def generation_date(head: Column) -> Column:
    """The date of a file's "created" line."""
    found = F.regexp_extract(head, r"(?i)created:\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found.cast("date"))


def generation_dates(spark: SparkSession, path: str) -> DataFrame:
    """(date) of the lines of a file that state one."""
    return spark.read.text(path).select(generation_date(F.col("value")).alias("date")).where("date is not null")
