"""From parsed dictionary elements to entry rows, by higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import conjugation

#: Markers of common words, first and second tier.
COMMON_MARKS, SECOND_MARKS = ("news1", "ichi1", "spec1", "spec2", "gai1"), ("news2", "ichi2", "gai2")
#: Openers after which a gloss has no head word.
NO_HEAD = ("to ", "and ", "or ", "be ")

#: Part-of-speech codes by tag, tags in badge order.
POS_TAGS = {
    "verb": ["vt", "vi", "vr", "vk", "vn", "vz", "v-unspec", "v1", "v1-s", "v5r", "v5s", "v5k", "v5u", "v5m", "v5t", "v5g", "v5b", "v5n", "v5aru", "v5r-i", "v5k-s", "v5u-s", "v5uru", "vs", "vs-i", "vs-s", "vs-c", "v2a-s", "v2b-k", "v2b-s", "v2d-k", "v2d-s", "v2g-k", "v2g-s", "v2h-k", "v2h-s", "v2k-k", "v2k-s", "v2m-k", "v2m-s", "v2n-s", "v2r-k", "v2r-s", "v2s-s", "v2t-k", "v2t-s", "v2w-s", "v2y-k", "v2y-s", "v2z-s", "v4b", "v4g", "v4h", "v4k", "v4m", "v4n", "v4r", "v4s", "v4t"],
    "adj-i": ["adj-i", "adj-ix", "adj-ku", "adj-shiku", "adj-t", "adj-kari"],
    "adj-na": ["adj-na", "adj-nari", "adj-no", "adj-pn"],
    "adv": ["adv", "adv-to"],
    "intj": ["int"],
    "phrase": ["exp"],
    "noun": ["n", "n-suf", "n-pref", "n-adv", "n-t", "n-pr"],
    "other": ["adj-f", "suf", "pn", "prt", "pref", "conj", "ctr", "aux-v", "num", "aux", "unc", "cop", "aux-adj"],
}
#: Usage codes by tag, tags in badge order.
MISC_TAGS = {
    "on-mim": ["on-mim"],
    "idiom": ["yoji", "id", "proverb"],
    "abbr": ["abbr"],
    "kana": ["uk"],
    "formal": ["form", "hon"],
    "archaic": ["arch", "rare", "hist", "obs", "dated", "poet"],
    "colloquial": ["col", "sl", "net-sl", "m-sl", "derog", "vulg", "joc", "hum", "fam", "serv", "chn", "pol"],
    "sensitive": ["sens"],
    "name": ["org", "work", "company", "product", "person", "place", "surname", "given", "dei", "ship", "station", "ev", "obj", "doc", "creat", "fict", "leg", "myth", "relig", "group", "unclass"],
    "other": ["fem", "male", "char", "quote", "euph", "oth", "X"],
}


#: The same tables with blank-separated codes.
POS_CODES, MISC_CODES = ({tag: " ".join(codes) for tag, codes in table.items()} for table in (POS_TAGS, MISC_TAGS))


def coded_tags(codes: Column, table: dict[str, list[str]]) -> Column:
    """The tags of codes, once each and in badge order; unknown codes are dropped."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(codes, F.array(*map(F.lit, members))), F.lit(tag)) for tag, members in table.items()]))


def unmapped_codes(elements: DataFrame, codes: Column, table: dict[str, list[str]], n: int = 10) -> DataFrame:
    """(code, count): the most frequent codes that no tag has."""
    known = [c for members in table.values() for c in members]
    rows = elements.select(F.explode(codes).alias("code")).where(~F.col("code").isin(known))
    return rows.groupBy("code").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code").limit(n)


def primary(elements: Column, text: str, marks: str) -> Column:
    """The first form with a first-tier marker, else the first form."""
    common = F.array(*map(F.lit, COMMON_MARKS))
    named = F.filter(elements, lambda x: F.coalesce(x[text] != "", F.lit(False)))
    marked = F.filter(named, lambda x: F.coalesce(F.arrays_overlap(x[marks], common), F.lit(False)))
    return F.coalesce(F.try_element_at(marked, F.lit(1)), F.try_element_at(named, F.lit(1)))[text]


def frequency_band(marks: Column) -> Column:
    """The least nfNN; null if there is none."""
    return F.array_min(F.transform(F.filter(marks, lambda m: m.rlike(r"^nf\d{2}$")), lambda m: F.substring(m, 3, 2).cast("int")))


def commonness(marks: Column, band: Column) -> Column:
    tier = F.when(F.arrays_overlap(marks, F.array(*map(F.lit, COMMON_MARKS))), F.lit(1.0)).when(F.arrays_overlap(marks, F.array(*map(F.lit, SECOND_MARKS))), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.greatest(tier, F.coalesce(F.round(0.75 * (49 - band) / 48, 4), F.lit(0.0)))


def head_words(glosses: Column) -> Column:
    """First words of glosses of several words that don't open like a verb or a conjunction."""
    return _heads(F.transform(glosses, T.gloss_key))


def _heads(keys: Column) -> Column:
    good = F.filter(keys, lambda k: k.contains(" ") & ~k.rlike("^(?:" + "|".join(NO_HEAD) + ")") & F.split(k, " ")[0].rlike(r"^\p{L}+$"))
    return F.transform(good, lambda k: F.split(k, " ")[0])


def key_set(glosses: Column, heads: bool = True) -> Column:
    """Sorted keys of glosses, and their head words."""

    def derived(keys: Column) -> Column:
        plain = F.flatten(F.transform(keys, T.keys_of))
        return F.array_sort(F.array_distinct(F.concat(plain, _heads(keys)) if heads else plain))

    # as an argument of a function the keys are worked out once, not at each use
    return F.get(F.transform(F.array(F.transform(glosses, T.gloss_key)), derived), F.lit(0))


def restrictions(readings: Column) -> Column:
    """map reading -> written forms: empty for kana only; readings without restriction are absent."""
    rows = F.transform(readings, lambda r: F.struct(r["reb"].alias("k"), F.when(r["nokanji"], F.array().cast("array<string>")).when(F.size(r["restr"]) > 0, r["restr"]).alias("v")))
    # a repeated reading takes its last restriction, as a map would
    kept = F.filter(rows, lambda x: x["k"].isNotNull() & (x["k"] != "") & x["v"].isNotNull())
    last = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def cross_references(xrefs: Column) -> Column:
    """Display text (written form, reading, or text without its sense number), type "see" by default, once per (text, type)."""
    shown = F.transform(xrefs, lambda x: F.struct(F.coalesce(x["seq"], F.lit("")).alias("seq"), F.coalesce(_some(x["xk"]), _some(x["xr"]), F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s*\[\d+\]\s*$", "")).alias("text"), F.coalesce(_some(x["type"]), F.lit("see")).alias("type"), _some(x["sno"]).alias("sno")))
    named = F.filter(shown, lambda x: x["text"] != "")
    return F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.lit(1), i), lambda y: (y["text"] == x["text"]) & (y["type"] == x["type"])))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def senses(raw: Column) -> Column:
    """Senses with coarse tags, sorted fields and dialects, up to three examples, and cross references."""

    def one(s: Column) -> Column:
        return F.struct(
            english(s["glosses"]).alias("glosses"), coded_tags(s["pos"], POS_TAGS).alias("pos"), coded_tags(s["misc"], MISC_TAGS).alias("misc"), F.array_sort(F.array_distinct(s["field"])).alias("field"),
            F.array_sort(s["dial"]).alias("dial"), s["s_inf"].alias("s_inf"), s["stagk"].alias("stagk"), s["stagr"].alias("stagr"), F.slice(pairs(s["examples"]), 1, 3).alias("examples"), cross_references(s["xrefs"]).alias("xrefs"),
        )

    return F.transform(raw, one)


def english(glosses: Column) -> Column:
    kept = F.filter(glosses, lambda g: (F.coalesce(g["lang"], F.lit("eng")) == "eng") & F.coalesce(g["text"] != "", F.lit(False)))
    return F.transform(kept, lambda g: g["text"])


def pairs(examples: Column) -> Column:
    """Examples with both sides."""
    return F.filter(examples, lambda e: F.coalesce((e["japanese"] != "") & (e["english"] != ""), F.lit(False)))


def build_entries(raw: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """Entry rows of parsed elements; entries without a reading or an English gloss are dropped.

    ``raw`` has id, k_ele array<struct<keb,pri,inf>>, r_ele array<struct<reb,pri,nokanji,restr>>, sense array<struct<glosses array<struct<text,lang>>,
    pos, misc (codes), pos_text, misc_text (texts), field, dial, s_inf, stagk, stagr, examples array<struct<japanese,english>>, xrefs>>,
    lsource array<struct<lang,text,ls_type,ls_wasei>>, info.  ``frequencies`` (form, zipf, n_tokens) is a provider's table; without it scores are 0.
    """
    marks = F.array_distinct(F.concat(F.flatten(F.transform("k_ele", lambda k: k["pri"])), F.flatten(F.transform("r_ele", lambda r: r["pri"]))))
    named = lambda c, f: F.filter(F.transform(c, lambda x: x[f]), lambda x: F.coalesce(x != "", F.lit(False)))
    df = raw.withColumns({
        "marks": marks, "kanji_form": primary(F.col("k_ele"), "keb", "pri"), "reading": primary(F.col("r_ele"), "reb", "pri"), "all_kanji": named("k_ele", "keb"), "all_readings": named("r_ele", "reb"),
        "meanings": F.flatten(F.transform("sense", lambda s: english(s["glosses"]))), "first_sense": F.coalesce(english(F.try_element_at("sense", F.lit(1))["glosses"]), F.array().cast("array<string>")),
    }).where("reading is not null and size(meanings) > 0")
    df = df.withColumn("freq_band", frequency_band(F.col("marks")))
    several = lambda c: F.when(F.size(c) > 1, F.col(c))
    pos_texts = F.array_distinct(F.flatten(F.transform("sense", lambda s: s["pos_text"])))
    inf = F.filter(F.transform("k_ele", lambda k: F.struct(k["keb"].alias("k"), k["inf"].alias("v"))), lambda x: F.size(x["v"]) > 0)
    inf = F.filter(inf, lambda x, i: ~F.exists(F.slice(inf, i + 2, F.size(inf)), lambda y: y["k"] == x["k"]))
    display = F.coalesce("kanji_form", "reading")
    kana_pref = F.exists(F.coalesce(F.try_element_at("sense", F.lit(1))["misc_text"], F.array().cast("array<string>")), lambda m: m.contains("kana alone"))
    source = F.transform("lsource", lambda x: F.struct(F.coalesce(x["lang"], F.lit("eng")).alias("lang"), F.coalesce(x["text"], F.lit("")).alias("text"), F.when(x["ls_type"] == "part", F.lit("part")).alias("type"), F.when(x["ls_wasei"] == "y", F.lit(True)).alias("wasei")))
    out = df.select(
        F.col("id").cast("long").alias("id"), "kanji_form", "reading", "meanings", key_set(F.col("meanings")).alias("gloss_keys"), key_set(F.col("first_sense")).alias("primary_gloss_keys"),
        key_set(F.slice("first_sense", 1, 1), heads=False).alias("head_gloss_keys"), F.slice(F.flatten(F.transform("sense", lambda s: pairs(s["examples"]))), 1, 5).alias("example_sentences"),
        F.concat(display, F.lit(" ["), "reading", F.lit("]: "), F.array_join(F.slice("meanings", 1, 3), ", ")).alias("text"),
        F.concat(F.array_join(F.concat("all_kanji", "all_readings"), " "), F.lit(": "), F.array_join("meanings", ", ")).alias("sparse_text"),
        F.arrays_overlap("marks", F.array(*map(F.lit, COMMON_MARKS))).alias("is_common"), commonness(F.col("marks"), F.col("freq_band")).alias("commonness"), "freq_band",
        several("all_kanji").alias("kanji_forms"), several("all_readings").alias("readings"), restrictions(F.col("r_ele")).alias("reading_restrictions"), F.map_from_entries(inf).alias("ke_inf"),
        senses(F.col("sense")).alias("senses"), source.alias("lsource"), F.col("info").alias("notes"), pos_texts.alias("pos_texts"), F.when(kana_pref | F.col("kanji_form").isNull(), F.col("reading")).otherwise(F.col("kanji_form")).alias("counted_form"),
    )
    if frequencies is None:
        out = out.withColumn("wf_score", F.lit(0.0))
    else:
        # the written form, one decade less for each further token
        f = frequencies.select(F.col("form").alias("counted_form"), F.round(F.col("zipf") - F.greatest(F.col("n_tokens") - 1, F.lit(0)), 3).alias("wf_score"))
        out = out.join(f, "counted_form", "left").withColumn("wf_score", F.coalesce("wf_score", F.lit(0.0)))
    words = out.select("id", F.col("pos_texts").alias("pos"), F.col("kanji_form").alias("kanji"), F.col("reading").alias("kana"))
    return out.join(conjugation.tables(words), "id", "left").drop("pos_texts", "counted_form").withColumn("has_lsource", F.size("lsource") > 0)


def signature(columns: list[str], rows: DataFrame | None = None) -> Column:
    """Sixteen hex digits over the named columns in the order of their names: equal rows have equal signatures.

    Maps have no order, so those that ``rows`` has among the columns are taken as sorted entries.
    """
    kinds = dict(rows.dtypes) if rows is not None else {}
    values = [F.array_sort(F.map_entries(c)).alias(c) if kinds.get(c, "").startswith("map") else F.col(c) for c in sorted(columns)]
    return F.substring(F.sha1(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})), 1, 16)


def payload(entries: DataFrame) -> DataFrame:
    """Entries with defaults in place of nulls, and their signature."""
    empty = {t: F.array().cast(t) for n, t in entries.dtypes if t.startswith("array")}
    cols = []
    for name, kind in entries.dtypes:
        default = empty[kind] if kind in empty else {"boolean": F.lit(False), "double": F.lit(0.0)}.get(kind)
        cols.append(F.coalesce(name, default).alias(name) if default is not None else F.col(name))
    plain = entries.select(*cols)
    return plain.withColumn("sig", signature([n for n, _ in plain.dtypes if n != "sig"], plain))


def variants(entry: Column | None = None) -> Column:
    """struct(forms, readings, kana_only): which reading goes with which written form; null without restrictions or labels."""
    none = F.array().cast("array<string>")
    rr, ki = F.col("reading_restrictions"), F.col("ke_inf")
    forms, readings = F.coalesce("kanji_forms", none), F.coalesce("readings", none)
    size = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    of = lambda m, k: F.try_element_at(m, k)
    rows = F.transform(forms, lambda f: F.struct(f.alias("form"), F.filter(readings, lambda r: F.coalesce(F.array_contains(of(rr, r), f), F.lit(False))).alias("readings"), F.coalesce(of(ki, f), none).alias("labels")))
    block = F.struct(rows.alias("forms"), F.filter(readings, lambda r: of(rr, r).isNull()).alias("readings"), F.filter(readings, lambda r: F.coalesce(F.size(of(rr, r)) == 0, F.lit(False))).alias("kana_only"))
    return F.when(((size(rr) > 0) | (size(ki) > 0)) & (F.size(forms) > 0), block)


def entry_forms() -> Column:
    """Every written form of an entry."""
    none = F.array().cast("array<string>")
    return F.concat(F.array("kanji_form", "reading"), F.coalesce("kanji_forms", none), F.coalesce("readings", none))


def common_subset(entries: DataFrame, band: int = 24) -> DataFrame:
    """Entries with examples, or common, or within a frequency band."""
    return entries.where((F.coalesce(F.size("example_sentences"), F.lit(0)) > 0) | F.coalesce("is_common", F.lit(False)) | (F.coalesce("freq_band", F.lit(999)) <= band))


def without_names(entries: DataFrame) -> DataFrame:
    """Entries none of whose senses is a name."""
    return entries.where(~F.exists("senses", lambda s: F.coalesce(F.array_contains(s["misc"], "name"), F.lit(False))))


def entry_totals(entries: DataFrame) -> DataFrame:
    """(entries, common, examples): one row for the build's report."""
    return entries.agg(F.count("*").alias("entries"), F.sum(F.col("is_common").cast("long")).alias("common"), F.sum(F.size("example_sentences").cast("long")).alias("examples"))


def split_senses(sense: Column, pos: int = 3, misc: int = 3, xrefs: int = 6) -> Column:
    """What a result shows of a sense: a few tags, a few references, and antonyms apart."""
    other = F.filter(sense["xrefs"], lambda x: x["type"] != "ant")
    opposite = F.filter(sense["xrefs"], lambda x: x["type"] == "ant")
    return F.struct(F.slice(sense["pos"], 1, pos).alias("pos"), F.slice(sense["misc"], 1, misc).alias("misc"), F.slice(other, 1, xrefs).alias("xrefs"), opposite.alias("antonyms"))
