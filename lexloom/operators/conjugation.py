"""Conjugation as a join of words with rule rows (paradigm, ending, form name, characters dropped, suffix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each ending of a five-row verb becomes before masu, before nai, in the past, in the te-form, in the e row, in the o row.
GODAN = {
    "う": "い わ った って え お", "く": "き か いた いて け こ", "ぐ": "ぎ が いだ いで げ ご", "す": "し さ した して せ そ", "つ": "ち た った って て と",
    "ぬ": "に な んだ んで ね の", "ぶ": "び ば んだ んで べ ぼ", "む": "み ま んだ んで め も", "る": "り ら った って れ ろ",
}
#: The cells that two special classes change.
GODAN_SPECIAL = {"godan-iku": ("く", "き か った って け こ"), "godan-u": ("う", "い わ うた うて え お")}
#: Form names and suffixes; {i a t e E o} stand for the six cells of a five-row verb.
GODAN_FORMS = (
    ("Dictionary", None), ("Polite present", "{i}ます"), ("Polite negative", "{i}ません"), ("Polite past", "{i}ました"), ("Polite past negative", "{i}ませんでした"), ("Negative", "{a}ない"), ("Past", "{t}"),
    ("Past negative", "{a}なかった"), ("Te-form", "{e}"), ("Potential", "{E}る"), ("Passive", "{a}れる"), ("Causative", "{a}せる"), ("Volitional", "{o}う"), ("Imperative", "{E}"), ("Conditional", "{E}ば"),
)
ICHIDAN_FORMS = (
    ("Dictionary", None), ("Polite present", "ます"), ("Polite negative", "ません"), ("Polite past", "ました"), ("Polite past negative", "ませんでした"), ("Negative", "ない"), ("Past", "た"), ("Past negative", "なかった"),
    ("Te-form", "て"), ("Potential / Passive", "られる"), ("Causative", "させる"), ("Volitional", "よう"), ("Imperative", "ろ"), ("Conditional", "れば"),
)
#: Fixed values: {p} and {o} stand for the two stems of 来る.
KURU_FORMS = (
    ("Dictionary", None), ("Polite present", "{p}ます"), ("Polite negative", "{p}ません"), ("Polite past", "{p}ました"), ("Polite past negative", "{p}ませんでした"), ("Negative", "{o}ない"), ("Past", "{p}た"),
    ("Past negative", "{o}なかった"), ("Te-form", "{p}て"), ("Potential / Passive", "{o}られる"), ("Causative", "{o}させる"), ("Volitional", "{o}よう"), ("Imperative", "{o}い"), ("Conditional", "{k}れば"),
)
SURU_FORMS = (
    ("Dictionary", None), ("Polite present", "します"), ("Polite negative", "しません"), ("Polite past", "しました"), ("Polite past negative", "しませんでした"), ("Negative", "しない"), ("Past", "した"), ("Past negative", "しなかった"),
    ("Te-form", "して"), ("Potential", "できる"), ("Passive", "される"), ("Causative", "させる"), ("Volitional", "しよう"), ("Imperative", "しろ"), ("Conditional", "すれば"),
)
SURU_UNSAFE = ("Potential", "Passive", "Causative", "Volitional", "Imperative")
#: Fixed values: (form name, characters dropped, suffix) of ある.
ARU_FORMS = (
    ("Dictionary", 0, ""), ("Polite present", 1, "ります"), ("Polite negative", 1, "りません"), ("Polite past", 1, "りました"), ("Polite past negative", 1, "りませんでした"), ("Negative", 2, "ない"), ("Past", 1, "った"),
    ("Past negative", 2, "なかった"), ("Te-form", 1, "って"), ("Volitional", 1, "ろう"), ("Conditional", 1, "れば"),
)
ADJECTIVE_FORMS = (("Negative", "くない"), ("Past", "かった"), ("Past negative", "くなかった"), ("Te-form", "くて"), ("Adverbial", "く"), ("Conditional", "ければ"))

#: Dictionary wordings of the classes that conjugate, with their order where a word has several.
IKU, SPECIAL_U, ARU = "Godan verb - Iku/Yuku special class", "Godan verb with 'u' ending (special class)", "Godan verb with 'ru' ending (irregular verb)"
KURERU, ZURU, KURU = "Ichidan verb - kureru special class", "Ichidan verb - zuru verb (alternative form of -jiru verbs)", "Kuru verb - special class"
SURU_AUX, SURU_SPECIAL, SURU_INCLUDED = "takes the aux. verb suru", "suru verb - special class", "suru verb - included"
PLAIN_GODAN = r"^Godan verb with '.{1,2}' ending(?!.*(?:special class|\(irregular))"
CLASSES = (
    ("ichidan", lambda t: t.isin("Ichidan verb", KURERU)), ("zuru", lambda t: t == ZURU), ("godan", lambda t: t.isin(IKU, SPECIAL_U) | t.rlike(PLAIN_GODAN)), ("kuru", lambda t: t == KURU),
    ("suru", lambda t: t.contains(SURU_AUX) | t.isin(SURU_SPECIAL, SURU_INCLUDED)), ("aru", lambda t: t == ARU), ("adj-i", lambda t: t.isin("adjective (keiyoushi)", "adjective (keiyoushi) - yoi/ii class")),
)


def rules() -> list[tuple[str, str, int, str, int, str]]:
    """(paradigm, ending, ord, form, drop, suffix): every inflection as "drop so many characters, then append"."""
    out: list[tuple[str, str, int, str, int, str]] = []

    def add(paradigm: str, ending: str, forms, drop: int, cells: dict[str, str] | None = None) -> None:
        for n, (name, suffix) in enumerate(forms):
            out.append((paradigm, ending, n, name, 0, "") if suffix is None else (paradigm, ending, n, name, drop, suffix.format(**(cells or {}))))

    for paradigm in ("godan", *GODAN_SPECIAL):
        for ending, cells in (GODAN | dict([GODAN_SPECIAL[paradigm]]) if paradigm in GODAN_SPECIAL else GODAN).items():
            add(paradigm, ending, GODAN_FORMS, 1, dict(zip("iateEo", cells.split())))
    add("ichidan", "る", ICHIDAN_FORMS, 1)
    add("ichidan-kureru", "る", [(n, "" if n == "Imperative" else s) for n, s in ICHIDAN_FORMS], 1)
    add("zuru", "ずる", [(n, s and "じ" + s) for n, s in ICHIDAN_FORMS], 2)
    add("kuru", "来る", KURU_FORMS, 2, {"p": "来", "o": "来", "k": "来"})
    add("kuru", "くる", KURU_FORMS, 2, {"p": "き", "o": "こ", "k": "く"})
    add("suru", "する", SURU_FORMS, 2)
    add("suru-included", "する", [f for f in SURU_FORMS if f[0] not in SURU_UNSAFE], 2)
    out += [("aru", "る", n, name, drop, suffix) for n, (name, drop, suffix) in enumerate(ARU_FORMS)]
    for ending, drop, stem in (("いい", 2, "よ"), ("", 1, "")):
        out += [("adj-i", ending, 0, "Dictionary", 0, ""), ("adj-i", ending, 1, "Polite present", 0, "です")]
        out += [("adj-i", ending, n, name, drop, stem + suffix) for n, (name, suffix) in enumerate(ADJECTIVE_FORMS, 2)]
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "paradigm string, ending string, ord int, form string, drop int, suffix string")


def family(pos: Column) -> Column:
    """The paradigm of an entry's part-of-speech texts; null if it doesn't inflect."""
    found = [F.when(F.exists(pos, test), F.lit(name)) for name, test in CLASSES]
    return F.coalesce(*found)


def paradigm(pos: Column) -> Column:
    """The family with its special class."""
    has = lambda t: F.array_contains(pos, t)
    fam = family(pos)
    return (
        F.when((fam == "godan") & has(IKU), F.lit("godan-iku")).when((fam == "godan") & has(SPECIAL_U), F.lit("godan-u")).when((fam == "ichidan") & has(KURERU), F.lit("ichidan-kureru"))
        .when((fam == "suru") & has(SURU_INCLUDED) & ~has(SURU_AUX) & ~has(SURU_SPECIAL), F.lit("suru-included")).otherwise(fam)
    )


def ending_of(kind: Column, spelling: Column) -> Column:
    """The ending by which a spelling's rules are found."""
    return (
        F.when(kind.isin("zuru", "kuru", "suru", "suru-included"), F.right(spelling, F.lit(2)))
        .when(kind == "adj-i", F.when(spelling.endswith("いい"), F.lit("いい")).otherwise(F.lit(""))).otherwise(F.right(spelling, F.lit(1)))
    )


def conjugated(words: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ord, form, surface, kana) of each word (id, pos array<string>, kanji, kana) that conjugates.

    The written form's table gives the rows; the reading's gives ``kana`` by form name.  A spelling without rules is left out.
    """
    kind = paradigm(F.col("pos"))
    rows = words.select(id_col, "kanji", "kana", kind.alias("paradigm")).where(F.col("paradigm").isNotNull() & ~(F.col("paradigm").startswith("godan") & F.coalesce(F.col("kana") == "ござる", F.lit(False))))
    suru = F.col("paradigm").startswith("suru")

    def spelt(c: str) -> Column:
        form = F.when(F.col(c) != "", F.col(c))
        added = F.when(F.coalesce(F.col("kana").endswith("する"), F.lit(False)), F.lit(None)).otherwise(F.concat(form, F.lit("する")))
        return F.when(suru & ~form.endswith("する"), added).otherwise(form)

    spellings = rows.select(id_col, "paradigm", F.posexplode(F.array_distinct(F.array_compact(F.array(spelt("kanji"), spelt("kana"))))).alias("n", "spelling"))
    spellings = spellings.withColumn("ending", ending_of(F.col("paradigm"), F.col("spelling"))).where("length(spelling) > 1 or paradigm <> 'adj-i'")
    # a few hundred rules
    cells = spellings.join(F.broadcast(rule_table(words.sparkSession)), ["paradigm", "ending"])
    cells = cells.withColumn("cell", F.concat(F.expr("substring(spelling, 1, length(spelling) - drop)"), "suffix"))
    # a word has at most two spellings: the first with rules leads
    both = cells.groupBy(id_col, "ord", "form").agg(F.min(F.struct("n", "cell")).alias("one"), F.max(F.struct("n", "cell")).alias("two"))
    return both.select(id_col, "ord", "form", F.col("one.cell").alias("surface"), F.when(F.col("two.n") > F.col("one.n"), F.col("two.cell")).alias("kana"))


def tables(words: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, inflected_forms, infl_forms): the rows as an array, and the flat lookup keys."""
    rows = conjugated(words, id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "form", "surface", "kana"))).alias("r"))
    forms = F.transform("r", lambda x: F.struct(x["form"].alias("form"), x["surface"].alias("surface"), x["kana"].alias("kana")))
    flat = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("r", lambda x: x["surface"]), F.transform("r", lambda x: x["kana"])))))
    return rows.select(id_col, forms.alias("inflected_forms"), flat.alias("infl_forms"))
