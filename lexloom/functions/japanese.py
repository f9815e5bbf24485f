"""Kana, kanji, numerals, counters, ruby and badges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: The ranges of kanji.
KANJI_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))
KANJI = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in KANJI_RANGES)
NUMERALS = "零一二三四五六七八九"
#: Units that may follow a number.
UNITS = "日|人|時|分|秒|歳|年|月|週|回|階|枚|円|匹|頭|台|杯|冊|本|個|度|番|号"
#: Irregular readings of numbers with units, up to ten and whole.
COUNTER_SOLO = {
    "日": {2: "ふつか", 3: "みっか", 4: "よっか", 7: "なのか", 9: "ここのか"},
    "人": {1: "ひとり", 2: "ふたり", 4: "よにん"},
    "時": {4: "よじ", 7: "しちじ", 9: "くじ"},
    "分": {1: "いっぷん", 3: "さんぷん", 4: "よんぷん", 6: "ろっぷん", 8: "はっぷん", 10: "じゅっぷん"},
}
COUNTER_WHOLE = {("日", 14): "じゅうよっか", ("日", 20): "はつか", ("歳", 20): "はたち"}
TENS = ("じゅう", "にじゅう", "さんじゅう", "よんじゅう", "ごじゅう", "ろくじゅう", "ななじゅう", "はちじゅう", "きゅうじゅう")
DAY_TAILS = {3: "みっか", 4: "よっか"}


def hiragana(c: Column | str) -> Column:
    """Katakana as hiragana."""
    return F.translate(col(c), "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))


def is_kanji(c: Column | str) -> Column:
    """One character, in one of the ranges."""
    return F.coalesce(col(c).rlike(f"^[{KANJI}]$"), F.lit(False))


def has_kanji(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[{KANJI}]"), F.lit(False))


def kanji_in(c: Column | str) -> Column:
    """The kanji of a text in order, each occurrence."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"([{KANJI}])"), F.lit(1))


def kanji_number(n: Column) -> Column:
    """1 to 9999 in numerals, with 一 before 百 and 千 but not before 十; empty outside."""

    def place(digit: Column, mark: str) -> Column:
        spelt = F.substr(F.lit(NUMERALS), digit + 1, F.lit(1))
        if mark == "十":
            spelt = F.when(digit == 1, F.lit("")).otherwise(spelt)
        return F.when(digit == 0, F.lit("")).otherwise(F.concat(spelt, F.lit(mark)))

    n = n.cast("int")
    digits = [(F.floor(n / d) % 10).cast("int") for d in (1000, 100, 10, 1)]
    return F.when(n.between(1, 9999), F.concat(*[place(d, m) for d, m in zip(digits, ("千", "百", "十", ""))])).otherwise(F.lit(""))


#: Every tabled reading by number and unit; the days from 11 to 99 follow from tens and tails.
COUNTER_READINGS = (
    {f"{n}{unit}": reading for unit, table in COUNTER_SOLO.items() for n, reading in table.items()}
    | {f"{10 * tens + tail}日": spoken + reading for tens, spoken in enumerate(TENS, 1) for tail, reading in DAY_TAILS.items()}
    | {f"{n}{unit}": reading for (unit, n), reading in COUNTER_WHOLE.items()}
)


def counter_reading(number: Column, counter: Column) -> Column:
    """The irregular reading of a number with a unit; empty where there is none."""
    table = F.create_map(*[F.lit(x) for pair in COUNTER_READINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.concat(number, counter)), F.lit(""))


def counter_spelling(c: Column | str) -> Column:
    """25日 as 二十五日; null if the text is no number with a unit.  An alias only where that is a headword."""
    pattern = rf"^(\d{{1,4}})({UNITS})$"
    spelt = kanji_number(F.regexp_extract(col(c), pattern, 1).try_cast("int"))
    return F.when(col(c).rlike(pattern) & (spelt != ""), F.concat(spelt, F.regexp_extract(col(c), pattern, 2)))


def number_gloss(c: Column | str) -> Column:
    """A number with its thousands marked; a decimal keeps its point."""
    from .text import western_number

    text = col(c)
    return western_number(F.when(text.contains("."), text.cast("double").cast("string")).otherwise(F.regexp_replace(text, r"^0+(?=\d)", "")))


def furigana(word: Column | str, reading: Column | str) -> Column:
    """array<struct<text,rt>>: kana shared at both ends stays outside the ruby."""
    w, r = col(word), col(reading)
    whole = F.array(F.struct(w.alias("text"), F.lit(None).cast("string").alias("rt")))
    shorter = F.least(F.length(w), F.length(r))

    def shared(a: Column, b: Column, most: Column) -> Column:
        """Leading characters that agree and are not kanji."""
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.struct(F.lit(0).alias("n"), (most > 0).alias("go")),
            lambda acc, k: F.struct((acc["n"] + _agree(acc["go"], a, b, k).cast("int")).alias("n"), _agree(acc["go"], a, b, k).alias("go")), lambda acc: acc["n"],
        )

    i = shared(w, r, shorter)
    j = shared(F.reverse(w), F.reverse(r), shorter - i)
    core_w, core_r = F.substr(w, i + 1, F.length(w) - i - j), F.substr(r, i + 1, F.length(r) - i - j)

    def part(text: Column, rt: Column | None = None) -> Column:
        return F.struct(text.alias("text"), (F.lit(None).cast("string") if rt is None else rt).alias("rt"))

    parts = F.array_compact(F.array(F.when(i > 0, part(F.substr(w, F.lit(1), i))), part(core_w, core_r), F.when(j > 0, part(F.right(w, j)))))
    split = F.when((core_w == "") | (core_r == ""), F.array(part(w, r))).otherwise(parts)
    return F.when(r.isNull() | (r == "") | (r == w) | ~has_kanji(w), whole).otherwise(split)


def _agree(go: Column, a: Column, b: Column, k: Column) -> Column:
    x = F.substr(a, k, F.lit(1))
    return go & (x == F.substr(b, k, F.lit(1))) & ~is_kanji(x)


def chip_ruby(surface: Column | str, reading: Column | str) -> Column:
    """Ruby of a segment; a kana segment whose reading differs is annotated as a whole."""
    s, r = col(surface), col(reading)
    whole = F.array(F.struct(s.alias("text"), r.alias("rt")))
    return F.when(~has_kanji(s) & (r != "") & (r != s), whole).otherwise(furigana(s, r))


def reading_chip(c: Column | str) -> Column:
    """た.べる as struct(stem, okurigana)."""
    return F.struct(F.substring_index(col(c), ".", 1).alias("stem"), F.when(col(c).contains("."), F.substr(col(c), F.instr(col(c), ".") + 1)).alias("okurigana"))


def grade_tip(grade: Column) -> Column:
    taught = F.concat(F.lit("taught in year "), grade.cast("string"), F.lit(" of primary school"))
    return F.when(grade <= 6, taught).when(grade == 8, F.lit("general use, taught in secondary school")).when(grade == 10, F.lit("for names; variant of a general-use character")).otherwise(F.lit("for names"))


#: The old four-level scale as shown, and the new levels on that scale.
OLD_LEVELS = {4: "N5", 3: "N4", 2: "N2-N3", 1: "N1"}
NEW_LEVELS = {"N5": 4, "N4": 3, "N3": 2, "N2": 2, "N1": 1}


def badges(strokes: Column, grade: Column, jlpt: Column, freq: Column) -> Column:
    """array<struct<label,tip,by,value>> of a character, without the fields it lacks (null or 0)."""

    def one(value: Column, label: Column, tip: Column, by: str | None) -> Column:
        return F.when(value.isNotNull() & (value != 0), F.struct(label.alias("label"), tip.alias("tip"), F.lit(by).cast("string").alias("by"), value.cast("int").alias("value")))

    level = F.coalesce(*[F.when(jlpt == k, F.lit(v)) for k, v in OLD_LEVELS.items()], F.concat(F.lit("N"), jlpt.cast("string")))
    return F.array_compact(F.array(
        one(strokes, F.concat(strokes.cast("string"), F.lit(" strokes")), F.lit("strokes in the standard order"), "strokes"),
        one(grade, F.concat(F.lit("Grade "), grade.cast("string")), grade_tip(grade), "grade"),
        one(jlpt, F.concat(F.lit("JLPT "), level), F.lit("proficiency level, N5 easiest"), "jlpt"),
        one(freq, F.concat(F.lit("Freq #"), freq.cast("string")), F.lit("rank in newspapers, 1 most common"), None),
    ))


def jlpt_scale(level: Column) -> Column:
    """A new level on the old scale; null if unknown."""
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in NEW_LEVELS.items()])


def codepoint_hex(c: Column | str) -> Column:
    """Five hex digits, as stroke files are named."""
    return F.format_string("%05x", F.ascii(col(c)))


def kana_label(kana: Column, romaji: Column, local: Column) -> Column:
    """A chart cell's label: the locale's transliteration (map kana -> text) where there is one, else the common one."""
    return F.coalesce(F.try_element_at(local, kana), romaji, kana)
