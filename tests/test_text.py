from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.functions import japanese as J
from lexloom.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, key", [("Dog (Canis lupus)", "dog"), ("(arch.) thing", ""), ("  To  Eat! ", "to eat"), ("　a　b,;", "a b"), ("", "")])
def test_gloss_key(spark, text, key):
    assert one(spark, text, T.gloss_key) == key


def test_gloss_keys(spark):
    assert one(spark, "to eat", T.gloss_keys) == ["to eat", "eat"]
    assert one(spark, "(x)", T.gloss_keys) == []


@pytest.mark.parametrize("query, asked", [("How do you say cat in Japanese?", "cat"), ("what's the word for an apple?", "apple"), ("meaning of the sea", "sea"), ("a word that means very tired", "very tired"), ("cat", None), ("犬とは", None)])
def test_heuristic_rewrite(spark, query, asked):
    assert one(spark, query, T.heuristic_rewrite) == asked


def test_rewrite_ladder(spark):
    ja = F.array(F.lit("子犬"))
    auto = lambda c: T.rewrite(c, "auto", F.lit("puppy"), ja)
    assert one(spark, "a baby dog", auto) == ("puppy", "llm", ["子犬"])
    assert one(spark, "baby dog", auto) == ("baby dog", "none", [])
    assert one(spark, "how to say baby dog", auto)[:2] == ("puppy", "llm")
    assert one(spark, "Big Dog?", lambda c: T.rewrite(c, "off")) == ("Big Dog?", "none", [])
    assert one(spark, "「犬」。", T.rewrite)[:2] == ("「犬」", "none")


@pytest.mark.parametrize("reply, english, japanese", [('```json\n{"english": "Cat", "japanese": ["猫", "ネコ (x)", "neko"]}\n```', "cat", ["猫", "ネコ"]), ('{"gloss": "dog", "ja": "犬、イヌ"}', "dog", ["犬", "イヌ"]), ("sea\nmore", "sea", []), ("one two three four five", "", [])])
def test_parse_reply(spark, reply, english, japanese):
    assert one(spark, reply, T.parse_reply) == (english, japanese)


@pytest.mark.parametrize("query, route", [("犬 dog", "ja"), ("「犬」", "ja"), ("one two three", "en_word"), ("one two three four", "en_sentence"), ("abc 犬", "en_word")])
def test_route(spark, query, route):
    assert one(spark, query, T.route) == route


def test_guard(spark):
    assert one(spark, "a" * 151, T.too_long) and not one(spark, "a" * 150, T.too_long)
    assert one(spark, "犬" * 101, T.too_long) and not one(spark, "犬" * 100, T.too_long)


@pytest.mark.parametrize("n, text", [(25, "二十五"), (10, "十"), (111, "一百十一"), (1111, "一千一百十一"), (9999, "九千九百九十九"), (0, ""), (10000, "")])
def test_kanji_number(spark, n, text):
    assert one(spark, n, J.kanji_number, "int") == text


@pytest.mark.parametrize("num, unit, reading", [("2", "日", "ふつか"), ("14", "日", "じゅうよっか"), ("23", "日", "にじゅうみっか"), ("12", "日", ""), ("20", "歳", "はたち"), ("4", "時", "よじ"), ("02", "日", ""), ("x", "日", ""), ("1", "人", "ひとり")])
def test_counter_reading(spark, num, unit, reading):
    assert one(spark, num, lambda c: J.counter_reading(c, F.lit(unit))) == reading


def test_counter_spelling(spark):
    assert one(spark, "25日", J.counter_spelling) == "二十五日"
    assert one(spark, "25", J.counter_spelling) is None


def test_scripts(spark):
    assert one(spark, "𠀀", J.is_kanji) and not one(spark, "犬犬", J.is_kanji) and not one(spark, "あ", J.is_kanji)
    assert one(spark, "カタカナ", J.hiragana) == "かたかな"
    assert one(spark, "Lite版", T.has_separate_japanese) is False and one(spark, "x「語」", T.has_separate_japanese) is True
    assert one(spark, "𠀀", J.codepoint_hex) == "20000"


def test_ruby_and_chips(spark):
    assert [tuple(p) for p in one(spark, "お茶漬け", lambda c: J.furigana(c, F.lit("おちゃづけ")))] == [("お", None), ("茶漬", "ちゃづ"), ("け", None)]
    assert [tuple(p) for p in one(spark, "は", lambda c: J.chip_ruby(c, F.lit("わ")))] == [("は", "わ")]
    assert one(spark, "た.べる", J.reading_chip) == ("た", "べる") and one(spark, "イヌ", J.reading_chip) == ("イヌ", None)


def test_badges(spark):
    rows = one(spark, 7, lambda c: J.badges(c, F.lit(8), F.lit(2), F.lit(None).cast("int")), "int")
    assert [r.label for r in rows] == ["7 strokes", "Grade 8", "JLPT N2-N3"]


@pytest.mark.parametrize("n, lang, text", [("1234567", "en", "1,234,567"), ("1234567", "hi", "१२,३४,५६७"), ("999", "mr", "९९९"), ("1234.5", "en", "1,234.5")])
def test_numbers(spark, n, lang, text):
    assert one(spark, n, lambda c: T.localised_number(c, F.lit(lang))) == text


def test_translation_is_one_pass(spark):
    table, other = F.create_map(F.lit("k"), F.lit("a {x} b {y}")), F.create_map(F.lit("x"), F.lit("{y}"), F.lit("y"), F.lit("2"))
    assert one(spark, "k", lambda c: T.translated(F.lit("en"), c, table, table, other)) == "a {y} b 2"


@pytest.mark.parametrize("chain, hops, who", [("1, 2, 3", 1, "3"), ("1, 2, 3", 2, "2"), ("1", 2, "peer"), (None, 1, "peer"), ("1", 0, "peer")])
def test_client_key(spark, chain, hops, who):
    assert one(spark, chain, lambda c: T.client_key(c, F.lit("peer"), hops)) == who


def test_small_helpers(spark):
    assert one(spark, "//evil", T.safe_redirect) == "/" and one(spark, "/ok?x", T.safe_redirect) == "/ok?x"
    assert one(spark, "x", lambda c: T.int_or(c, 3)) == 3
    assert one(spark, None, T.hash_prefix) is None
    assert one(spark, "  a \n b ", T.checked_input) == ("a b", True)
