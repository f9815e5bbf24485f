"""Text operators over small Japanese fixtures with expected rows."""

from __future__ import annotations
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexloom.functions import japanese as J
from lexloom.operators import conjugation, segmentation
from lexloom.sources import tables
from lexloom.plans.registry import Registry

query = Registry()


@query("""
WITH d(k, c) AS (VALUES (1, '一'), (2, '二'), (3, '三'), (4, '四'), (5, '五'), (6, '六'), (7, '七'), (8, '八'), (9, '九'))
SELECT n, CASE WHEN n BETWEEN 1 AND 9999 THEN coalesce(a.c || '千', '') || coalesce(b.c || '百', '') || CASE WHEN n // 10 % 10 = 1 THEN '十' ELSE coalesce(x.c || '十', '') END || coalesce(y.c, '') ELSE '' END AS numeral
FROM range(0, 10050) r(n) LEFT JOIN d a ON a.k = n // 1000 LEFT JOIN d b ON b.k = n // 100 % 10 LEFT JOIN d x ON x.k = n // 10 % 10 LEFT JOIN d y ON y.k = n % 10""")
def numeral(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(10050).select(F.col("id").alias("n"), J.kanji_number(F.col("id")).alias("numeral"))


_SOLO = ", ".join(f"('{u}', {n}, '{r}')" for u, t in J.COUNTER_SOLO.items() for n, r in t.items())


_WHOLE = ", ".join(f"('{u}', {n}, '{r}')" for (u, n), r in J.COUNTER_WHOLE.items())


@query(f"""
WITH units(counter) AS (VALUES ('日'), ('人'), ('時'), ('分'), ('歳'), ('本')), solo(u, k, r) AS (VALUES {_SOLO}, {_WHOLE}),
tens(k, r) AS (VALUES {", ".join(f"({k}, '{r}')" for k, r in enumerate(J.TENS, 1))}), tails(k, r) AS (VALUES (3, 'みっか'), (4, 'よっか'))
SELECT n::VARCHAR AS num, counter, CASE WHEN n = 0 THEN '' ELSE coalesce(s.r, CASE WHEN counter = '日' AND n > 10 AND n < 100 THEN t.r || l.r END, '') END AS reading
FROM range(0, 130) x(n) CROSS JOIN units LEFT JOIN solo s ON s.u = counter AND s.k = n LEFT JOIN tens t ON t.k = n // 10 LEFT JOIN tails l ON l.k = n % 10""")
def counter_reading(spark: SparkSession, d: str) -> DataFrame:
    units = F.explode(F.array(*map(F.lit, "日人時分歳本"))).alias("counter")
    return spark.range(130).select(F.col("id").cast("string").alias("num"), units).select("num", "counter", J.counter_reading(F.col("num"), F.col("counter")).alias("reading"))


#: Sample words for the conjugation tables: (id, part-of-speech texts, written form, reading).
VERBS = [
    (1, ["Godan verb with 'ku' ending"], "書く", "かく"), (2, ["Ichidan verb", "auxiliary verb"], "見る", "みる"), (3, [conjugation.IKU], "行く", "いく"), (4, [conjugation.KURU], "連れて来る", "つれてくる"), (5, ["noun", conjugation.SURU_AUX], "勉強", "べんきょう"),
    (6, [conjugation.SURU_INCLUDED], "気がする", "きがする"), (7, ["adjective (keiyoushi)"], "楽しい", "たのしい"), (8, ["adjective (keiyoushi) - yoi/ii class"], None, "かっこいい"), (9, [conjugation.ARU], "有る", "ある"), (10, [conjugation.ZURU], "信ずる", "しんずる"),
    (11, [conjugation.KURERU], None, "くれる"), (12, [conjugation.SPECIAL_U], "問う", "とう"), (13, ["Godan verb with 'ru' ending"], "御座る", "ござる"), (14, ["noun"], "犬", "いぬ"), (15, [conjugation.SURU_SPECIAL], "愛する", "あいする"), (16, [conjugation.KURU], "来る", "くる"),
]


def _verb_sql() -> str:
    kinds = {1: "godan", 2: "ichidan", 3: "godan-iku", 4: "kuru", 5: "suru", 6: "suru-included", 7: "adj-i", 8: "adj-i", 9: "aru", 10: "zuru", 11: "ichidan-kureru", 12: "godan-u", 15: "suru", 16: "kuru"}
    q = lambda x: "NULL" if x is None else f"'{x}'"
    forms = [(i, kinds[i], n, s + ("する" if kinds[i].startswith("suru") and not s.endswith("する") else "")) for i, _, kanji, kana in VERBS if i in kinds for n, s in enumerate(x for x in (kanji, kana) if x)]
    rules = ", ".join(f"('{p}', '{e}', {o}, '{f}', {n}, '{s}')" for p, e, o, f, n, s in conjugation.rules())
    return f"""WITH rules(paradigm, ending, ord, form, cut, suffix) AS (VALUES {rules}), words(id, paradigm, n, s) AS (VALUES {", ".join(f"({i}, '{k}', {n}, {q(s)})" for i, k, n, s in forms)}),
cells AS (SELECT id, n, ord, form, left(s, length(s) - cut) || suffix AS cell, row_number() OVER (PARTITION BY id, n, ord ORDER BY length(ending) DESC) AS best FROM words JOIN rules USING (paradigm) WHERE ends_with(s, ending))
SELECT a.id, a.ord, a.form, a.cell AS surface, b.cell AS kana FROM cells a LEFT JOIN cells b ON a.id = b.id AND a.form = b.form AND b.n = 1 AND b.best = 1 WHERE a.n = 0 AND a.best = 1"""


@query(_verb_sql())
def conjugation_table(spark: SparkSession, d: str) -> DataFrame:
    return conjugation.conjugated(spark.createDataFrame(VERBS, "id long, pos array<string>, kanji string, kana string"))


_M = "array<struct<surf:string,pos:string,pos_sub:string,pos_sub2:string,ctype:string,cform:string,lemma:string,norm:string,reading:string>>"


SENTENCES = [
    (1, "犬を食べました", [("犬", "名詞", "普通名詞", "一般", "*", "*", "犬", "犬", "いぬ"), ("を", "助詞", "格助詞", "*", "*", "*", "を", "を", "を"), ("食べ", "動詞", "一般", "*", "下一段", "連用形", "食べる", "食べる", "たべ"), ("まし", "助動詞", "*", "*", "助動詞-マス", "連用形", "ます", "ます", "まし"), ("た", "助動詞", "*", "*", "助動詞-タ", "終止形", "た", "た", "た")]),
    (2, "2日に行っています", [("2", "名詞", "数詞", "*", "*", "*", "2", "2", "に"), ("日", "接尾辞", "名詞的", "助数詞", "*", "*", "日", "日", "か"), ("に", "助詞", "格助詞", "*", "*", "*", "に", "に", "に"), ("行っ", "動詞", "非自立可能", "*", "五段", "連用形", "行く", "行く", "いっ"), ("て", "助詞", "接続助詞", "*", "*", "*", "て", "て", "て"), ("い", "動詞", "非自立可能", "*", "上一段", "連用形", "いる", "いる", "い"), ("ます", "助動詞", "*", "*", "助動詞-マス", "終止形", "ます", "ます", "ます")]),
    (3, "精進料理について", [("精進", "名詞", "普通名詞", "サ変可能", "*", "*", "精進", "精進", "しょうじん"), ("料理", "名詞", "普通名詞", "サ変可能", "*", "*", "料理", "料理", "りょうり"), ("に", "助詞", "格助詞", "*", "*", "*", "に", "に", "に"), ("つい", "動詞", "一般", "*", "五段", "連用形", "つく", "つく", "つい"), ("て", "助詞", "接続助詞", "*", "*", "*", "て", "て", "て")]),
]


LEXICON = [("犬", "犬", "いぬ", ["dog"]), ("食べる", "食べる", "たべる", ["to eat"]), ("日", "日", "ひ", ["Sunday"]), ("日", "日", "か", ["counter for days"]), ("行く", "行く", "いく", ["to go"]), ("精進", "精進", "しょうじん", ["devotion"]), ("料理", "料理", "りょうり", ["cooking"]), ("精進料理", "精進料理", "しょうじんりょうり", ["vegetarian cuisine"])]


@query()
def morph_segment(spark: SparkSession, d: str) -> DataFrame:
    index = spark.createDataFrame([(f, n, k, r, m, True, 4.0) for n, (f, k, r, m) in enumerate(LEXICON)], "form string, ord long, kanji_form string, reading string, meanings array<string>, is_common boolean, wf_score double")
    return segmentation.segment_sentences(spark.createDataFrame(SENTENCES, f"id long, sentence string, tokens {_M}"), index)


#: One token: (surface, part of speech, its two subdivisions, conjugation type, dictionary form, usual spelling, reading).
_NOUN, _AUX, _PART, _VERB = ("名詞", "普通名詞", "一般", "*"), "助動詞", "助詞", "動詞"


def _token(surf: str, kind: tuple[str, ...], reading: str, lemma: str = "", norm: str = "") -> tuple:
    pos, sub, sub2, ctype = (*kind, *["*"] * 4)[:4]
    return (surf, pos, sub, sub2, ctype, "*", lemma or surf, norm or lemma or surf, reading)


def _n(surf: str, reading: str) -> tuple:
    return _token(surf, _NOUN, reading)


_DESU, _DA, _TA = (_token("です", (_AUX, "*", "*", "助動詞-デス"), "です"), _token("だっ", (_AUX, "*", "*", "助動詞-ダ"), "だっ", "だ"), _token("た", (_AUX, "*", "*", "助動詞-タ"), "た"))


_TWO, _DAY = _token("2", ("名詞", "数詞"), "に"), _token("日", ("接尾辞", "名詞的", "助数詞"), "か")


_P = lambda surf, reading="": _token(surf, (_PART,), reading or surf)


MORE_SENTENCES = [
    (4, "学生です", [_n("学生", "がくせい"), _DESU]),
    (5, "学生だった", [_n("学生", "がくせい"), _DA, _TA]),
    (6, "静かな部屋です", [_token("静か", ("形状詞", "一般"), "しずか"), _token("な", (_AUX, "*", "*", "助動詞-ダ"), "な", "だ"), _n("部屋", "へや"), _DESU]),
    (7, "学生じゃないです", [_n("学生", "がくせい"), _token("じゃ", (_AUX, "*", "*", "助動詞-ダ"), "じゃ", "だ"), _token("ない", ("形容詞", "非自立可能"), "ない"), _DESU]),
    (8, "2日です", [_TWO, _DAY, _DESU]),
    (9, "休んだ", [_token("休ん", (_VERB, "一般"), "やすん", "休む"), _token("だ", (_AUX, "*", "*", "助動詞-タ"), "だ", "た")]),
    (10, "山で", [_n("山", "やま"), _token("で", (_AUX, "*", "*", "助動詞-ダ"), "で", "だ")]),
    (11, "食べようとして", [_token("食べよう", (_VERB, "一般"), "たべよう", "食べる"), _P("と"), _token("し", (_VERB,), "し", "する"), _P("て")]),
    (12, "学生として", [_n("学生", "がくせい"), _P("と"), _token("し", (_VERB,), "し", "する"), _P("て")]),
    (13, "犬とともに", [_n("犬", "いぬ"), _P("と"), _n("とも", "とも"), _P("に")]),
    (14, "ジョンが走る", [_token("ジョン", ("名詞", "固有名詞", "人名"), "じょん"), _P("が"), _token("走る", (_VERB,), "はしる")]),
    (15, "山、川", [_n("山", "やま"), _token("、", ("補助記号",), "、"), _n("川", "かわ")]),
    (16, "山川の東", [_n("山", "やま"), _n("川", "かわ"), _P("の"), _n("東", "ひがし")]),
    (17, "日が", [_n("日", "にち"), _P("が")]),
    (18, "いい犬", [_token("いい", ("形容詞", "非自立可能"), "いい", "いい", "良い"), _n("犬", "いぬ")]),
    (19, "犬のため", [_n("犬", "いぬ"), _P("の"), _n("ため", "ため")]),
    (20, "1234が", [_token("1234", ("名詞", "数詞"), "いち"), _P("が")]),
    (21, "田中", [_n("田中", "たなか")]),
    (22, "犬 dog", [_n("犬", "いぬ")]),
    (23, "精進料理", [_n("精進", "しょうじん"), _n("料理", "りょうり")]),
    (24, "犬、山", [("犬", "名詞", None, None, None, None, None, None, "いぬ"), ("、", "補助記号", None, None, None, None, None, None, None), ("山", "名詞", None, None, None, None, None, None, None)]),
    (25, "して働く", [_token("し", (_VERB,), "し", "する"), _P("て"), _token("働く", (_VERB,), "はたらく")]),
]


MORE_LEXICON = [
    ("学生", "学生", "がくせい", ["student"]), ("静か", "静か", "しずか", ["quiet"]), ("部屋", "部屋", "へや", ["room"]), ("休む", "休む", "やすむ", ["to rest"]), ("山", "山", "やま", ["mountain"]), ("川", "川", "かわ", ["river"]), ("山川", "山川", "やまかわ", ["mountains and rivers"]),
    ("走る", "走る", "はしる", ["to run"]), ("東", "東", "ひがし", ["east"]), ("東", "東", "あずま", ["eastern Japan"]), ("いい", "謂", "いい", ["what was said"]), ("いい", "飯", "いい", ["cooked rice"]), ("良い", "良い", "いい", ["good"]), ("働く", "働く", "はたらく", ["to work"]),
]


def _chips_sql() -> str:
    """The chips by hand: (sentence, place, text, reading, meanings, lines, stem)."""
    copula, casual, nai, past = "polite copula", "casual copula — is / am / are", "negative ending", "past tense"
    rows = [
        (1, 0, "犬", "いぬ", "dog", "", ""), (1, 1, "を", "お", "object particle", "", ""), (1, 2, "食べました", "たべました", f"to eat/polite ending/{past}", f"食べ→食べる — to eat//まし — polite ending//た — {past}", "食べる=たべる"),
        (2, 0, "2日", "ふつか", "2 · counter for days", "", ""), (2, 1, "に", "に", "location / time particle", "", ""), (2, 2, "行っています", "いっています", "to go/~ing / is ~ (progressive or continuing state)/polite ending", "行っ→行く — to go//て — particle//い — ~ing / is ~ (progressive or continuing state)//ます — polite ending", "行く=いく"),
        (3, 0, "精進料理", "しょうじんりょうり", "vegetarian cuisine", "", ""), (3, 1, "について", "について", "regarding ~; about ~", "", ""),
        (4, 0, "学生", "がくせい", "student", "", ""), (4, 1, "です", "です", copula, "", ""),
        (5, 0, "学生", "がくせい", "student", "", ""), (5, 1, "だった", "だった", f"{casual}/{past}", f"だっ — {casual}//た — {past}", ""),
        (6, 0, "静かな", "しずかな", f"quiet/{casual}", f"静か — quiet//な — {casual}", "静か=しずか"), (6, 1, "部屋", "へや", "room", "", ""), (6, 2, "です", "です", copula, "", ""),
        (7, 0, "学生じゃ", "がくせいじゃ", f"student/{casual}", f"学生 — student//じゃ — {casual}", "学生=がくせい"), (7, 1, "ないです", "ないです", copula, f"ない//です — {copula}", ""),
        (8, 0, "2日です", "ふつかです", f"2 · counter for days/{copula}", f"2 — 2//日 — counter for days//です — {copula}", ""),
        (9, 0, "休んだ", "やすんだ", f"to rest/{past}", f"休ん→休む — to rest//だ — {past}", "休む=やすむ"),
        (10, 0, "山で", "やまで", "mountain/casual copula (continuative) — or で at/by-means-of particle", "山 — mountain//で — casual copula (continuative) — or で at/by-means-of particle", "山=やま"),
        (11, 0, "食べよう", "たべよう", "to eat", "", ""), (11, 1, "と", "と", "and / with", "", ""), (11, 2, "し", "し", "", "", ""), (11, 3, "て", "て", "particle", "", ""),
        (12, 0, "学生", "がくせい", "student", "", ""), (12, 1, "として", "として", "as ~; in the capacity of ~", "", ""),
        (13, 0, "犬", "いぬ", "dog", "", ""), (13, 1, "とともに", "とともに", "together with ~; along with ~", "", ""),
        (14, 0, "ジョン", "じょん", "", "", ""), (14, 1, "が", "が", "subject particle", "", ""), (14, 2, "走る", "はしる", "to run", "", ""),
        (15, 0, "山", "やま", "mountain", "", ""), (15, 1, "川", "かわ", "river", "", ""),
        (16, 0, "山川", "やまかわ", "mountains and rivers", "", ""), (16, 1, "の", "の", "possessive particle", "", ""), (16, 2, "東", "ひがし", "east", "", ""),
        (17, 0, "日", "にち", "Sunday/counter for days", "ひ — Sunday//か — counter for days", ""), (17, 1, "が", "が", "subject particle", "", ""),
        (18, 0, "いい", "いい", "good", "", ""), (18, 1, "犬", "いぬ", "dog", "", ""),
        (19, 0, "犬", "いぬ", "dog", "", ""), (19, 1, "の", "の", "possessive particle", "", ""), (19, 2, "ため", "ため", "for the sake of ~ / because of ~", "", ""),
        (20, 0, "1234", "", "1,234", "", ""), (20, 1, "が", "が", "subject particle", "", ""), (21, 0, "田中", "たなか", "", "", ""), (22, 0, "犬", "", "", "", ""), (22, 1, "dog", "", "", "", ""),
        (24, 0, "犬", "いぬ", "", "", ""), (24, 1, "山", "", "", "", ""), (25, 0, "し", "し", "", "", ""), (25, 1, "て", "て", "particle", "", ""), (25, 2, "働く", "はたらく", "to work", "", ""),
    ]
    from fixture_queries import expected

    return expected("id, pos, text, reading, meanings, lines, stem", *rows)


@query(_chips_sql())
def morph_chips(spark: SparkSession, d: str) -> DataFrame:
    """Sentences parsed from morphemes: tails, copulas, counters, collocations, compounds, names, numbers, several candidates, missing fields."""
    index = spark.createDataFrame([(f, n, k, r, m, True, 4.0) for n, (f, k, r, m) in enumerate(LEXICON + MORE_LEXICON)], "form string, ord long, kanji_form string, reading string, meanings array<string>, is_common boolean, wf_score double")
    found = segmentation.segment_sentences(spark.createDataFrame(SENTENCES + MORE_SENTENCES, f"id long, sentence string, tokens {_M}"), index)
    shown = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    return found.select("id", "pos", "text", "reading", shown("meanings", "/").alias("meanings"), shown("options", "//").alias("lines"), F.coalesce(F.concat("stem.kanji_form", F.lit("="), "stem.reading"), F.lit("")).alias("stem"))


@query("""SELECT * FROM (VALUES (1, '犬 (犬, 名詞)' || chr(10) || 'を (を, 助詞)' || chr(10) || '食べ (食べる, 動詞)' || chr(10) || 'まし (ます, 助動詞)' || chr(10) || 'た (た, 助動詞)'), (4, '学生 (学生, 名詞)' || chr(10) || 'です (です, 助動詞)')) t(id, hint)""")
def morph_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(SENTENCES + MORE_SENTENCES, f"id long, sentence string, tokens {_M}").where("id in (1, 4)")
    return rows.select("id", segmentation.morph_hint(F.col("tokens")).alias("hint"))


#: Sample words and their forms written out: form name, written form, reading.
FORMS = {
    ("Godan verb with 'ku' ending", "書く", "かく"): [("Dictionary", "書く", "かく"), ("Polite present", "書きます", "かきます"), ("Polite negative", "書きません", "かきません"), ("Polite past", "書きました", "かきました"), ("Polite past negative", "書きませんでした", "かきませんでした"), ("Negative", "書かない", "かかない"), ("Past", "書いた", "かいた"), ("Past negative", "書かなかった", "かかなかった"), ("Te-form", "書いて", "かいて"), ("Potential", "書ける", "かける"), ("Passive", "書かれる", "かかれる"), ("Causative", "書かせる", "かかせる"), ("Volitional", "書こう", "かこう"), ("Imperative", "書け", "かけ"), ("Conditional", "書けば", "かけば")],
    ("Godan verb - Iku/Yuku special class", "行く", "いく"): [("Past", "行った", "いった"), ("Te-form", "行って", "いって"), ("Negative", "行かない", "いかない"), ("Volitional", "行こう", "いこう")],
    ("Godan verb with 'u' ending (special class)", "問う", "とう"): [("Past", "問うた", "とうた"), ("Te-form", "問うて", "とうて"), ("Negative", "問わない", "とわない")],
    ("Godan verb with 'mu' ending", "読む", "よむ"): [("Past", "読んだ", "よんだ"), ("Te-form", "読んで", "よんで"), ("Imperative", "読め", "よめ"), ("Polite present", "読みます", "よみます")],
    ("Godan verb with 'su' ending", "話す", "はなす"): [("Past", "話した", "はなした"), ("Te-form", "話して", "はなして"), ("Potential", "話せる", "はなせる")],
    ("Ichidan verb", "見る", "みる"): [("Dictionary", "見る", "みる"), ("Polite past", "見ました", "みました"), ("Negative", "見ない", "みない"), ("Past", "見た", "みた"), ("Te-form", "見て", "みて"), ("Potential / Passive", "見られる", "みられる"), ("Causative", "見させる", "みさせる"), ("Volitional", "見よう", "みよう"), ("Imperative", "見ろ", "みろ"), ("Conditional", "見れば", "みれば")],
    ("Ichidan verb - kureru special class", None, "くれる"): [("Imperative", "くれ", None), ("Past", "くれた", None)],
    ("Ichidan verb - zuru verb (alternative form of -jiru verbs)", "信ずる", "しんずる"): [("Dictionary", "信ずる", "しんずる"), ("Past", "信じた", "しんじた"), ("Negative", "信じない", "しんじない")],
    ("Kuru verb - special class", "来る", "くる"): [("Negative", "来ない", "こない"), ("Past", "来た", "きた"), ("Imperative", "来い", "こい"), ("Conditional", "来れば", "くれば"), ("Volitional", "来よう", "こよう")],
    ("Kuru verb - special class", "連れて来る", "つれてくる"): [("Negative", "連れて来ない", "つれてこない"), ("Past", "連れて来た", "つれてきた")],
    ("takes the aux. verb suru", "勉強", "べんきょう"): [("Dictionary", "勉強する", "べんきょうする"), ("Past", "勉強した", "べんきょうした"), ("Potential", "勉強できる", "べんきょうできる"), ("Imperative", "勉強しろ", "べんきょうしろ")],
    ("suru verb - included", "気がする", "きがする"): [("Past", "気がした", "きがした"), ("Negative", "気がしない", "きがしない"), ("Potential", None, None), ("Imperative", None, None)],
    ("Godan verb with 'ru' ending (irregular verb)", "有る", "ある"): [("Negative", "ない", "ない"), ("Past", "有った", "あった"), ("Volitional", "有ろう", "あろう"), ("Potential", None, None)],
    ("adjective (keiyoushi)", "楽しい", "たのしい"): [("Dictionary", "楽しい", "たのしい"), ("Polite present", "楽しいです", "たのしいです"), ("Negative", "楽しくない", "たのしくない"), ("Past", "楽しかった", "たのしかった"), ("Past negative", "楽しくなかった", "たのしくなかった"), ("Te-form", "楽しくて", "たのしくて"), ("Adverbial", "楽しく", "たのしく"), ("Conditional", "楽しければ", "たのしければ")],
    ("adjective (keiyoushi) - yoi/ii class", None, "かっこいい"): [("Negative", "かっこよくない", None), ("Past", "かっこよかった", None), ("Dictionary", "かっこいい", None)],
    ("noun", "犬", "いぬ"): [("Dictionary", None, None), ("Past", None, None)],
    ("Godan verb with 'ru' ending", "御座る", "ござる"): [("Dictionary", None, None)],
    ("Godan verb - Aru special class", "下さる", "くださる"): [("Dictionary", None, None)],
}


def _forms_sql() -> str:
    from fixture_queries import expected

    return expected("id, form, surface, kana", *[(n, *f) for n, forms in enumerate(FORMS.values()) for f in forms])


@query(_forms_sql())
def conjugated_forms(spark: SparkSession, d: str) -> DataFrame:
    """Named forms of words of every class; forms that a word doesn't have, and words that don't conjugate, are null."""
    words = spark.createDataFrame([(n, [pos], kanji, kana) for n, (pos, kanji, kana) in enumerate(FORMS)], "id long, pos array<string>, kanji string, kana string")
    wanted = spark.createDataFrame([(n, f[0]) for n, forms in enumerate(FORMS.values()) for f in forms], "id long, form string")
    return wanted.join(conjugation.conjugated(words), ["id", "form"], "left").select("id", "form", "surface", "kana")


@query("""SELECT * FROM (VALUES (0, 'ichidan', 'ichidan'), (1, 'godan', 'godan'), (2, 'godan', 'godan-iku'), (3, 'godan', 'godan-u'), (4, 'kuru', 'kuru'), (5, 'suru', 'suru'), (6, 'suru', 'suru-included'), (7, 'aru', 'aru'), (8, 'zuru', 'zuru'), (9, 'ichidan', 'ichidan-kureru'), (10, 'adj-i', 'adj-i'), (11, NULL, NULL), (12, NULL, NULL), (13, 'ichidan', 'ichidan')) t(id, family, paradigm)""")
def word_families(spark: SparkSession, d: str) -> DataFrame:
    """The paradigm of part-of-speech texts: of several the first by class order."""
    texts = [
        ["Ichidan verb"], ["Godan verb with 'ru' ending"], ["Godan verb - Iku/Yuku special class"], ["Godan verb with 'u' ending (special class)"], ["Kuru verb - special class"], ["noun or participle which takes the aux. verb suru"], ["suru verb - included"],
        ["Godan verb with 'ru' ending (irregular verb)"], ["Ichidan verb - zuru verb (alternative form of -jiru verbs)"], ["Ichidan verb - kureru special class"], ["adjective (keiyoushi) - yoi/ii class"], ["noun", "transitive verb"], ["Godan verb - Aru special class"], ["auxiliary verb", "Ichidan verb", "transitive verb"],
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, pos array<string>")
    return rows.select("id", conjugation.family(F.col("pos")).alias("family"), conjugation.paradigm(F.col("pos")).alias("paradigm"))


WORDS = [("食べる", "たべる"), ("お茶", "おちゃ"), ("犬", "いぬ"), ("ねこ", "ねこ"), ("明日", "あした"), ("話し合い", "はなしあい"), ("東京", None)]


@query("""SELECT * FROM (VALUES ('食べる', '食[た]べる'), ('お茶', 'お茶[ちゃ]'), ('犬', '犬[いぬ]'), ('ねこ', 'ねこ'), ('明日', '明日[あした]'), ('話し合い', '話し合[はなしあ]い'), ('東京', '東京')) t(word, ruby)""")
def furigana(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(J.furigana("word", "reading"), lambda p: F.when(p["rt"].isNull(), p["text"]).otherwise(F.concat(p["text"], F.lit("["), p["rt"], F.lit("]"))))
    return spark.createDataFrame(WORDS, "word string, reading string").select("word", F.array_join(parts, "").alias("ruby"))


QUERIES, ORACLE_SQL = query.queries, query.sql
