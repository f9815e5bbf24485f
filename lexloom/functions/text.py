"""Text normalisation, match keys and query routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of Japanese characters, and what may stand before the first of them.
JAPANESE = "぀-ヿ㐀-䶿一-鿿"
OPENING = " \t\r\n　\"'“”‘’「」『』（）()【】[]〜~・…"

#: What questions open with, by kind; who asks how to say something may close with "in japanese".
ASKING_HOW = [f"how {verb} {who} say" for verb in ("do", "would", "can") for who in ("you", "i", "we")] + ["how to say"]
ASKING_WHAT = [f"{opener} {the}{japanese}{noun} for" for opener in ("what's", "what is") for the in ("the ", "") for japanese in ("japanese ", "") for noun in ("word", "term", "verb", "noun", "adjective")]
NAMING = ["japanese for", "japanese word for", "japanese term for", "word for", "meaning of", "translate"]
DESCRIBING = [f"{article} {noun} {link}" for article in ("a", "an", "the") for noun in ("word", "term") for link in ("for", "meaning", "that means")]


def _frame(openers: list[str], closing: str = "", loose: bool = False) -> str:
    """A pattern of one of the openers and, as its group, what is asked for; ``loose`` openers may have any white space between words."""
    spoken = "|".join(r"\s+".join(o.split(" ")) if loose else o for o in openers)
    return rf"^(?:{spoken})\s+(.+{'?' if closing else ''}){closing}$"


#: Question frames, in the order in which they are tried.
FRAMES = (_frame(ASKING_HOW, r"(?:\s+in japanese)?"), _frame(ASKING_WHAT), _frame(NAMING), _frame(DESCRIBING, loose=True))
#: White space of every script: as characters to trim, and as a class for patterns (cheaper than Unicode classes by flag).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CLOSING = SPACES + "?!.。、"
ARTICLE = r"^(?:a|an|the)\s+"

#: Longest query, and longest Japanese query, in characters.
MAX_QUERY, MAX_JAPANESE = 150, 100


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def one_spaced(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(col(c), f"[{WS}]+", " "), F.lit(" "))


def n_words(c: Column | str) -> Column:
    """White-space separated words; 0 for a blank text."""
    s = one_spaced(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " ")))


def is_japanese(c: Column | str) -> Column:
    """The first character after opening signs is Japanese."""
    return F.coalesce(F.ltrim(col(c), F.lit(OPENING)).rlike(f"^[{JAPANESE}]"), F.lit(False))


def contains_japanese(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[{JAPANESE}]"), F.lit(False))


def has_separate_japanese(c: Column | str) -> Column:
    """A Japanese run at the start or after something that is neither letter nor digit."""
    return F.coalesce(col(c).rlike(rf"(?U)(?:^|[^\p{{L}}\p{{N}}])[{JAPANESE}]"), F.lit(False))


def gloss_key(c: Column | str) -> Column:
    """Lower case, cut at the first parenthesis, single blanks, no closing punctuation."""
    low = F.lower(stripped(c))
    key = F.when(low.contains("("), F.regexp_replace(low, rf"[{WS}]*\(.*", "")).otherwise(low)
    return F.rtrim(one_spaced(key), F.lit(SPACES + ",;:.!"))


def gloss_keys(c: Column | str) -> Column:
    """The key, and the key without a leading "to "; an empty key gives none."""
    return keys_of(gloss_key(c))


def keys_of(key: Column) -> Column:
    """The same from a key."""
    bare = F.when(key.startswith("to "), F.substr(key, F.lit(4)))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(key, bare)))


def normalise(c: Column | str) -> Column:
    """Trimmed, without closing punctuation, in lower case unless Japanese."""
    q = F.rtrim(stripped(c), F.lit(CLOSING))
    return F.when(is_japanese(q), q).otherwise(F.lower(q))


def heuristic_rewrite(c: Column | str) -> Column:
    """What a question-shaped query asks for; null where no frame fits."""
    q = normalise(c)
    # the frames as alternatives: the first that fits has the only group that matches
    any_frame = "(?U)" + "|".join(f"(?:{frame})" for frame in FRAMES)
    asked = F.when(q.rlike(any_frame), F.regexp_replace(q, any_frame, "".join(f"${n}" for n in range(1, len(FRAMES) + 1))))
    out = F.rtrim(F.regexp_replace(stripped(asked), f"(?U){ARTICLE}", ""), F.lit(CLOSING))
    return F.when(~is_japanese(c) & (out != ""), out)


def rewrite(c: Column | str, mode: str = "heuristic", english: Column | None = None, japanese: Column | None = None) -> Column:
    """struct(query, method, japanese): the rewriting ladder.

    ``mode`` is off, heuristic or auto; for auto, ``english`` and ``japanese`` are a provider's answer (columns), used where the
    query is long enough: two words after a heuristic match, three otherwise.
    """
    original = stripped(c)
    found = heuristic_rewrite(original)
    q = F.coalesce(found, normalise(original))
    none = F.array().cast("array<string>")

    def answer(query: Column, method: Column | str, candidates: Column = none) -> Column:
        return F.struct(query.alias("query"), (F.lit(method) if isinstance(method, str) else method).alias("method"), candidates.alias("japanese"))

    out = answer(q, F.when(found.isNotNull(), F.lit("heuristic")).otherwise(F.lit("none")))
    if mode == "auto":
        en = F.coalesce(english if english is not None else F.lit(None).cast("string"), F.lit(""))
        ja = F.coalesce(japanese if japanese is not None else F.lit(None).cast("array<string>"), none)
        asked = n_words(q) >= F.when(found.isNotNull(), F.lit(2)).otherwise(F.lit(3))
        used = asked & ((F.size(ja) > 0) | ((en != "") & (en != q)))
        out = F.when(used, answer(F.when(en != "", en).otherwise(q), "llm", ja)).otherwise(out)
    out = F.when(is_japanese(original), answer(normalise(original), "none")).otherwise(out)
    plain = answer(original, "none")
    return plain if mode == "off" else F.when(original == "", plain).otherwise(out)


def clean_english(c: Column) -> Column:
    """A provider's gloss: one to four words, else empty."""
    text = normalise(F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), '^"+|"+$', ""))
    return F.when(n_words(text).between(1, 4), text).otherwise(F.lit(""))


def clean_japanese(items: Column) -> Column:
    """A provider's headwords: list marks and closing parentheses removed, Japanese, at most 20 characters, three at most."""

    def one(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", "")
        x = F.regexp_replace(x, r"\s*[（(].*?[）)]\s*$", "")
        x = F.regexp_replace(stripped(x), "^[\"']+|[\"']+$", "")
        return stripped(F.rtrim(x, F.lit(CLOSING)))

    good = F.filter(F.transform(items, one), lambda x: (x != "") & is_japanese(x) & (F.length(x) <= 20) & ~x.rlike(r"(?U)\s"))
    return F.slice(F.array_distinct(good), 1, 3)


def parse_reply(c: Column | str) -> Column:
    """struct(english, japanese) of a provider's reply: JSON, fenced or not, or else its first line as the gloss."""
    text = stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    read = F.from_json(F.when(inner != "", inner), "english string, gloss string, japanese string, ja string")
    # an array arrives as JSON text, a plain string as itself
    raw = F.coalesce(read["japanese"], read["ja"])
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"[|,、;\n]+"))
    usable = read["english"].isNotNull() | read["gloss"].isNotNull() | raw.isNotNull()
    parsed = F.struct(clean_english(F.coalesce(read["english"], read["gloss"])).alias("english"), F.coalesce(clean_japanese(items), F.array().cast("array<string>")).alias("japanese"))
    plain = F.struct(clean_english(F.split(text, "\n")[0]).alias("english"), F.array().cast("array<string>").alias("japanese"))
    return F.when(usable, parsed).otherwise(plain)


def route(c: Column | str) -> Column:
    """ja, en_word (three words or fewer) or en_sentence."""
    return F.when(is_japanese(c), F.lit("ja")).when(n_words(c) <= 3, F.lit("en_word")).otherwise(F.lit("en_sentence"))


def too_long(c: Column | str) -> Column:
    c = col(c)
    return (F.length(c) > MAX_QUERY) | (is_japanese(c) & (F.length(normalise(c)) > MAX_JAPANESE))


def hash_prefix(c: Column | str) -> Column:
    """Twelve hex digits of SHA-256; null for null."""
    return F.substring(F.sha2(col(c), 256), 1, 12)


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits in lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def western_number(c: Column | str) -> Column:
    """Groups of three digits; the decimals stay as they are written."""
    whole, rest = F.regexp_extract(col(c).cast("string"), r"^(-?\d+)", 1), F.regexp_extract(col(c).cast("string"), r"^-?\d+(\..*)?$", 1)
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ","), rest)


def indian_number(c: Column | str) -> Column:
    """The last three digits, then groups of two, in Devanagari digits."""
    text = col(c).cast("string")
    grouped = F.regexp_replace(text, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.translate(grouped, "0123456789", "०१२३४५६७८९")


def localised_number(c: Column | str, lang: Column) -> Column:
    return F.when(lang.isin("hi", "mr"), indian_number(c)).otherwise(western_number(c))


def translated(lang: Column, key: Column, table: Column, fallback: Column, values: Column) -> Column:
    """A message in a language (map key -> text), else in the fallback; ``{name}`` is replaced from a map in one pass."""
    text = F.coalesce(F.element_at(table, key), F.element_at(fallback, key), key)
    pieces = F.regexp_extract_all(text, F.lit(r"(\{\w+\}|[^{]+|\{)"), F.lit(1))
    put = F.transform(pieces, lambda p: F.when(p.rlike(r"^\{\w+\}$"), F.coalesce(F.element_at(values, F.regexp_extract(p, r"(\w+)", 1)), p)).otherwise(p))
    return F.array_join(put, "")


#: Words that count as jargon, and signs of an analogy, in explanations.
JARGON = (
    r"(?i)\b(?:particle|auxiliary|copula|volitional|nominali[sz]er|conjugat\w*|causative|passive|honorific|humble|"
    r"subordinate|clause|morpheme|inflect\w*|te-form|potential form|conditional|concessive|topic marker|"
    r"case marker|predicate|modality|aspect|stem|adverbial|attributive|literary|formal register)\b"
)
ANALOGY = r"(?i)\b(?:like|similar to|think of|imagine|just as|equivalent|in english)\b"


def text_metrics(c: Column | str) -> Column:
    """struct(words, jargon, analogy) of an explanation."""
    return F.struct(n_words(c).alias("words"), F.regexp_count(col(c), F.lit(JARGON)).alias("jargon"), col(c).rlike(ANALOGY).alias("analogy"))


def client_key(forwarded: Column, peer: Column, hops: int, signed: Column | None = None) -> Column:
    """Who is limited: the signed client, else the hop-th address from the right, else the peer."""
    chain = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x))
    chain = F.filter(chain, lambda x: x != "")
    by_hop = F.when(F.size(chain) >= hops, F.try_element_at(chain, F.lit(-hops))) if hops > 0 else F.lit(None).cast("string")
    return F.coalesce(signed if signed is not None else F.lit(None).cast("string"), by_hop, peer)


def safe_redirect(c: Column | str) -> Column:
    """A path on this site, else "/"."""
    return F.when(col(c).rlike(r"^/(?![/\\])"), col(c)).otherwise(F.lit("/"))


def int_or(c: Column | str, default: int) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(default))


def display_url(c: Column | str) -> Column:
    """Percent-encoded for a link."""
    return F.url_encode(col(c))


def checked_input(c: Column | str, most: int = 200) -> Column:
    """struct(text, ok): white space collapsed; ok if neither empty nor longer than ``most``."""
    text = one_spaced(c)
    return F.struct(text.alias("text"), F.length(text).between(1, most).alias("ok"))


#: The most characters of a sentence and of its meaning, and where a hint is cut.
MOST_SENTENCE, MOST_MEANING, HINT_CUT = 200, 400, 600


def checked_request(sentence: Column | str, meaning: Column | str, hint: Column | str) -> Column:
    """struct(sentence, meaning, hint, problem): white space collapsed, the hint cut, and what is wrong, null if nothing is."""
    s, m = one_spaced(F.coalesce(col(sentence), F.lit(""))), one_spaced(F.coalesce(col(meaning), F.lit("")))
    cut = F.left(stripped(F.coalesce(col(hint), F.lit(""))), F.lit(HINT_CUT))
    problem = F.when(s == "", F.lit("empty sentence")).when(F.length(s) > MOST_SENTENCE, F.lit("long sentence")).when(F.length(m) > MOST_MEANING, F.lit("long meaning"))
    return F.struct(s.alias("sentence"), m.alias("meaning"), cut.alias("hint"), problem.alias("problem"))
