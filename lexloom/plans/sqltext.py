"""SQL fragments that state the text functions once more, for the checking queries."""

from __future__ import annotations

from ..functions import text as T

#: Characters in SQL strings double their quotes.
_OPENING = T.OPENING.replace("'", "''")
JA = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"
HAN = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def one_spaced(x: str) -> str:
    return stripped(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def n_words(x: str) -> str:
    s = one_spaced(x)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


def is_ja(x: str) -> str:
    return f"coalesce(regexp_matches(ltrim({x}, '{_OPENING}'), '^[{JA}]'), false)"


def gloss_key(x: str) -> str:
    return f"regexp_replace({one_spaced(rf'''regexp_replace(lower({stripped(x)}), '\s*\(.*', '', 'g')''')}, '[,;:.!\\s]+$', '')"


def normalise(x: str) -> str:
    q = f"regexp_replace({stripped(x)}, '[\\s?!.。、]+$', '')"
    return f"CASE WHEN {is_ja(q)} THEN {q} ELSE lower({q}) END"


def route(x: str) -> str:
    return f"CASE WHEN {is_ja(x)} THEN 'ja' WHEN {n_words(x)} <= 3 THEN 'en_word' ELSE 'en_sentence' END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def frame(x: str) -> str:
    """What a question-shaped query asks for, null where no frame fits."""
    cases = " ".join("WHEN regexp_matches(q, '{0}') THEN regexp_extract(q, '{0}', 1)".format(f.replace("'", "''")) for f in T.FRAMES)
    return f"(SELECT CASE {cases} END FROM (SELECT {normalise(x)} AS q))"
