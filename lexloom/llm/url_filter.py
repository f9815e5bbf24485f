"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path goes on to
``?``, ``#`` or the end.  A rule (host, path) fits its host and all subdomains of it where the url's path starts with the
rule's; of several the longest decides.  Urls without a rule are judged by their words: a term counts where no letter
a-z or digit stands beside it; one strict term or ``soft_limit`` different soft terms reject the url.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null url has no terms and is allowed.  Of two
rules for one host and path, block holds.  Rows are judged one by one, so ids may be null, repeated or of any type; other
columns aren't read.  A very long url is scanned whole.  A term in both lists is strict; a soft term counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bare

#: The default vocabulary.
STRICT = ("adult", "escort", "nude", "porn", "sex", "viagra", "xxx")
SOFT = ("bet", "bonus", "buy", "casino", "cheap", "dating", "farm", "free", "loan", "lottery", "pharmacy", "pills", "poker", "prize", "slots", "spam", "win")
#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):  # a term of both kinds is strict
        for term in terms:
            if term:
                tree.add_word(term, (kind, term))
    if len(tree):
        tree.make_automaton()
    return tree


def _edge(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Numbers of different strict and soft terms in a url."""
    tree, low, found = _automaton(strict, soft), (url or "").translate(_LOWER), (set(), set())
    if len(tree) and low:
        for end, (kind, term) in tree.iter(low):
            begin = end - len(term)
            if (begin < 0 or _edge(low[begin])) and (end + 1 == len(low) or _edge(low[end + 1])):
                found[kind].add(term)
    return len(found[0]), len(found[1])


def parts(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def _rule_index(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        out.setdefault(host.translate(_LOWER), []).append((path, verdict))
    for paths in out.values():
        paths.sort(key=lambda p: (-len(p[0]), p[1] != "block"))
    return out


def rule_for(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; each suffix of the host is looked up once."""
    best, at = None, 0
    while True:
        suffix = host[at:]
        for start, verdict in index.get(suffix, ()):
            if path.startswith(start):
                if best is None or len(suffix) + len(start) > len(best[0]):
                    best = (suffix + start, verdict)
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """(id, host, path, rule, verdict, strict_terms, soft_terms) of each row: one pass, no shuffle."""
    index, hard, mild = _rule_index(rules), tuple(strict), tuple(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                host = host.translate(_LOWER)
                rule = rule_for(host, path, index) if host or path else None
                a, b = terms(url, hard, mild)
                rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if a or b >= soft_limit else "allow", a, b))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    schema = f"{id_col} {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string, strict_terms int, soft_terms int"
    return bare(pages, id_col, url_col).mapInArrow(run, schema)
