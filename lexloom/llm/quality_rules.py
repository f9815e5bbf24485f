"""Quality rules with risk-controlled cutoffs.

One scan counts, for each text, words, their characters, symbols, repeated lines and words in repeated 3-word windows.
Fixed base rules fail texts outright.  Further rules reject where a ratio of these counts passes a cutoff, and the cutoffs are
chosen from labelled rows so that good texts are safe: for each stratum (language) one nested sequence of joint settings of all
rules, each a cutoff stricter than the one before, is tested against the exact (Clopper-Pearson) upper bound of the share of good
texts that all its cutoffs reject together, and the last setting before the first failure holds.  The sequence takes the cutoffs by
the good texts they reject in the other strata, then from mild to strict, so it doesn't depend on the labels that test it.
Fixed-sequence testing needs no correction within a stratum; strata share the error level evenly (Bonferroni), so with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good texts to all rules together.  A stratum with
too few labels to certify anything, whatever its texts, keeps all and takes no share of the error.  The bound holds for
groups of near copies, each counted once at its worst member, as copies are no independent evidence.

Only strata that could be certified alone reach the driver, at most one for each ``least_labels`` good labelled groups; more
than ``MOST_STRATA`` of them raise an error, as such a column isn't a stratum.

Defined cases: a null or empty text has no words and fails the base rules; null languages are a stratum of their own, that of
the empty string; ids may be null or repeated (labels of repeated ids count once for each different text); repeated rows get
equal results.  A very long text is counted whole, in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import Workspace, bare, held_out, small

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")

#: Each rule's ratio and its cutoffs from the mildest to the strictest; a text is rejected where the ratio is above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1)", (60.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5)),
    "capitals": ("n_caps / greatest(n_words, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
}


def count_all(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of ``COUNTS`` for each row, and the least hash of its 3-word windows, which near copies mostly share."""
    rows_n = len(offsets) - 1
    starts, ends = bs.words(data, offsets)
    n_words = bs.counts(starts, offsets)
    letters = np.zeros(len(data) + 1, np.int64)  # code points outside white space
    np.cumsum(((data & 0xC0) != 0x80) & ~bs.SPACE[data], out=letters[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    pre = bs.prefix(data)
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    stop = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    with_word = letters[stop] > letters[begin]
    begin, stop = begin[with_word], stop[with_word]
    row = bs.row_of(begin, offsets)
    keys = bs.mix(bs.span_hash(pre, begin, stop) + bs.mix(row.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    dup = order[1:][keys[order][1:] == keys[order][:-1]]
    n_lines, n_dup = np.bincount(row, minlength=rows_n), np.bincount(row[dup], minlength=rows_n)
    # 3-word windows
    word_row = np.repeat(np.arange(rows_n), n_words)
    grams, at = bs.shingles(bs.span_hash(pre, starts, ends), word_row, 3)
    witness, per_row = np.zeros(rows_n, np.uint64), np.bincount(word_row[at], minlength=rows_n)
    if len(grams):
        witness[per_row > 0] = np.minimum.reduceat(grams, (np.cumsum(per_row) - per_row)[per_row > 0])
    keys = bs.mix(grams + bs.mix(word_row[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(starts), bool)
    for k in range(3):
        inside[at[again] + k] = True
    caps = bs.lexemes(data, offsets, signs=False)
    n_caps = np.bincount(bs.row_of(caps[0][caps[3]], offsets), minlength=rows_n)
    whole = [n_words, letters[offsets[1:]] - letters[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], n_dup, np.bincount(word_row[inside], minlength=rows_n), n_lines, n_caps]
    return [*(x.astype(np.int64) for x in whole), witness.view(np.int64)]


def text_counts(docs: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, stratum, counts) of each row: one pass, no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *map(pa.array, count_all(data, offsets))], names=[id_col, stratum_col, *COUNTS, "witness"])

    schema = f"{id_col} {kinds[id_col]}, {stratum_col} {kinds[stratum_col]}, " + ", ".join(f"{c} long" for c in (*COUNTS, "witness"))
    return bare(docs, id_col, stratum_col, text_col).mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), as the incomplete beta function by its continued fraction: some dozens of steps at any size."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # I_x(a, b)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(p))
    if x >= (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, p) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    out = d = 1 / (d if abs(d) > tiny else tiny)
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound of a share of which k of n were seen: P(Binomial(n, bound) <= k) = error."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if binomial_tail(k, n, p) > error else (lo, p)
    return hi


#: Strata that the driver takes: some dozens of numbers each.
MOST_STRATA = 20_000


def losses(stats: list[dict]) -> dict[tuple[str, int], int]:
    """The good texts that each cutoff rejects, by (rule, cutoff's number)."""
    return {(rule, j): sum(s["n"] for s in stats if s[rule] >= len(cutoffs) - j) for rule, (_, cutoffs) in RULES.items() for j in range(len(cutoffs))}


def sequence(stats: list[dict], stratum: str, total: dict[tuple[str, int], int] | None = None) -> list[tuple[str, int]]:
    """(rule, cutoff's number) in the order in which a stratum's settings grow; stricter cutoffs of a rule come later.

    The order goes by what the cutoffs reject in the other strata: the ``total`` of all, which is counted once, less the own.
    """
    own = losses([s for s in stats if s["stratum"] == stratum])
    total = losses(stats) if total is None else total
    return sorted(own, key=lambda x: (total[x] - own[x], (x[1] + 1) / len(RULES[x[0]][1])))


def certified(stats: list[dict], risk: float, error: float) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) of the strictest safe settings.

    ``stats`` has rows (stratum, n, one number for each rule): n good texts, and how many of the rule's cutoffs they pass.
    """
    by: dict[str, list[dict]] = {}
    for s in stats:
        by.setdefault(s["stratum"], []).append(s)
    sizes, total = {stratum: sum(s["n"] for s in own) for stratum, own in by.items()}, losses(stats)
    # the most strata that can all certify a setting at their share of the error
    large = sorted(sizes, key=lambda x: (-sizes[x], x))
    able = max((k for k in range(1, len(large) + 1) if binomial_tail(0, sizes[large[k - 1]], risk) <= error / k), default=0)
    out = []
    for stratum in sorted(large[:able]):
        steps = sequence(by[stratum], stratum, total)
        place = {x: t for t, x in enumerate(steps)}
        lost = [0] * len(steps)  # good texts by the first setting that rejects them
        for s in by[stratum]:
            if (met := [place[rule, len(cutoffs) - s[rule]] for rule, (_, cutoffs) in RULES.items() if s[rule]]):
                lost[min(met)] += s["n"]
        safe, k = {}, 0
        for (rule, j), more in zip(steps, lost):
            k += more
            if k / sizes[stratum] > risk or binomial_tail(k, sizes[stratum], risk) > error / able:  # the upper bound lies above the risk
                break
            safe[rule] = RULES[rule][1][j]
        out += [(stratum, rule, cutoff) for rule, cutoff in safe.items()]
    return out


def rule_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", risk: float = 0.03, error: float = 0.05, least_words: int = 50, repeat_percent: int = 50, work: Workspace | None = None
) -> DataFrame:
    """(id, counts, base_failed, kept) of each row."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "quality-rules")
    rows = work.table(text_counts(docs, id_col, stratum_col, text_col), "counts")
    rows = rows.withColumn("stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    failed = f"n_words < {least_words} or 100 * n_repeat_words > {repeat_percent} * n_words"
    good = labels.select(labels[id_col].alias("label_id"), labels["quality"].alias("quality")).where("quality = 1 and label_id is not null").where(~held_out("label_id")).select("label_id").distinct()
    # counts over all good training texts that the base rules leave, by the cutoffs they pass, each group of copies at its worst
    passed = [" + ".join(f"cast({ratio} > {c} as int)" for c in cutoffs) for ratio, cutoffs in RULES.values()]
    left = rows.where(f"not ({failed})").join(good, rows[id_col] == good["label_id"]).select("stratum", "witness", *[F.expr(x).alias(rule) for rule, x in zip(RULES, passed)])
    left = work.table(left.groupBy("stratum", "witness").agg(*[F.max(rule).alias(rule) for rule in RULES]), "good")
    least_labels = ceil(log(error) / log1p(-risk))  # fewer certify nothing even alone and without a loss
    able = left.groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= least_labels)
    if able.limit(MOST_STRATA + 1).count() > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata with {least_labels} good labels or more")
    counted = left.join(F.broadcast(able.select("stratum")), "stratum", "left_semi")
    stats = [r.asDict() for r in counted.groupBy("stratum", *RULES).agg(F.count("*").alias("n")).collect()]
    limits = small(spark, certified(stats, risk, error), "s string, rule string, cutoff double")
    # at most one row for each stratum with labels
    wide = limits.groupBy("s").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    judged = rows.join(F.broadcast(wide), rows["stratum"] == wide["s"], "left")
    broken = " or ".join(f"coalesce({ratio} > cut_{rule}, false)" for rule, (ratio, _) in RULES.items())
    return judged.select(id_col, *COUNTS[:5], F.expr(failed).alias("base_failed"), F.expr(f"not ({failed}) and not ({broken})").alias("kept"), *COUNTS[5:])
