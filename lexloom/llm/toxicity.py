"""Toxic spans by a linear-chain conditional random field, with document scores from its marginals.

Only documents carry labels, so tokens are labelled first: a word is offensive if the texts that hold it are marked toxic
so often that chance can't explain it (exact binomial tail, Bonferroni over the patterns tested); so is the beginning of a word.  Near copies count once for
this: texts with the same least shingle hash are one witness.  The tokens of offensive words in toxic texts are the first positives.

The field has two states, transition weights, and weights for what stands at a word: the word or its offensive pattern, the
words before and after it, its first and last bytes, its shape, and its place in the chain.  It is fitted by forward-backward
gradients, and then the token labels are estimated anew from it, ``rounds`` times: words of texts marked clean stay 0, words of a
toxic text get their marginal given that at least one word of the text is toxic.  So words that the tests can't single out
are learnt from their company, and a text without any offensive pattern still says something.
A chain is a sentence: the words between sentence ends or line ends, in pieces of at most ``CHAIN`` words, so memory is
bounded and every word of a text is tagged.  A document's evidence is -sum(log(1 - p)) over its words' toxic marginals p of ``FLOOR`` or more;
a logistic curve fitted on training documents that the field hasn't seen turns it into a probability.
Labels, language, source and id are not inputs of the score.

The fit takes at most about ``max_rows`` labelled rows, at most about ``max_chains`` chains of toxic texts with offensive words (or
of toxic texts without any) and as many others, both uniform by hash of what is there; scoring covers every word.

Defined cases: null and empty texts have no evidence and get the curve's score for that; without labelled rows of both
classes, or without offensive words, the score is the smoothed share of label 1.  Offsets count code points.  Each row is scored
alone, so ids may be null, repeated or of any type, and repeated rows get equal scores; no rows give no rows.  A very long
text is tagged whole, in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import Workspace, bare, held_out
from .training import gathered, sigmoid, training_rows, unit_hash

BUCKETS, CHAIN = 1 << 18, 128
CONTEXT = 17  # bits of the table that the words around, affixes, shapes and places share
FEATURES = 7
STEMS = (4, 5, 6, 7, 8, 9)
FLOOR = 0.03  # marginals below this are background
_END = np.zeros(256, bool)
_END[[0x0A, ord("."), ord("!"), ord("?")]] = True


@dataclass
class Words:
    """The words of some rows.

    ``patterns`` has the hashes of each pattern, 0 where the word has none: the whole word and, if it is longer, its first bytes
    of each length in ``STEMS``.
    """

    starts: np.ndarray
    ends: np.ndarray
    patterns: list[np.ndarray]
    per_row: np.ndarray
    shape: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, whole, caps = bs.lexemes(data, offsets, signs=False)
        pre, out, size = bs.prefix(bs.LOWER[data]), [whole], ends - starts
        for k in STEMS:
            at = np.flatnonzero(size > k)
            h = np.zeros(len(starts), np.uint64)
            h[at] = bs.span_hash(pre, starts[at], starts[at] + k) ^ np.uint64(k)
            out.append(h)
        short = np.minimum(size, 4)
        first = data[starts] if len(starts) else np.zeros(0, np.uint8)
        shape = caps * 4 + ((first >= 65) & (first <= 90)) * 2 + ((first >= 48) & (first <= 57)) + 8 * np.minimum(size, 15)
        return Words(starts, ends, out, bs.counts(starts, offsets), shape.astype(np.uint64), bs.span_hash(pre, starts, starts + short), bs.span_hash(pre, ends - short, ends))


@dataclass
class Vocabulary:
    """Numbers of features: each offensive pattern has one, all other words share ``BUCKETS`` hashed ones, the rest its own table."""

    bad: np.ndarray  # sorted hashes

    @property
    def size(self) -> int:
        return BUCKETS + len(self.bad) + (1 << CONTEXT)

    def features(self, w: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """words x ``FEATURES``: numbers of what stands at each word of the chains, which cover all words in order."""
        n = len(w.starts)
        out = np.empty((n, FEATURES), np.int32)
        out[:, 0] = self.numbers(w.patterns)
        left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        left[1:], right[:-1] = w.patterns[0][:-1], w.patterns[0][1:]
        last = first + length - 1
        left[first], right[last] = 1, 1  # no neighbour
        place = np.zeros(n, np.uint64)
        place[first] += np.uint64(1)
        place[last] += np.uint64(2)
        for k, values in enumerate((left, right, w.head, w.tail, w.shape, place), 1):
            spread = (values + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 ^ (k << 33))
            out[:, k] = BUCKETS + len(self.bad) + (spread >> np.uint64(64 - CONTEXT)).astype(np.int32)
        return out

    def numbers(self, patterns: list[np.ndarray]) -> np.ndarray:
        """The number of the word's longest offensive pattern (the whole word first), else of its bucket."""
        out = (patterns[0] >> np.uint64(46)).astype(np.int64)
        near = np.zeros(BUCKETS, bool)
        near[(self.bad >> np.uint64(46)).astype(np.int64)] = True
        for hashes in reversed([patterns[0], *patterns[:0:-1]]):
            at = np.flatnonzero(near[(hashes >> np.uint64(46)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.bad, hashes[at]), len(self.bad) - 1)
            exact = self.bad[place] == hashes[at]
            out[at[exact]] = BUCKETS + place[exact]
        return out


def _chains(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ended = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_END[data], out=ended[1:])
    rows = np.repeat(np.arange(len(n)), n)
    new = np.r_[True, (rows[1:] != rows[:-1]) | (ended[starts[1:]] != ended[starts[:-1]])]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(starts)])
    pieces = -(-length // CHAIN)
    at = np.repeat(first, pieces) + CHAIN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.repeat(first + length, pieces)
    return at, np.minimum(end - at, CHAIN)


def _forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray, length: np.ndarray, pair_sums: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for words with log-odds ``e``; and the expected transition counts if wanted.

    ``trans`` is the 2 x 2 matrix of transition potentials.  Chains must cover the words without overlap.
    """
    out, sums = np.zeros(len(e)), np.zeros((2, 2))
    if not len(first):
        return out, sums
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # chains with more than t words
    weight = np.exp(np.clip(e, -30, 30))
    fore: list[np.ndarray] = []
    for t in range(length[0]):
        n = active[t]
        w = weight[first[:n] + t]
        if t == 0:
            f = 1 / (1 + w)  # share of state 0
        else:
            f0 = fore[-1][:n]
            a = f0 * trans[0, 0] + (1 - f0) * trans[1, 0]
            b = (f0 * trans[0, 1] + (1 - f0) * trans[1, 1]) * w
            f = a / (a + b)
        fore.append(f)
    back0, back1 = np.ones(active[0]), np.ones(active[0])
    for t in range(length[0] - 1, -1, -1):
        n = active[t]
        f0 = fore[t]
        b0, b1 = back0[:n], back1[:n]
        p0, p1 = f0 * b0, (1 - f0) * b1
        out[first[:n] + t] = p1 / (p0 + p1)
        if t:
            w = weight[first[:n] + t]
            v0, v1 = b0, w * b1
            if pair_sums:
                g0 = fore[t - 1][:n]
                joint = [g0 * trans[0, 0] * v0, g0 * trans[0, 1] * v1, (1 - g0) * trans[1, 0] * v0, (1 - g0) * trans[1, 1] * v1]
                z = sum(joint)
                sums += np.array([(x / z).sum() for x in joint]).reshape(2, 2)
            a = trans[0, 0] * v0 + trans[0, 1] * v1
            b = trans[1, 0] * v0 + trans[1, 1] * v1
            z = a + b
            back0[:n], back1[:n] = a / z, b / z
    return out, sums


@dataclass
class ToxicModel:
    """``weights`` is None where nothing could be learnt; then ``prior`` is every text's score."""

    weights: np.ndarray | None
    trans: np.ndarray
    prior: float
    words: Vocabulary | None = None
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends and marginals of the words, and words per row."""
        w = Words.of(data, offsets)
        first, length = _chains(data, offsets, w.starts, w.per_row)
        e = self.weights[self.words.features(w, first, length)].sum(1, dtype=np.float64)
        p, _ = _forward_backward(e, self.trans, first, length)
        return w.starts, w.ends, p, w.per_row

    def evidence(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = np.where(p < FLOOR, 0, np.minimum(p, 1 - 1e-9))
        return bs.add_rows(-np.log1p(-p)[:, None], n)[:, 0]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.log(evidence + 1e-3) + self.offset)


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) >= k)."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    top = max(terms)
    return top + log(sum(np.exp(t - top) for t in terms))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]] if len(pairs) else pairs


def _witnesses(rows: DataFrame, label: int, wanted: np.ndarray | None = None) -> dict[int, int]:
    """Pattern hash (signed) -> number of groups of texts with this label that hold it; hash 0 counts all groups.

    A text's group is its least shingle hash, which near copies mostly share; ``wanted`` (sorted) narrows the patterns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array((batch.column(2).to_numpy(zero_copy_only=False) == 1) == (label == 1)))
            for lo, hi, data, offsets in bs.slices(batch.column(1)):
                words = Words.of(data, offsets)
                patterns, n = words.patterns, words.per_row
                rows_of = np.repeat(np.arange(len(n)), n)
                grams, at = bs.shingles(patterns[0], rows_of, 3)
                group = np.arange(hi - lo, dtype=np.uint64)
                per = np.bincount(rows_of[at], minlength=hi - lo)
                full = np.flatnonzero(per)
                if len(full):
                    group[full] = np.minimum.reduceat(grams, (np.cumsum(per) - per)[full])
                pairs = [np.stack([np.zeros(len(group), np.uint64), group], 1)]
                for hashes in patterns:
                    found = np.stack([hashes, group[rows_of]], 1)[hashes > 0]
                    if wanted is not None:
                        place = np.minimum(np.searchsorted(wanted, found[:, 0]), max(len(wanted) - 1, 0))
                        found = found[wanted[place] == found[:, 0]] if len(wanted) else found[:0]
                    pairs.append(_distinct(found))
                out = np.concatenate(pairs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["h", "g"])

    counted = rows.mapInArrow(run, "h long, g long").distinct().groupBy("h").agg(F.count("*").alias("n"))
    counted = counted.where("n >= 3 or h = 0") if wanted is None else counted
    return {r.h: r.n for r in counted.collect()}


def offensive_words(rows: DataFrame, chance: float = 1e-3) -> np.ndarray:
    """Sorted hashes of the patterns whose witnesses are toxic too often for chance at the family-wise level ``chance``.

    Beside that exact test a pattern must have three toxic witnesses, as one or two say nothing about a word however rare toxic texts
    are, and more than three in five of its witnesses must be toxic: a common word that only leans to toxic texts passes the test in
    a large sample, but doesn't make a text toxic.
    """
    bad = _witnesses(rows, 1)
    toxic_groups = bad.pop(0, 0)
    words = np.sort(np.array(list(bad), np.int64).view(np.uint64))
    good = _witnesses(rows, 0, words)
    share = min(0.5, (toxic_groups + 1) / (toxic_groups + good.pop(0, 0) + 2))
    level = log(chance / max(1, len(words)))
    found = [k for k, b in bad.items() if b > 1.5 * good.get(k, 0) and _log_tail(b, b + good.get(k, 0), share) <= level]
    return np.sort(np.array(found, np.int64).view(np.uint64))


@dataclass
class Chains:
    """Gathered chains: features, first labels, and for each chain its length, document and whether that is marked toxic."""

    x: np.ndarray
    y: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    toxic: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length


def _empty_log(e: np.ndarray, trans: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The logarithm of each chain's probability that no word is toxic."""
    out, weight = np.zeros(len(first)), np.exp(np.clip(e, -30, 30))
    order = np.argsort(-length, kind="stable")
    first, size = first[order], length[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    share, total = np.zeros(0), np.zeros(len(first))
    for t, n in enumerate(active):
        w = weight[first[:n] + t]
        zero, one = (np.ones(n), w) if t == 0 else (share[:n] * trans[0, 0] + (1 - share[:n]) * trans[1, 0], (share[:n] * trans[0, 1] + (1 - share[:n]) * trans[1, 1]) * w)
        share = zero / (zero + one)
        total[:n] += np.log(zero + one)
    out[order] = (size - 1) * np.log(trans[0, 0]) - total
    return out


def _relabelled(c: Chains, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Token labels from the field: 0 in clean texts, marginals given at least one toxic word of the text in toxic ones."""
    p, _ = _forward_backward(e, trans, c.first, c.length)
    who, place = np.unique(c.owner, return_inverse=True)
    none = np.exp(np.bincount(place, _empty_log(e, trans, c.first, c.length), len(who)))
    some = np.maximum(1 - none, 1e-9)[place]
    return np.where(np.repeat(c.toxic, c.length), np.minimum(p / np.repeat(some, c.length), 1.0), 0.0)


def _fit_field(c: Chains, size: int, rounds: int, steps: int = 100, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition potentials of highest penalised likelihood, by Adam; labels are estimated anew after each round but the last."""
    used, place = np.unique(c.x, return_inverse=True)
    place = place.reshape(c.x.shape)
    params, y = [np.zeros(len(used)), np.array([-2.0]), np.zeros((2, 2))], c.y.astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[c.first] = False  # words with a predecessor in their chain
    at = np.flatnonzero(inner)
    for turn in range(rounds + 1):
        before, after = np.stack([1 - y[at - 1], y[at - 1]]), np.stack([1 - y[at], y[at]])
        seen = before @ after.T
        observed = np.bincount(place.ravel(), np.repeat(y, FEATURES), len(used))
        m, v = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
        many = steps if turn == 0 else steps // 2
        for t in range(1, many + 1):
            e = params[0][place].sum(1) + params[1][0]
            p, pairs = _forward_backward(e, np.exp(params[2]), c.first, c.length, pair_sums=True)
            grads = [np.bincount(place.ravel(), np.repeat(p, FEATURES), len(used)) - observed + 0.02 * params[0], np.array([(p - y).sum()]), (pairs - seen + 0.1 * params[2]) * chain]
            for k, g in enumerate(grads):
                m[k] = 0.8 * m[k] + 0.2 * g
                v[k] = 0.98 * v[k] + 0.02 * g * g
                params[k] = params[k] - (0.3 if turn == 0 else 0.1) * (1 - t / (many + 1)) * (m[k] / (1 - 0.8**t)) / (np.sqrt(v[k] / (1 - 0.98**t)) + 1e-8)
        if turn < rounds:
            y = _relabelled(c, params[0][place].sum(1) + params[1][0], np.exp(params[2]))
    weights = np.zeros(size, np.float32)
    weights[used] = params[0]
    weights[: size - (1 << CONTEXT)] += params[1][0]  # every word has one number of this part
    return weights, np.exp(params[2])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_chains: int = 30_000, rounds: int = 2, chain: bool = True, work: Workspace | None = None) -> ToxicModel:
    """Fit on at most about ``max_rows`` labelled rows; a third of them only fits the final curve.

    Without ``chain`` the transitions stay even, so each word is judged by itself.
    """
    rows = training_rows(docs, labels, "toxic", max_rows, work or Workspace(docs.sparkSession, "toxicity"))
    stats = rows.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    n, positive = stats[0], stats[1] or 0
    none = ToxicModel(None, np.ones((2, 2)), (positive + 1) / (n + 2))
    if not 0 < positive < n:
        return none
    bad = offensive_words(rows)
    if not len(bad):
        return none
    words = Vocabulary(bad)

    def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Words, features, labels, chains and their documents of texts that the curve doesn't need; which chains are wanted first."""
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in bs.slices(batch.column(1)):
                w = Words.of(data, offsets)
                first, length = _chains(data, offsets, w.starts, w.per_row)
                if not len(first):
                    continue
                owner = np.repeat(np.arange(hi - lo), w.per_row)[first]
                x = words.features(w, first, length)
                toxic = label[lo:hi] == 1
                y = (x[:, 0] >= BUCKETS) & np.repeat(toxic, w.per_row)
                has = np.add.reduceat(y.astype(np.int64), first) > 0
                bare_text = toxic & (np.bincount(owner, has, hi - lo) == 0)  # marked toxic, without any offensive word
                learn = unit_hash(ids[lo:hi], 99)[owner] >= 1 / 3
                luck = unit_hash(ids[lo:hi][owner] * 1_000_003 + first - (np.cumsum(w.per_row) - w.per_row)[owner], 7)
                yield x, y, first, length, ids[lo:hi][owner], toxic[owner], (has | bare_text[owner]) & learn, learn, luck

    def sizes(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
        found = np.zeros(2, np.int64)
        for *_, wanted, learn, _ in slices_of(batches):
            found += (wanted.sum(), (learn & ~wanted).sum())
        return [found.tobytes()]

    found = sum(np.frombuffer(g[0], np.int64) for g in gathered(rows, sizes))
    shares = np.minimum(1.0, max_chains / np.maximum(found, 1))

    def chains(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for x, y, first, length, owner, toxic, wanted, learn, luck in slices_of(batches):
            use = np.flatnonzero(learn & (luck < np.where(wanted, *shares)))
            take = np.repeat(first[use], length[use]) + np.arange(length[use].sum()) - np.repeat(np.cumsum(length[use]) - length[use], length[use])
            for store, values in zip(out, (x[take], y[take], length[use], owner[use], toxic[use])):
                store.append(values)
        return [np.concatenate(values or [np.zeros(0)]).astype(k).tobytes() for values, k in zip(out, _KINDS)]

    got = gathered(rows, chains)
    x, y, length, owner, toxic = (np.concatenate([np.frombuffer(g[k], kind) for g in got]) for k, kind in enumerate(_KINDS))
    if not y.any():
        return none
    model = ToxicModel(*_fit_field(Chains(x.reshape(-1, FEATURES), y, length, owner, toxic), words.size, rounds, chain=chain), none.prior, words)

    def evidence(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
        out: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for _, _, data, offsets in bs.slices(batch.column(1)):
                _, _, p, per = model.marginals(data, offsets)
                out[0].append(model.evidence(p, per))
            out[1].append((label == 1).astype(np.float64))
            out[2].append((unit_hash(ids, 99) < 1 / 3).astype(np.float64))
        return [np.concatenate(x or [np.zeros(0)]).astype(np.float64).tobytes() for x in out]

    got = gathered(rows, evidence)
    x, y, other = (np.concatenate([np.frombuffer(g[k], np.float64) for g in got]) for k in range(3))
    use = other > 0 if 0 < y[other > 0].sum() < (other > 0).sum() else np.ones(len(y), bool)
    model.slope, model.offset = _curve(np.log(x[use] + 1e-3), y[use])
    return model


_KINDS = (np.int32, bool, np.int64, np.int64, bool)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps with a light penalty; the slope isn't let below 0.1, so that more evidence never lowers a score."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = sigmoid(design @ a)
        g = design.T @ (p - y) + 1e-2 * np.array([a[0], 0])
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-6])
        a = a - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.1, float(a[0])), float(a[1])


def tag(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, score, spans) of each row; spans are code-point offsets of runs of words with marginals of ``least`` or more."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, score double, spans array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1)):
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                if model.weights is None:
                    scores = np.full(hi - lo, model.prior)
                else:
                    starts, ends, p, n = model.marginals(data, offsets)
                    scores = model.score(model.evidence(p, n))
                    hit = np.flatnonzero(p >= least)
                    if len(hit):
                        points = np.zeros(len(data) + 1, np.int64)
                        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                        rows = np.repeat(np.arange(hi - lo), n)[hit]
                        cut = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(rows) != 0)])
                        for a, z in zip(cut, np.r_[cut[1:], len(hit)] - 1):
                            base = points[offsets[rows[a]]]
                            spans[rows[a]].append({"start": int(points[starts[hit[a]]] - base), "end": int(points[ends[hit[z]]] - base)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[id_col, "score", "spans"])

    return bare(docs, id_col, text_col).mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, work: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each document."""
    out = tag(docs, fit(docs, labels, max_rows, work=work))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
