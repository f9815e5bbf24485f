"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature calibration.

Words (and runs of signs) are hashed to ``BUCKETS`` rows.  Each row has a fixed sparse random index vector; a row's word
vector is the normalised sum of the index vectors of its neighbours in the training sample, plus its own index vector,
so words never seen still have one.  A document is pooled as the mean of its vectors and the means of the element-wise
products of vectors 1, 2 and 3 places apart (which see repetition), with the share of capitalised words added as a vector
of its own.  Labels, language, source and id are not inputs of the score.

A fifth of each class's rows, those of the least hashes, only calibrates the temperature, which is 1 where
there are none.

Defined cases: null and empty texts pool to zeros and get the network's score for that; without labelled rows of both
classes there is nothing to tell apart, and the score is the smoothed share of label 1 everywhere.  Ids may be null, repeated or of any type: each row is scored
alone, so repeated rows get equal scores.  A very long text is pooled whole, in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import Workspace, bare, bound_batches, held_out
from .training import gathered, sigmoid, temperature, training_rows, unit_hash

BUCKETS, DIM, LAGS = 1 << 15, 24, (1, 2, 3)
CAPS = BUCKETS  # the last row: the mark of capitalised words
SLICE = 1 << 19


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors: four entries of +-1/2 in each row."""
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    at = np.argsort(rng.random((BUCKETS + 1, DIM)), axis=1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.array([-0.5, 0.5], np.float32), (BUCKETS + 1, 4)), axis=1)
    return out


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, _, hashes, caps = bs.lexemes(data, offsets)
    return (hashes >> np.uint64(49)).astype(np.int64), bs.counts(starts, offsets), caps


def neighbour_sums(batches: Iterator[pa.RecordBatch], text_at: int, reach: int = 2) -> np.ndarray:
    """Sums of the index vectors of each bucket's neighbours up to ``reach`` places away in one text."""
    index, out = index_vectors(), np.zeros((BUCKETS + 1, DIM), np.float32)
    for batch in batches:
        for _, _, data, offsets in bs.slices(batch.column(text_at), SLICE):
            b, n, _ = _buckets(data, offsets)
            rows = np.repeat(np.arange(len(n)), n)
            for lag in range(1, reach + 1):
                same = np.flatnonzero(rows[lag:] == rows[:-lag])
                left, right = b[same], b[same + lag]
                for one, other in ((left, right), (right, left)):
                    order = np.argsort(one, kind="stable")
                    who, first = np.unique(one[order], return_index=True)
                    if len(who):
                        out[who] += np.add.reduceat(index[other[order]], first, axis=0)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (0.5 * sums / np.maximum(norm, 1e-6) + index_vectors()).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """rows x features."""
    b, n, caps = _buckets(data, offsets)
    rows = np.repeat(np.arange(len(n)), n)
    v = vectors[b]
    n1 = np.maximum(n, 1)[:, None].astype(np.float32)
    parts = [bs.add_rows(v, n) / n1]
    share = bs.per_row_sum(caps.astype(np.int64), n)[:, None] / n1
    parts[0] += share * vectors[CAPS] * 4
    for lag in LAGS:
        product = np.zeros_like(v)
        if len(v) > lag:
            np.multiply(v[lag:], v[:-lag], out=product[lag:])
            product[lag:][rows[lag:] != rows[:-lag]] = 0
        parts.append(bs.add_rows(product, n) / n1)
    parts.append(np.log1p(n)[:, None] / 10)
    return np.concatenate(parts, axis=1).astype(np.float32)


@dataclass
class QualityModel:
    """``weights`` is None where no network could be fitted; then ``prior`` is every text's score."""

    vectors: np.ndarray
    weights: tuple[np.ndarray, ...] | None
    prior: float
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.prior)
        return sigmoid(self.logits(pooled(data, offsets, self.vectors).astype(np.float64)) / self.heat)


def _network(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 3) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the log loss with weight decay."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(x)), 0.005 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(x), 128):
            xb, yb = x[order[at : at + 128]], y[order[at : at + 128]]
            h = np.maximum(xb @ p[0] + p[1], 0)
            d = (sigmoid(h @ p[2] + p[3]) - yb) / len(yb)
            dh = np.outer(d, p[2]) * (h > 0)
            grads, t = [xb.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum()], t + 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return (mean, scale, *p)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, hidden: int = 32, epochs: int = 12, work: Workspace | None = None) -> QualityModel:
    """Fit on at most about ``max_rows`` labelled rows; a fifth of them only calibrates the temperature."""
    rows = training_rows(docs, labels, "quality", max_rows, work or Workspace(docs.sparkSession, "quality"))
    sums = np.zeros((BUCKETS + 1, DIM), np.float32)
    for (part,) in gathered(rows, lambda batches: [neighbour_sums(batches, 1).tobytes()]):
        sums += np.frombuffer(part, np.float32).reshape(sums.shape)
    vectors = word_vectors(sums)

    def examples(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
        ids, ys, xs = [], [], []
        for batch in batches:
            ids.append(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            ys.append(batch.column(2).to_numpy(zero_copy_only=False))
            xs += [pooled(d, o, vectors) for _, _, d, o in bs.slices(batch.column(1), SLICE)]
        return [np.concatenate(a or [np.zeros(0)]).astype(k).tobytes() for a, k in ((ids, np.int64), (ys, np.int64), (xs, np.float32))]

    got = gathered(rows, examples)
    ids, y = (np.concatenate([np.frombuffer(g[k], np.int64) for g in got] or [np.zeros(0, np.int64)]) for k in (0, 1))
    prior = (float((y == 1).sum()) + 1) / (len(y) + 2)
    if len(set((y == 1).tolist())) < 2:
        return QualityModel(vectors, None, prior)
    x = np.concatenate([np.frombuffer(g[2], np.float32).reshape(-1, DIM * (1 + len(LAGS)) + 1) for g in got]).astype(np.float64)
    order = np.argsort(ids, kind="stable")  # the order of parts doesn't matter
    ids, y, x = ids[order], (y[order] == 1).astype(np.float64), x[order]
    calibrate, luck = np.zeros(len(y), bool), unit_hash(ids, 99)
    for own in (np.flatnonzero(y == c) for c in (0, 1)):
        calibrate[own[np.argsort(luck[own], kind="stable")[: len(own) // 5]]] = True
    model = QualityModel(vectors, _network(x[~calibrate], y[~calibrate], hidden, epochs), prior)
    model.heat = temperature(model.logits(x[calibrate]), y[calibrate])
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(data, offsets), pa.float64())], names=[id_col, "score"])

    return bare(docs, id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their columns: one pass without a shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [model.scores(d, o) >= least for _, _, d, o in bs.slices(batch.column(at), SLICE)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, work: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    out = score(docs, fit(docs, labels, max_rows, work=work))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
