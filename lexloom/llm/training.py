"""Labelled training rows for the models: a bounded, uniform sample of the rows that may be learnt from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most about ``max_rows`` labelled rows, none of them held out; ``id`` is a hash of the row's id.

    The sample is uniform by a hash of the id, whatever its type.  Ids with several labels take the least, ids with several
    texts the least text, so repeated ids give one row; null labels are ignored.  The sample of ids is broadcast:
    ``max_rows`` bounds it.
    """
    y = labels.select(labels[id_col].alias("own"), labels[label].cast("int").alias("y")).where("own is not null and y is not null")
    y = y.where(~held_out("own")).groupBy("own").agg(F.min("y").alias("y"))
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64("own", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    rows = texts.join(F.broadcast(y), texts["doc"] == y["own"]).groupBy("own", "y").agg(F.min("text").alias("text"))
    return work.table(rows.select(F.xxhash64("own").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "y"), f"train-{label}")


def gathered(rows: DataFrame, summarise: Callable[[Iterator[pa.RecordBatch]], list[bytes]], parts: int = 6) -> list[list[bytes]]:
    """Bounded summaries (a few byte strings each) of ``parts`` parts of a bounded table, brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([summarise(batches)], pa.list_(pa.binary()))], names=["s"])

    return [r.s for r in rows.coalesce(parts).mapInArrow(run, "s array<binary>").collect()]


def unit_hash(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from ids."""
    from .bytescan import mix

    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss between exp(-3) and exp(3), by golden-section search on its logarithm.

    A twentieth of an observation at logit 1, with the label that temperature 1 expects, holds it at 1 where there are no rows and
    bounds it where the rows leave it open.
    """
    share = 1 / (1 + np.exp(-1.0))

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        own = 1 / np.exp(t)
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.05 * (np.logaddexp(0, own) - share * own))

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
