"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as bytes with A-Z in lower case and every run of signs and white space as one blank.  A passage of
length m is present if some region of the document is within k = floor(rate * m) edits of the whole passage.  Such a region
shares at least m + 1 - q - k q of its q-grams with the passage, on at most k + 1 neighbouring diagonals; q is ``Q``, or for
a short passage the largest length whose bound is still 1 or more, m div (k + 1), so every passage has its whole budget.
One pass over the documents looks every q-gram up in the passages', counts hits in half-overlapping bands of 2 (k + 1)
diagonals, keeps the bands that meet the bound, and verifies each by an alignment of 2 (k + 1) cells a row.  Nothing is
shuffled: passages are broadcast in blocks of about ``BLOCK`` bytes, one pass for each; with more than one, each pass is
written before the next block is read, so the driver holds one block at a time.

Defined cases: a passage of fewer than ``WHOLE`` normalised bytes counts only as whole words: it is searched with a blank
before and after it, and every document has blanks around it.  Passages without letters or digits (or null) are in no
document.  Ids of documents and of passages may be of any orderable type.  ``leaks`` names passages by id and so leaves out those with a null id; ``drop_contaminated`` searches them too.
Null and empty texts hold no passage; repeated rows are judged each.  A passage found several times in a row of documents is
reported once: fewest edits, then the earliest end, then the latest start.  A very long text is taken whole, in one slice,
and its hits in portions; its memory is a small multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bytescan as bs
from .shared import Workspace, bare, bound_batches

Q, RATE, LEAST, WHOLE, BLOCK = 10, 0.08, 1, 24, 1 << 23
_MUL = 0x9E3779B97F4A7C15


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, places of the bytes in the input)."""
    letter = bs.KIND[data] == 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begins = offsets[:-1]
    begins = begins[begins < len(data)]
    keep[begins] = letter[begins]
    places = np.flatnonzero(keep)
    out = np.where(letter[places], bs.LOWER[data[places]], np.uint8(32))
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out, total[offsets], places


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q bytes from each position, put together from those of half the width."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    single = bs._RANDOM[data]
    out, width = single, 1
    for bit in bin(q)[3:]:
        out = out[:-width] * np.uint64(pow(_MUL, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(_MUL) + single[width:]
            width += 1
    return out * np.uint64(0xD6E8FEB86659FD93)


def _framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a blank before and after each."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets + 2 * np.arange(n + 1)


@dataclass
class Index:
    """Passages that are searched by grams of one length."""

    q: int
    framed: bool
    number: np.ndarray  # of each passage in its block
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray  # sorted distinct hashes
    begin: np.ndarray  # of each gram's occurrences
    item: np.ndarray
    place: np.ndarray
    near: np.ndarray  # a table of the hashes' leading bits

    @staticmethod
    def of(q: int, framed: bool, number: list[int], texts: list[bytes], edits: list[int]) -> Index:
        data, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        begin = np.cumsum(length) - length
        n = length + 1 - q
        item = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        place = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        flat = grams(data, q)[begin[item] + place]
        order = np.argsort(flat, kind="stable")
        known, first = np.unique(flat[order], return_index=True)
        near = np.zeros(1 << 20, bool)
        near[known >> np.uint64(44)] = True
        k = np.array(edits, np.int64)
        return Index(q, framed, np.array(number), texts, k, n - k * q, known, np.r_[first, len(flat)].astype(np.int32), item[order], place[order], near)

    def hits(self, norm: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, items, bands) that meet the bound."""
        h = grams(norm, self.q)
        at = np.flatnonzero(self.near[h >> np.uint64(44)])
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[g] == h[at]
        at, g = at[hit], g[hit]
        row = bs.row_of(at, offs)
        inside = at + self.q <= offs[row + 1]
        at, g, row = at[inside], g[inside], row[inside]
        yield from self.bands(at - offs[row], g, row)

    def bands(self, pos: np.ndarray, g: np.ndarray, row: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same from grams ``g`` at ``pos`` of ascending rows, taken in portions of whole rows."""
        n = (self.begin[g + 1] - self.begin[g]).astype(np.int64)
        total = np.cumsum(n)
        start = 0
        while start < len(g):
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
            end = int(np.searchsorted(row, row[max(end, start + 1) - 1], "right"))
            part = n[start:end]
            where = np.repeat(self.begin[g[start:end]], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            item = self.item[where].astype(np.int64)
            band = (np.repeat(pos[start:end], part) - self.place[where]) // (self.edits[item] + 1)
            # row and item share one number; its place among the portion's leaves 32 bits for the band
            both, pair = np.unique(np.repeat(row[start:end], part).astype(np.int64) * len(self.texts) + item, return_inverse=True)
            code = (pair.astype(np.int64) << 32) + band + (1 << 30)
            code, times = np.unique(np.concatenate([code, code - 1]), return_counts=True)
            which = both[code >> 32]
            met = times >= self.least[which % len(self.texts)]
            yield which[met] // len(self.texts), which[met] % len(self.texts), (code[met] & 0xFFFFFFFF) - (1 << 30)
            start = end

    def found(self, norm: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, passage's number, edits, end, start) of every verified band; places count the row's normalised bytes."""
        if self.framed:
            norm, offs = _framed(norm, offs)
        for rows, items, bands in self.hits(norm, offs):
            k = self.edits[items]
            low = bands * (k + 1)
            for n, e, a, b in align([self.texts[i] for i in items], norm, offs[rows], offs[rows + 1], low, k):
                yield int(rows[n]), int(self.number[items[n]]), e, b - self.framed, a - self.framed


@dataclass
class Passages:
    """A block of the benchmark, indexed by q-grams."""

    ids: list
    parts: list[Index]

    @staticmethod
    def of(items: list[tuple], rate: float = RATE) -> Passages | None:
        if not 0 <= rate < 1:
            raise ValueError("the share of edits must be in [0, 1)")
        raw = [(t or "").encode() for _, t in items]
        norm, offs, _ = normalise(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        whole = norm.tobytes()
        groups: dict[tuple[int, bool], list[tuple[int, bytes, int]]] = {}
        for n, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            if len(text := whole[a:b].strip()) >= LEAST:
                k, framed = int(len(text) * rate), len(text) < WHOLE
                text = b" " + text + b" " if framed else text
                groups.setdefault((min(Q, len(text) // (k + 1)), framed), []).append((n, text, k))
        if not groups:
            return None
        return Passages([i for i, _ in items], [Index.of(*key, *map(list, zip(*rows))) for key, rows in sorted(groups.items())])

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, item id, edits, start, end): the best region of each passage in each row, in code points."""
        norm, offs, places = normalise(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part in self.parts:
            for r, n, e, b, a in part.found(norm, offs):
                if (r, n) not in best or (e, b, -a) < best[r, n]:
                    best[r, n] = (e, b, -a)
        out = []
        for (r, n), (e, b, a) in best.items():
            text = norm[offs[r] : offs[r + 1]]
            letters = np.flatnonzero(text[max(-a, 0) : b] != 32) + max(-a, 0)  # a frame's blanks aren't reported
            first, last = places[offs[r] + letters[0]], places[offs[r] + letters[-1]] + 1
            points = (data[offsets[r] : last] & 0xC0) != 0x80
            out.append((r, self.ids[n], e, int(points[: first - offsets[r]].sum()), int(points.sum())))
        return out


_EDIT, _NONE = 1 << 32, 1 << 60


def align(passages: list[bytes], data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, k: np.ndarray, cells: int = 400_000) -> Iterator[tuple[int, int, int, int]]:
    """(n, edits, start, end) for the n-th passage and text ``data[begin:end]``, where within k edits.

    Passage byte i is compared with text bytes on the diagonals ``low`` to ``low + 2 k + 1`` only: 2 (k + 1) cells a row, rows of
    passages with one budget side by side.  A cell holds edits and, in the lower half, how late the region starts.
    """
    length = np.array([len(p) for p in passages], np.int64)
    order = np.lexsort((length, k))
    at = 0
    while at < len(order):
        budget = k[order[at]]
        width = 2 * (int(budget) + 1)
        upto = min(int(np.searchsorted(k[order], budget, "right")), at + max(1, cells // (width + int(length[order[at]]))))
        yield from _aligned(order[at:upto], passages, length, data, begin, end, low, int(budget), width)
        at = upto


def _aligned(use: np.ndarray, passages: list[bytes], length: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, budget: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    m, rows = length[use], len(use)
    text, pattern = np.full((rows, m[-1] + width), 256, np.int16), np.full((rows, m[-1]), 257, np.int16)
    for c, n in enumerate(use):
        a, b = begin[n] + max(low[n], 0), min(begin[n] + low[n] + m[c] + width, end[n])
        if a < b:
            text[c, max(-low[n], 0) : max(-low[n], 0) + b - a] = data[a:b]
        pattern[c, : m[c]] = np.frombuffer(passages[n], np.uint8)
    steps = np.arange(width, dtype=np.int64) * _EDIT
    place = low[use][:, None] + np.arange(width)
    row = np.where((place >= 0) & (place <= (end - begin)[use][:, None]), (1 << 31) - place, _NONE)  # a region may start anywhere
    done = 0
    for i in range(1, int(m[-1]) + 1):
        seen = text[:, i - 1 : i - 1 + width]
        new = np.where(seen == 256, _NONE, row + (seen != pattern[:, i - 1 : i]) * _EDIT)
        np.minimum(new[:, :-1], row[:, 1:] + _EDIT, out=new[:, :-1])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        row = new
        while done < rows and m[done] == i:  # fewest edits, then the earliest end
            edits = row[done] >> 32
            j = int(np.argmin(edits))
            if edits[j] <= budget:
                n = int(use[done])
                yield n, int(edits[j]), int((1 << 31) - (row[done, j] & 0xFFFFFFFF)), int(low[n]) + i + j
            done += 1


def _parts(benchmark: DataFrame, id_col: str, text_col: str, named: bool) -> list[DataFrame]:
    """The benchmark's passages in parts of about ``BLOCK`` bytes."""
    items = benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].alias("t")).where("t is not null")
    items = (items.where("i is not null") if named else items).distinct()
    n = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK) or 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b) for b in range(n)]


def _block(part: DataFrame, rate: float) -> Passages | None:
    """A bounded part of the benchmark on the driver."""
    return Passages.of([(r.i, r.t) for r in part.orderBy("i", "t").collect()], rate)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, work: Workspace | None = None
) -> DataFrame:
    """(id, item_id, edits, start, end) of every passage found in a document; offsets count the document's code points."""
    spark, schema = docs.sparkSession, f"{id_col} {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}, edits int, start int, end int"
    out, parts, kind = None, _parts(benchmark, item_col, item_text, named=True), to_arrow_type(benchmark.schema[item_col].dataType)
    if len(parts) > 1:
        work = work or Workspace(spark, "leaks")
    for b, part in enumerate(parts):
        block = _block(part, rate)
        if block is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], block: Passages = block, kind: pa.DataType = kind) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, data, offsets in bs.slices(batch.column(1)):
                    if found := block.search(data, offsets):
                        r, items, *cols = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(r, np.int64) + lo)), pa.array(items, kind), *(pa.array(c, pa.int32()) for c in cols)], names=[id_col, "item_id", "edits", "start", "end"])

        rows = bare(docs, id_col, text_col).mapInArrow(run, schema)
        rows = work.table(rows, f"block-{b}") if len(parts) > 1 else rows
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, work: Workspace | None = None
) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage, with their columns: one pass for each block of the benchmark."""
    bound_batches(docs.sparkSession)
    at, parts, before = docs.columns.index(text_col), _parts(benchmark, item_col, item_text, named=False), None
    if len(parts) > 1:
        work = work or Workspace(docs.sparkSession, "clean")
    for b, part in enumerate(parts):
        block = _block(part, rate)
        if block is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], block: Passages = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in bs.slices(batch.column(at)):
                    clean[[lo + f[0] for f in block.search(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if len(parts) > 1:
            docs = work.table(docs, f"block-{b}")
            if before is not None:
                work.drop(before)
            before = f"block-{b}"
    return docs
