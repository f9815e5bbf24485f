"""Removal of passages that repeat across documents: a depth-limited radix sort of text windows, most significant digit first.

A window is a string of ``width`` bytes (the first ``width`` bytes of a suffix).  Equal windows are found by sorting windows
into groups by one digit after another, all of a digit's groups at once in a shuffle; a group that lies in one document is done
with and leaves, and groups that are equal to the full depth are exactly the repeated windows.  Digits are chosen so that
neighbouring windows, which share most of their bytes, have them in common and travel as one row:

1. *Pieces.*  A window's anchor is the least of its strings of ``2 * width // 5 + 2`` bytes by a hash, the first of equals.  Which
   one that is depends on the window's bytes alone, so equal windows have equal anchors at equal places.  Windows in a row
   with one anchor form a range, ranges between anchors chosen by hash form a piece.  Pieces with equal bytes hold equal
   windows: those that also stand in an earlier document are decided as a whole.
2. *Anchors.*  Of the rest, a window whose anchor stands in one document only is in no other.
3. *Ranges.*  A range whose bytes also stand in an earlier document is decided as a whole; of equal ranges the earliest stays.
4. *Halves.*  A range's windows begin near the anchor or farther before it; either half has more bytes in common than the
   anchor, and these must stand in two documents.
5. *Windows.*  Groups of equal windows: all but those of the earliest document are decided.

No step gathers a group: groups are counted by partial aggregation, and what is repeated is joined back from written tables, so
that Spark can split a hot key's partition.  A document's own decisions, at most one a byte, meet its text in the end.
Pieces, ranges and windows are compared by 128-bit digests; of n different ones two share one with probability n^2 / 2^129.

Defined cases: a null text is empty; texts shorter than ``width`` bytes lose nothing; matches never cross documents; documents of
one id, repeated rows too, are one document and take nothing from each other; a null id counts as larger than any other, and
null ids as one document.  Ids may be of any orderable type with a text form.  A very long text is scanned whole; its memory is
a small multiple of its bytes.  No rows give no rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import Workspace, bare

#: Bytes of a window; one of so many anchors begins a piece.
WIDTH, CUT = 50, 16
#: Bytes of texts that are scanned at once: the working arrays stay in a core's cache.
SLICE = 1 << 18
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_SPAN = "array<struct<s:int,e:int>>"


def anchor_bytes(width: int) -> int:
    return 2 * width // 5 + 2


def ranges(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, row, hash of the anchor's bytes) of each range; places count ``data``."""
    k = anchor_bytes(width)
    n, w = len(data) - width + 1, width - k + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    pre, (_, down) = bs.prefix(data), bs.powers(len(data) + 1)
    x = pre[k:] - pre[:-k]
    x *= down[: len(x)]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    least = (x & _HIGH) | np.arange(len(x), dtype=np.uint64)
    reach = 1
    while 2 * reach <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    at = (np.minimum(least[:n], least[w - reach : w - reach + n]) & _LOW).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.arange(width, n + width) <= np.repeat(offsets[1:], sizes)[:n]
    change = np.ones(n + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | ~inside[1:] | ~inside[:-1]
    begin, end = np.flatnonzero(inside & change[:-1]), np.flatnonzero(inside & change[1:])
    return begin, end, at[begin], bs.row_of(begin, offsets), x[at[begin]]


def _lists(per_row: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *per_row]).astype(np.int32)), values)


def _spans(groups: list[list[tuple[int, int]]]) -> pa.Array:
    s, e = (pa.array(np.array([x[i] for g in groups for x in g], np.int32)) for i in (0, 1))
    return _lists([len(g) for g in groups], pa.StructArray.from_arrays([s, e], ["s", "e"]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, text, r1, r2): the row's key is a digest of id and text, equal for rows that get the same result."""
    own = bare(docs, id_col, text_col).toDF("d", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = [F.coalesce(F.concat(F.lit("="), F.col("d").cast("string")), F.lit("")), F.col("text")]
    return own.withColumns({"r1": F.xxhash64(F.lit(1), *named), "r2": F.xxhash64(F.lit(2), *named)})


def _longs(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _pieces(keyed: DataFrame, width: int, cut: int, kind: str) -> DataFrame:
    """(r1, r2, d, k1, k2, spans, hs): the different pieces of each text, where their windows begin and end, and their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in bs.slices(batch.column(1), SLICE):
                begin, end, _, row, h = ranges(data, offsets, width)
                if not len(begin):
                    continue
                c = np.flatnonzero((h % np.uint64(cut) == 0) | np.r_[True, row[1:] != row[:-1]])
                last = np.r_[c[1:], len(begin)] - 1
                raw, own = data.tobytes(), offsets[row[c]]
                found: dict[tuple[int, bytes], tuple[int, list[tuple[int, int]]]] = {}
                for n, (r, s, e, o) in enumerate(zip(row[c].tolist(), begin[c].tolist(), end[last].tolist(), own.tolist())):
                    found.setdefault((r, blake2b(raw[s : e + width], digest_size=16).digest()), (n, []))[1].append((s - o, e - o))
                rows, first = pa.array([lo + r for r, _ in found]), np.array([n for n, _ in found.values()])
                size = (last - c + 1)[first]
                anchors = h[np.repeat(c[first], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)].view(np.int64)
                cols = [batch.column(2).take(rows), batch.column(3).take(rows), batch.column(0).take(rows), *_longs([k for _, k in found]), _spans([x for _, x in found.values()]), _lists(size.tolist(), pa.array(anchors))]
                yield pa.RecordBatch.from_arrays(cols, names=["r1", "r2", "d", "k1", "k2", "spans", "hs"])

    return keyed.mapInArrow(run, f"r1 long, r2 long, d {kind}, k1 long, k2 long, spans {_SPAN}, hs array<long>")


def _open(begin: np.ndarray, row: np.ndarray, offsets: np.ndarray, decided: pa.Array) -> np.ndarray:
    """Which ranges lie in no decided span of their row; spans begin and end with ranges."""
    size = int(offsets[-1]) + 1
    edge = np.zeros(size + 1, np.int32)
    n = _lengths(decided)
    if n.sum():
        flat, at = decided.flatten(), np.repeat(offsets[:-1], n)
        np.add.at(edge, at + flat.field("s").to_numpy(zero_copy_only=False), 1)
        np.add.at(edge, at + flat.field("e").to_numpy(zero_copy_only=False) + 1, -1)
    return np.cumsum(edge)[begin] == 0


def _lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of the lists; 0 for null ones."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _contexts(keyed: DataFrame, width: int, kind: str) -> DataFrame:
    """(r1, r2, d, h, k1, k2, off, n, ctx, starts): the different open ranges of each text (d, text, r1, r2, spans, met) whose anchors are met.

    ``ctx`` holds the bytes of the range's ``n`` windows, ``off`` is the anchor's place in it, ``starts`` are its places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1), SLICE):
                begin, end, at, row, h = ranges(data, offsets, width)
                if not len(begin):
                    continue
                met = batch.column(5).slice(lo, hi - lo)
                wanted = met.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                # hashes of all rows of the slice: a hash that only another row has met costs a row, not a result
                use = _open(begin, row, offsets, batch.column(4).slice(lo, hi - lo)) & np.isin(h, wanted)
                raw = data.tobytes()
                found: dict[tuple[int, int, bytes], tuple[int, list[int]]] = {}
                for r, s, e, a, o, x in zip(row[use].tolist(), begin[use].tolist(), end[use].tolist(), at[use].tolist(), offsets[row[use]].tolist(), h[use].view(np.int64).tolist()):
                    found.setdefault((r, a - s, raw[s : e + width]), (x, []))[1].append(s - o)
                rows = pa.array([lo + r for r, _, _ in found], pa.int64())
                off, ctx, starts = [o for _, o, _ in found], [c for _, _, c in found], [s for _, s in found.values()]
                cols = [pa.array([x for x, _ in found.values()], pa.int64()), *_longs([blake2b(b"%d|" % o + c, digest_size=16).digest() for o, c in zip(off, ctx)]), pa.array(off, pa.int32()), pa.array([len(c) - width + 1 for c in ctx], pa.int32()), pa.array(ctx, pa.binary())]
                flat = pa.array(np.array([s for one in starts for s in one], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(3).take(rows), batch.column(0).take(rows), *cols, _lists([len(s) for s in starts], flat)], names=["r1", "r2", "d", "h", "k1", "k2", "off", "n", "ctx", "starts"])

    return keyed.select("d", "text", "r1", "r2", "spans", "met").mapInArrow(run, f"r1 long, r2 long, d {kind}, h long, k1 long, k2 long, off int, n int, ctx binary, starts array<int>")


def _repeated(rows: DataFrame, nameless: bool, *key: str) -> DataFrame:
    """(key, least): the keys that stand in two documents or more, with the least id.

    With ``nameless`` some ids may be null; these are one document after all others, and are counted apart.
    """
    found = [F.min("d").alias("least"), F.max("d").alias("most")]
    if nameless:
        rows = rows.groupBy(*key).agg(*found, F.max(F.col("d").isNull()).alias("unnamed"))
        return rows.where("least < most or least is not null and unnamed").select(*key, "least")
    return rows.groupBy(*key).agg(*found).where("least < most").select(*key, "least")


#: Of a row joined with its key's least id: whether that is an earlier document's.
_LATER = "least is not null and (d is null or least < d)"


def _few(keys: DataFrame) -> DataFrame:
    """Keys or a text's decisions, to be hashed in each partition, so that the far more rows they meet aren't sorted."""
    return keys.hint("shuffle_hash")


def _found(keyed: DataFrame, width: int, cut: int, nameless: bool, work: Workspace) -> DataFrame:
    """(r1, r2, spans): for each text that has any, its windows that also begin in an earlier document, as spans of starts."""
    kind, k, half = dict(keyed.dtypes)["d"], anchor_bytes(width), (width - anchor_bytes(width)) // 2
    both, own = ["k1", "k2"], ["r1", "r2"]
    pieces = work.table(_pieces(keyed, width, cut, kind), "pieces")
    twice = work.table(_repeated(pieces, nameless, *both), "piece-keys")
    whole = pieces.drop("hs").join(_few(twice), both).where(_LATER)
    whole = work.table(whole.groupBy(*own).agg(F.flatten(F.collect_list("spans")).alias("spans")), "whole-pieces")  # one text's spans
    left = pieces.drop("spans").join(_few(twice), both, "left").where(f"not coalesce({_LATER}, false)")
    anchors = work.table(left.select(*own, "d", F.explode("hs").alias("h")), "anchors")
    work.drop("pieces")
    work.drop("piece-keys")

    twice = work.table(_repeated(anchors, nameless, "h").select("h"), "anchor-keys")
    met = work.table(anchors.join(_few(twice), "h").groupBy(*own).agg(F.collect_list("h").alias("met")), "met")  # one text's anchors
    work.drop("anchors")
    work.drop("anchor-keys")

    contexts = _contexts(keyed.join(_few(met.join(whole, own, "left")), own), width, kind)
    contexts = work.table(contexts.withColumn("cid", F.monotonically_increasing_id()), "contexts")  # written, the numbers stay
    work.drop("met")
    twice = work.table(_repeated(contexts, nameless, *both), "context-keys")
    later = work.table(contexts.select("cid", "d", *both).join(_few(twice), both).where(_LATER).select("cid"), "later")
    first = contexts.drop(*own, "starts").join(_few(twice), both, "left").where(f"not coalesce({_LATER}, false)")
    first = work.table(first.select("cid", "d", "h", "off", "n", "ctx"), "first")
    work.drop("context-keys")

    # windows begin up to ``half`` bytes before the anchor, or more than that
    near = F.struct(F.lit(0).alias("side"), F.expr(f"substring(ctx, off + 1, {width - half})").alias("part"), F.greatest(F.col("off") - F.lit(half), F.lit(0)).alias("lo"), F.col("n").alias("hi"))
    far = F.struct(F.lit(1).alias("side"), F.expr(f"substring(ctx, off - {half}, {k + half + 1})").alias("part"), F.lit(0).alias("lo"), F.least(F.col("n"), F.col("off") - F.lit(half)).alias("hi"))
    sides = F.filter(F.array(near, far), lambda x: x["lo"] < x["hi"])
    halves = first.select("cid", "d", "h", "ctx", F.explode(sides).alias("x")).select("cid", "d", "ctx", "x.lo", "x.hi", F.xxhash64("h", "x.side", "x.part").alias("cell"))
    twice = work.table(_repeated(halves.select("cell", "d"), nameless, "cell").select("cell"), "half-keys")
    windows = halves.join(_few(twice), "cell").select("cid", "d", "ctx", F.explode(F.expr("sequence(lo, hi - 1)")).alias("at"))
    text = F.expr(f"substring(ctx, at + 1, {width})")
    windows = work.table(windows.select("cid", "d", "at", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")), "windows")
    work.drop("first")
    work.drop("half-keys")
    twice = work.table(_repeated(windows, nameless, *both), "window-keys")
    single = windows.join(_few(twice), both).where(_LATER).groupBy("cid").agg(F.collect_list("at").alias("ats"))  # one range's windows

    marks = work.table(later.select("cid", F.lit(None).cast("array<int>").alias("ats")).unionByName(single), "marks")
    work.drop("windows")
    work.drop("window-keys")
    ends = F.when(F.col("ats").isNull(), F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("n") - 1).alias("e"))))
    ends = ends.otherwise(F.flatten(F.transform("starts", lambda s: F.transform("ats", lambda a: F.struct((s + a).alias("s"), (s + a).alias("e"))))))
    ranged = work.table(contexts.select("cid", *own, "starts", "n").join(_few(marks), "cid").select(*own, ends.alias("spans")), "ranged")
    out = work.table(whole.unionByName(ranged).groupBy(F.struct(*own).alias("own")).agg(F.flatten(F.collect_list("spans")).alias("spans")).select("own.*", "spans"), "spans")
    for name in ("whole-pieces", "contexts", "later", "marks", "ranged"):
        work.drop(name)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cut: int = CUT, work: Workspace | None = None) -> DataFrame:
    """(id, n_bytes, kept, removed) of each row: the bytes that no repeated window covers, and the maximal removed runs (start, end).

    A byte goes if a string of ``width`` bytes over it also begins in a document with a smaller id, judged on the input.
    """
    if width < 4:
        raise ValueError("windows have 4 bytes at least")
    work = work or Workspace(docs.sparkSession, "repeats", tidy=True)
    keyed = _keyed(docs, id_col, text_col)
    nameless = keyed.where("d is null").limit(1).count() > 0
    spans, kind = _found(keyed, width, cut, nameless, work), dict(keyed.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1), SLICE):
                found = batch.column(2).slice(lo, hi - lo)
                n, rows = _lengths(found), hi - lo
                edge = np.zeros(len(data) + 1, np.int32)
                if n.sum():
                    flat, at = found.flatten(), np.repeat(offsets[:-1], n)
                    np.add.at(edge, at + flat.field("s").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, at + flat.field("e").to_numpy(zero_copy_only=False) + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begin, end = bs.runs(gone, offsets)
                row = bs.row_of(begin, offsets)
                left = np.r_[0, np.cumsum(~gone)][offsets]
                kept = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))]).cast(pa.binary())
                removed = pa.StructArray.from_arrays([pa.array((x - offsets[row]).astype(np.int32)) for x in (begin, end)], ["start", "end"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(np.diff(offsets)), kept, _lists(np.bincount(row, minlength=rows).tolist(), removed)], names=["id", "n_bytes", "kept", "removed"])

    out = keyed.join(_few(spans), ["r1", "r2"], "left").select("d", "text", "spans").mapInArrow(run, f"id {kind}, n_bytes long, kept binary, removed array<struct<start:int,end:int>>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "kept", "removed")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of ``without_repeats``."""
    return found.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql(width: int = WIDTH) -> str:
    """The same by every window of every text: for small tables."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS r FROM documents),
p AS (SELECT r, doc_id, c.c AS c, substr(x, 2 * c.c + 1, {2 * (256 + width - 1)}) AS x FROM d, range(0, len(x) // 2 - {width - 1}, 256) AS c(c)),
w AS (SELECT r, doc_id, c + i.i AS i, md5_number(substr(x, 2 * i.i + 1, {2 * width})) AS s FROM p, range(0, len(x) // 2 - {width - 1}) AS i(i)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN least USING (s) WHERE m IS NOT NULL AND (doc_id IS NULL OR m < doc_id)),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {width} THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, min(i) AS b, max(i) + {width} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
gap AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS since FROM run),
cut AS (SELECT r, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, max(e) AS e, string_agg(substr(x, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) AS k FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""
