"""N-gram Jaccard self-join of texts: MinHash buckets, Bayesian candidate pruning, exact verification.

1. One scan gives each text a 128-bit key of its word sequence and a MinHash signature of its word shingles.
   Texts with one word sequence are copies (similarity 1) and are carried as one node from here on.
2. Signature bands put nodes in buckets; of buckets with the same members one is kept.
   A pair at the threshold 0.8 shares none of the 21 bands of 3 values with probability (1 - 0.8^3)^21 = 2.9e-7.
   Within a bucket, pairs are compared a few MinHash values at a time; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold is below ``tolerance``.
   Survivors are reported as a spanning forest, so the rows stay linear in the number of nodes.
3. The forest's components fetch their texts; within a component pairs are pruned again and the rest
   are verified exactly on the sets of word shingles.
Buckets and components above ``block`` nodes are dealt out as pairs of blocks, each a bounded unit of work:
no group is capped, sampled or gathered in one task.

Word sequences are told apart by 128-bit hashes: of n different texts two share one with probability n^2 / 2^129, which is 4e-19
for 10^10 texts.  Buckets with the same members are told by their size and two sums of 40 and 64 bits of hashed keys; of m
buckets two that differ fall together, and lose a pair that shares no other band, with probability m^2 / 2^105.

Defined cases: a text of fewer than ``width`` words has one shingle, its whole word sequence; a text without words
(or null) links to nothing; white space between words does not count; letter case does.
Repeated rows and null ids keep one result row per input row; ids may be of any orderable type; no rows give no rows.  A very
long text is scanned whole, in one slice.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .components import components
from .shared import Workspace, bare, bound_batches, free, whole_groups

HASHES, BAND = 64, 3
_SALT = np.random.default_rng(11).integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = np.random.default_rng(12).integers(0, 2**31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Least number of equal MinHash values out of ``compared`` for which P(similarity >= threshold) >= tolerance.

    The similarity's prior is uniform, so after m matches its posterior is Beta(m + 1, n - m + 1), whose upper
    tail at the threshold equals P(Binomial(n + 1, threshold) <= m).
    """
    n, tail = compared + 1, 0.0
    for m in range(n + 1):
        tail += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= tolerance:
            return m
    return n


def _digests(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of words and the 16-byte key; then all shingle hashes and their number per row."""
    starts, ends = bs.words(data, offsets)
    per_row = bs.counts(starts, offsets)
    hashes = bs.span_hash(bs.prefix(data), starts, ends)
    rows = np.repeat(np.arange(len(per_row)), per_row)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    keys = np.empty((len(per_row), 2), np.uint64)
    for j, salt in enumerate((0x1234567, 0x89ABCDEF)):
        keys[:, j] = bs.mix(bs.per_row_sum(bs.mix(hashes + bs.mix(place.astype(np.uint64) + np.uint64(salt << 20))), per_row) + per_row.astype(np.uint64))
    grams, at = bs.shingles(hashes, rows, width)
    of = rows[at]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        grams, of = np.concatenate([grams, keys[short, 0]]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    return per_row, keys, grams, np.bincount(of, minlength=len(per_row)).astype(np.int64)


def _signatures(grams: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """rows x HASHES of uint32; rows without shingles get zeros."""
    out = np.zeros((len(per_row), HASHES), np.uint32)
    full = np.flatnonzero(per_row)
    if len(full):
        begins = (np.cumsum(per_row) - per_row)[full]
        low = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((low ^ _SALT[k]) * _ODD[k], begins)
    return out


def features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_words, key, sig) of each text; one pass, no shuffle."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, key binary, sig binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1)):
                n, keys, grams, per_row = _digests(data, offsets, width)
                sig = _signatures(grams, per_row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), _binary(keys), _binary(sig)], names=[id_col, "n_words", "key", "sig"])

    return bare(docs, id_col, text_col).mapInArrow(scan, schema)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(col: pa.ChunkedArray | pa.Array, kind: type, per_row: int) -> np.ndarray:
    data, _ = bs.columns(col)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, per_row)


def _dealt(members: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows (unit, p, q, blk, ...): each member in every unit that compares its block with another or itself."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    df = members.withColumn("blk", F.pmod(F.xxhash64("key", group), blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.when(blocks <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    df = df.withColumns({"p": F.least("blk", "other"), "q": F.greatest("blk", "other")})
    return df.withColumn("unit", F.xxhash64(group, "p", "q")).drop("other")


def _pairs(unit: np.ndarray, cross: np.ndarray, blk: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare within each unit (rows are sorted by unit), in bounded portions."""
    begins = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[begins[1:], len(unit)]
    left, right, held = [], [], 0
    for a, b in zip(begins, ends):
        if b - a < 2:
            continue
        if cross[a]:
            rows = np.arange(a, b)
            one, two = rows[blk[a:b] == blk[a]], rows[blk[a:b] != blk[a]]
        else:
            one = two = None
        step = max(1, most // (b - a))
        for at in range(0, len(one) if one is not None else b - a, step):
            if one is not None:
                part = one[at : at + step]
                i, j = np.repeat(part, len(two)), np.tile(two, len(part))
            else:
                part = np.arange(a + at, min(a + at + step, b))
                n = b - part - 1
                i = np.repeat(part, n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
            left.append(i)
            right.append(j)
            held += len(i)
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, needs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left after the incremental comparison; ``needs`` lists (values compared so far, least matches)."""
    matched, at = np.zeros(len(i), np.int32), 0
    for upto, least in needs:
        matched += (sig[i, at:upto] == sig[j, at:upto]).sum(1, dtype=np.int32)
        keep = matched >= least
        i, j, matched, at = i[keep], j[keep], matched[keep], upto
        if not len(i):
            break
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _needs(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    return [(n, least_matches(n, threshold, tolerance)) for n in range(step, HASHES + 1, step)]


def _candidates(nodes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Spanning forest (a, b) of the node pairs that share a band and survive the pruning."""
    bands = HASHES // BAND
    slots = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * BAND * 4, BAND * 4)) for b in range(bands)])
    banded = nodes.select("key", F.explode(slots).alias("bucket"))
    stats = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").bitwiseAND((1 << 40) - 1)).alias("s"), F.bit_xor(F.xxhash64("key")).alias("x")).where("n > 1")
    stats = stats.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = banded.join(stats, "bucket").join(nodes.select("key", "sig"), "key")
    dealt = _dealt(members, "bucket", "n", block).select("unit", "bucket", "p", "q", "blk", "key", "sig")
    order = ["unit", "bucket", "p", "q"]
    needs = _needs(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, order):
            unit, sig, key = _unit_ids(t, order), _matrix(t["sig"], np.uint32, HASHES), t["key"].combine_chunks()
            p, q, blk = (t[c].to_numpy() for c in ("p", "q", "blk"))
            ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(unit, p != q, blk):
                i, j = _survivors(sig, i, j, needs)
                ii.append(i)
                jj.append(j)
            root = _roots(len(unit), np.concatenate(ii), np.concatenate(jj))
            a = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(root[a]))], names=["a", "b"])

    return dealt.repartition("unit").sortWithinPartitions(*order).mapInArrow(prune, "a binary, b binary")


def _unit_ids(t: pa.Table, order: list[str]) -> np.ndarray:
    """A running number of the unit each row belongs to."""
    change = np.zeros(t.num_rows, bool)
    for c in order:
        col = t[c].combine_chunks()
        if pa.types.is_binary(col.type):
            data, offs = bs.columns(col)
            v = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
            change[1:] |= (v[1:] != v[:-1]).any(1)
        else:
            v = col.to_numpy()
            change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def _shingle_ids(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted numbers of each text's distinct shingles; equal shingles (as word tuples) have equal numbers."""
    known: dict[tuple, int] = {}
    out = []
    for text in texts:
        # exactly the byte-wise words: the six white-space characters only
        w = (text or "").translate(_TO_SPACE).split(" ")
        w = [x for x in w if x]
        grams = set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())
        out.append(np.sort(np.fromiter((known.setdefault(g, len(known)) for g in grams), np.int64, len(grams))))
    return out


_TO_SPACE = {c: " " for c in range(0x09, 0x0E)}


def _jaccard(ids: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact similarities of the row pairs; dense blocks go through one matrix product."""
    rows = np.unique(np.concatenate([i, j]))
    sizes = np.array([len(x) for x in ids], np.int64)
    if len(i) > 8 * len(rows):
        place = np.full(len(ids), -1)
        place[rows] = np.arange(len(rows))
        cols, inverse, times = np.unique(np.concatenate([ids[r] for r in rows]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        shared = times > 1
        number = np.cumsum(shared) - 1
        use = shared[inverse]
        owner, column = owner[use], number[inverse[use]]
        total, step = np.zeros((len(rows), len(rows)), np.float32), max(64, 4_000_000 // len(rows))
        for at in range(0, int(shared.sum()), step):
            part = (column >= at) & (column < at + step)
            m = np.zeros((len(rows), step), np.float32)
            m[owner[part], column[part] - at] = 1
            total += m @ m.T
        common = total[place[i], place[j]].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(ids[a], ids[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    return common / np.maximum(sizes[i] + sizes[j] - common, 1)


def _verified(members: DataFrame, width: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(key, root, links): per unit, each node's root in the unit's forest and the copies it links to there.

    ``members`` has grp, n, key, sig, copies, text.
    """
    order = ["unit", "grp", "p", "q"]
    dealt = _dealt(members, "grp", "n", block).select(*order, "blk", "key", "sig", "copies", "text")
    needs = _needs(threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order):
            unit = _unit_ids(table, order)
            cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for lo, hi in _portions(np.r_[cuts, len(unit)], 2 * block):
                yield from verify_part(table.slice(lo, hi - lo), unit[lo:hi])

    def verify_part(t: pa.Table, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = _matrix(t["key"], np.uint64, 2)
        texts = t["text"].combine_chunks()
        own = np.concatenate([_digests(d, o, width)[1] for _, _, d, o in bs.slices(texts)])
        again = np.lexsort((np.arange(len(unit)), key[:, 1], key[:, 0], unit))
        same = (unit[again][1:] == unit[again][:-1]) & (key[again][1:] == key[again][:-1]).all(1)
        valid = (own == key).all(1)  # a repeated id may have fetched another text
        bad = ~valid
        pos = np.arange(len(unit))
        # keep the first valid row of each (unit, key)
        first = np.ones(len(unit), bool)
        good = again[valid[again]]
        same = (unit[good][1:] == unit[good][:-1]) & (key[good][1:] == key[good][:-1]).all(1)
        first[good[1:][same]] = False
        rows = pos[first & ~bad]
        if not len(rows):
            return
        t, unit = t.take(pa.array(rows)), unit[rows]
        sig, copies = _matrix(t["sig"], np.uint32, HASHES), t["copies"].to_numpy()
        p, q, blk = (t[c].to_numpy() for c in ("p", "q", "blk"))
        ids = _shingle_ids(t["text"].to_pylist(), width)
        links, ii, jj = np.zeros(len(unit), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _pairs(unit, p != q, blk):
            i, j = _survivors(sig, i, j, needs)
            if len(i):
                close = _jaccard(ids, i, j) >= threshold
                i, j = i[close], j[close]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ii.append(i)
                jj.append(j)
        root = _roots(len(unit), np.concatenate(ii), np.concatenate(jj))
        k = t["key"].combine_chunks()
        linked = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([k.take(pa.array(linked)), k.take(pa.array(root[linked])), pa.array(links[linked])], names=["key", "root", "links"])

    return dealt.repartition("unit").sortWithinPartitions(*order).mapInArrow(verify, "key binary, root binary, links long")


def _portions(cuts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive whole units of about ``most`` rows together."""
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
        yield int(cuts[at]), int(cuts[to])
        at = to


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256, work: Workspace | None = None
) -> DataFrame:
    """One row per input row: (id, key, n_words, class_id, rep_key, copies, n_links).

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``threshold``.
    ``class_id`` is the least id of the row's connected component, ``rep_key`` the key of that id's text;
    ``n_links`` counts the other rows whose texts are linked to this row's text, its copies included.
    Rows without words have class_id = id and no links.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = work or Workspace(spark, "ngram-join")
    feats = work.table(features(docs, id_col, text_col, width), "features")
    nodes = work.table(feats.where("n_words > 0").groupBy("key").agg(F.first("sig").alias("sig"), F.count("*").alias("copies"), F.min(id_col).alias("rep")), "nodes")
    forest = work.table(_candidates(nodes, threshold, tolerance, block), "forest")
    coarse = components(spark, forest, work, "coarse")
    sizes = work.table(coarse.groupBy("root").agg(F.count("*").alias("n")), "sizes")  # written, so a large group's partition can be split
    members = coarse.join(sizes, "root").join(nodes, coarse["node"] == nodes["key"]).select(F.col("root").alias("grp"), "n", "key", "sig", "copies", "rep")
    texts = docs.select(docs[id_col].alias("rep_id"), docs[text_col].alias("text"))
    found = work.table(_verified(members.hint("merge").join(texts, F.col("rep").eqNullSafe(F.col("rep_id"))).drop("rep", "rep_id"), width, threshold, tolerance, block), "links")
    classes = components(spark, found.select(F.col("key").alias("a"), F.col("root").alias("b")), work, "classes")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = nodes.select("key", "copies", "rep").join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = work.table(joined.select("key", "copies", "rep", "root", F.coalesce("links", F.lit(0)).alias("links")), "node-links")
    least = work.table(joined.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("least")), "least")
    named = joined.join(least, "root").select("key", "copies", "links", F.col("least.rep").alias("class_id"), F.col("least.key").alias("rep_key"))
    rows = feats.select(id_col, "key", "n_words").join(named, "key", "left")
    return rows.select(
        id_col, "key", "n_words", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col(id_col)).alias("class_id"), F.when(F.col("n_words") > 0, F.col("rep_key")).otherwise(F.col("key")).alias("rep_key"),
        F.when(F.col("n_words") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies"), F.when(F.col("n_words") > 0, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, work: Workspace | None = None) -> DataFrame:
    """``docs`` with one row of each similarity class, that of the least id, and every row without words."""
    work = work or Workspace(docs.sparkSession, "dedup")
    found = work.table(similarity_classes(docs, id_col, text_col, width, threshold, work=work), "classes-of-rows")
    own_id, own_key = (free(c, docs.columns) for c in ("_id", "_key"))
    words = found.where("n_words > 0 and key = rep_key").where(F.col(id_col).eqNullSafe(F.col("class_id")))
    kept = words.groupBy("key").agg(F.min(id_col).alias(own_id)).select(own_id, F.col("key").alias(own_key))
    # repeated rows of one id need a second look at their texts; usually there are none
    repeated = found.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    wordless = found.where("n_words = 0").select(F.col(id_col).alias(own_id), F.col("key").alias(own_key)).distinct()
    ids = kept.unionByName(wordless)
    out = docs.join(ids.hint("merge"), docs[id_col].eqNullSafe(ids[own_id]))  # the list grows with the rows: one plan at every size
    if not repeated:
        return out.select(*[docs[f"`{c}`"] for c in docs.columns])
    return _settle(out, docs.columns, text_col, own_key, width)


def _settle(rows: DataFrame, names: list[str], text_col: str, key: str, width: int) -> DataFrame:
    """Of rows fetched by a repeated id: those whose text has the wanted key, one row per key with words."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    found, words = (free(c, rows.columns) for c in ("_found", "_words"))
    schema = StructType([*[f for f in rows.schema.fields], StructField(found, BinaryType()), StructField(words, LongType())])
    at = rows.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_digests(d, o, width)[:2] for _, _, d, o in bs.slices(batch.column(at))]
            if parts:
                own, n = _binary(np.concatenate([k for _, k in parts])), pa.array(np.concatenate([c for c, _ in parts]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, own, n], names=[*batch.schema.names, found, words])

    good = rows.mapInArrow(add, schema).where(F.col(found) == F.col(key))
    once = good.where(F.col(words) > 0).dropDuplicates([key])
    return once.unionByName(good.where(F.col(words) == 0)).select(*[F.col(f"`{c}`") for c in names])
