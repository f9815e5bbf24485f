"""A search index that follows its corpus by differences.

The index is a folder of segments.  The first holds every entry; a refresh adds one that holds the new and changed entries only, with
the postings, words and keys of just these, and names the entries of earlier segments that have gone or changed since.  Nothing
stored is rewritten: the number of entries, their length and the words' frequencies are sums over the segments, in which what has gone
counts negatively.  A segment becomes visible by one rename.  ``compact`` writes a segment that takes the place of all before it.

Defined cases: entries without a change write nothing; an entry that has gone may come again; a refresh without changes adds no
segment; ids are unique within one version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables
from . import incremental, pruned


def _segments(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, whether it is a base) of the visible segments, from the last base on."""
    found = sorted((int(n.split("-")[1]), n.endswith("-base")) for n in tables.names(spark, path) if n.startswith("seg-"))
    last = max((i for i, (_, base) in enumerate(found) if base), default=0)
    return found[last:]


def _at(path: str, segment: tuple[int, bool]) -> str:
    return f"{path}/seg-{segment[0]}" + "-base" * segment[1]


def read(spark: SparkSession, path: str) -> pruned.Index:
    segments = _segments(spark, path)

    def table(name: str) -> DataFrame:
        out = None
        for s in segments:
            part = spark.read.parquet(f"{_at(path, s)}/{name}").withColumn("seg", F.lit(s[0]))
            out = part if out is None else out.unionByName(part)
        return out

    size = table("sizes").agg(F.sum("n_docs").alias("n"), F.sum("length").alias("l"), F.sum("n_gone").alias("g")).first()
    terms = table("terms").withColumn("lead", F.when(F.col("b").isNotNull(), F.struct("seg", "b")))
    # what has gone names the segment in which it stands
    gone = None
    for s in segments[1:]:
        part = spark.read.parquet(f"{_at(path, s)}/gone").select("seg", "id")
        gone = part if gone is None else gone.unionByName(part)
    return pruned.Index(table("blocks"), terms, table("forward"), gone, size.n, size.l, size.g)


def _write(spark: SparkSession, path: str, segment: tuple[int, bool], fresh: DataFrame, gone: DataFrame | None, before: tuple[int, int], size: int, lists: DataFrame | None = None) -> None:
    """A segment of the ``fresh`` entries (id, tokens, sig) beside ``before`` (n_docs, length); ``gone`` has rows (seg, id, dl, tokens),
    and ``lists`` the entries' postings if they are there already."""
    folder = f"{path}/new-{uuid.uuid4().hex[:12]}"
    at = lambda name: spark.read.parquet(f"{folder}/{name}")
    forward = fresh.select("id", F.size("tokens").alias("dl"), "tokens", "sig")
    forward.write.parquet(f"{folder}/forward")
    total = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
    new, old = total(at("forward")), (0, 0)
    if gone is not None:
        gone.write.parquet(f"{folder}/gone")
        old = total(at("gone"))
    n, length = new[0] - old[0], new[1] - old[1]
    spark.createDataFrame([(n, length, old[0])], "n_docs long, length long, n_gone long").coalesce(1).write.parquet(f"{folder}/sizes")
    built = (before[1] + length) / (before[0] + n) if before[1] + length else 1.0
    blocks = pruned.blocks(at("forward"), built, size, new[1], new[0]) if lists is None else pruned.dealt(lists, dict(fresh.dtypes)["id"], pruned._parts(spark, new[1]), built, size)
    blocks.withColumns({"b": F.monotonically_increasing_id(), "built": F.lit(built)}).write.parquet(f"{folder}/blocks")
    terms = at("blocks").where("n is not null").select("term", F.col("n").cast("long").alias("df"), F.col("best").alias("top"), "b")
    if pruned._salts(new[0]) > 1:  # else a word lies in one part
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.max_by("b", F.struct("top", -F.col("b"))).alias("b"))
    if gone is not None:
        lost = at("gone").select("tokens").mapInArrow(_words, "term string, n long").groupBy("term").agg((-F.sum("n")).alias("df"))
        terms = terms.unionByName(lost.selectExpr("term", "df", "cast(0 as double) as top", "cast(null as long) as b"))
    terms.withColumn("built", F.lit(built)).write.parquet(f"{folder}/terms")
    tables.move(spark, folder, _at(path, segment))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of entries (tokens): how many of a few entries have each word."""
    for batch in batches:
        for first in range(0, batch.num_rows, pruned.COUNTED):
            row, code, terms = pruned._coded(batch.slice(first, pruned.COUNTED).column(0))
            each = np.unique(code * batch.num_rows + row) // batch.num_rows
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(each, minlength=len(terms)))], names=["term", "n"])


def _tokenised(docs: DataFrame) -> DataFrame:
    """Entries with their words; texts are dealt out before they are cut, as words take more room and cutting them time."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parts aren't put together, as each takes its time
    return docs.select("id", "text", "sig").repartition(parts, "id").select("id", T.tokens("text").alias("tokens"), "sig")


def build(docs: DataFrame, path: str, size: int = pruned.BLOCK) -> None:
    """An index of ``docs`` (id, text, sig), in the place of any that is there; ``sig`` tells whether an entry has changed."""
    before = [n for n, _ in _segments(docs.sparkSession, path)]
    _write(docs.sparkSession, path, (before[-1] + 1 if before else 0, True), _tokenised(docs), None, (0, 0), size)


def refresh(docs: DataFrame, path: str, full: bool = True, size: int = pruned.BLOCK) -> DataFrame:
    """Bring the index up to a new version of its entries: the changes (id, change), which are all that is written."""
    spark = docs.sparkSession
    index, segments = read(spark, path), _segments(spark, path)
    changes = tables.staged(incremental.diff(docs.select("id", "sig"), index.forward.select("id", "sig"), full), "changes")
    if n := changes.count():
        some = lambda rows, but: pruned.among(rows, changes.where(F.col("change") != but), n, ["id"], "left_semi", index.length)
        fresh, gone = _tokenised(some(docs, "gone")), some(index.forward.select("seg", "id", "dl", "tokens"), "new").select("seg", "id", "dl", "tokens")
        _write(spark, path, (segments[-1][0] + 1, False), fresh, gone, (index.n_docs, index.length), size)
    return changes


def overhead(spark: SparkSession, path: str) -> float:
    """The share of stored entries that don't count any more."""
    index = read(spark, path)
    return 1 - index.n_docs / max(index.stored.count(), 1)


def compact(spark: SparkSession, path: str, size: int = pruned.BLOCK) -> None:
    """One segment in the place of all: entries that have gone leave the files.  Earlier segments stay for those who still read them."""
    index, segments = read(spark, path), _segments(spark, path)
    live = index.forward.select("id", "tokens", "sig")
    _write(spark, path, (segments[-1][0] + 1, True), live, None, (0, 0), size, _live_lists(index))


def sweep(spark: SparkSession, path: str) -> int:
    """Remove the segments that a later base has taken the place of, and what failed writes have left; how many."""
    kept = {_at(path, s).rsplit("/", 1)[1] for s in _segments(spark, path)}
    old = [n for n in tables.names(spark, path) if n not in kept]
    for n in old:
        tables.remove(spark, f"{path}/{n}")
    return len(old)


def _live_lists(index: pruned.Index) -> DataFrame:
    """The stored postings of the entries that count, packed for ``pruned.dealt``."""
    kind, salts, parts = dict(index.stored.dtypes)["id"], pruned._salts(index.n_docs), pruned._parts(index.blocks.sparkSession, index.length)
    if index.n_gone > pruned.GONE:
        return postings(index).select("term", "id", "tf", "dl").mapInArrow(partial(_single, salts, parts), pruned._listed(kind))
    rows = [] if index.gone is None else index.gone.select("seg", "id").toArrow()  # a bounded number
    away = {s: rows.filter(pc.field("seg") == s)["id"].combine_chunks() for s in pc.unique(rows["seg"]).to_pylist()} if len(rows) else {}
    shared = index.blocks.sparkSession.sparkContext.broadcast(away)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            seg, (ids, *others) = batch.column(0).to_numpy(), (batch.column(c) for c in (2, 3, 4))
            sizes = pc.list_value_length(ids).to_numpy()
            at, flat, stays = np.repeat(seg, sizes), ids.flatten(), np.ones(int(sizes.sum()), bool)
            for s, gone in shared.value.items():
                own = np.flatnonzero(at == s)
                if len(own):
                    stays[own] = ~pc.is_in(flat.take(pa.array(own)), value_set=gone).to_numpy(zero_copy_only=False)
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[stays], minlength=len(sizes))
            offsets, mask = pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), pa.array(stays)
            lists = [pa.ListArray.from_arrays(offsets, v.filter(mask)) for v in (flat, *(o.flatten() for o in others))]
            part = pruned._part(batch.column(1), turn % salts, parts)
            order = np.argsort(part, kind="stable")
            order = order[left[order] > 0]
            at = pa.array(order)
            yield pruned._packed(part[order], batch.column(1).take(at), left[order], *(v.take(at).flatten() for v in lists))
            turn += 1

    return index.blocks.select("seg", "term", "ids", "tfs", "dls").mapInArrow(keep, pruned._listed(kind))


def _single(salts: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists of postings (term, id, tf, dl)."""
    turn = TaskContext.get().partitionId()
    for batch in batches:
        part = pruned._part(batch.column(0), turn % salts, parts)
        order = np.argsort(part, kind="stable")
        yield pruned._packed(part[order], batch.column(0).take(pa.array(order)), np.ones(len(order), np.int64), *(batch.column(c).take(pa.array(order)) for c in (1, 2, 3)))
        turn += 1


def postings(index: pruned.Index) -> DataFrame:
    """(term, id, tf, dl) of the entries that count."""
    rows = index.blocks.select("seg", "term", "tfs", "dls", F.posexplode("ids").alias("n", "id"))
    return index.live(rows.select("seg", "term", "id", F.get("tfs", "n").alias("tf"), F.get("dls", "n").alias("dl"))).drop("seg")


def frequencies(index: pruned.Index) -> DataFrame:
    """(term, df) of the words that some entry has."""
    return index.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
