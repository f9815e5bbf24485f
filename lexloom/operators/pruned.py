"""Pruned BM25 search over stored postings: exact best entries without scoring every entry that shares a word.

Postings are stored in blocks of falling contribution, each with the largest contribution of its postings.  A batch of queries is
answered by joins, in four steps that each raise a safe lower bound of the query's k-th best score:

1. the leading block of each word gives partial scores, whose k-th best is a first bound;
2. words are put in order of their largest contribution; those that together can't reach the bound are passive, and an entry with
   passive words only can't be among the best.  Of the other words those blocks are read whose contribution, with the most that all
   other words can add, reaches the bound; entries whose sum with the most of the passive words reaches it are candidates;
3. the exact scores of the most promising candidates give a better bound;
4. only the candidates that can still reach that are scored exactly, from the stored tokens.

What a block can contribute was worked out with the average length of its build.  Under a longer average no contribution grows by
more than the ratio of the two, so bounds are multiplied by that; a shorter average only lowers contributions.  So blocks stay valid
while the corpus changes (see ``maintained``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import staged
from .retrieval import K1, B, _counted, _spans, ranked

#: Postings of a block.
BLOCK = 32
#: Scores are rounded to six decimals before they are ranked; bounds give way by more than that.
SLACK = 1e-5
#: Words of a part of the postings, most postings of a word that meet, entries and words that are counted at once, and cells and pairs
#: that are scored at once.
RANGE, HOT, COUNTED, TOKENS, CELLS, PAIRS = 1 << 20, 1 << 20, 8192, 1 << 21, 1 << 20, 1 << 16
#: Entries that have gone, up to which they are sent to the tasks.
GONE = 1 << 20
#: Pairs up to which their entries are picked before they are counted, and queries' words that are sent to the tasks at once.
FEW, WORDS = 1 << 18, 1 << 16


def weight(tf: Column, dl: Column, avg_dl: Column | float) -> Column:
    """A posting's contribution without its word's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def rarity(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def tokenised(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, dl, tokens): the forward table."""
    words = docs.select(F.col(id_col).alias("id"), T.tokens(text_col).alias("tokens"))
    return words.select("id", F.size("tokens").alias("dl"), "tokens")


def blocks(forward: DataFrame, avg_dl: float, size: int = BLOCK, length: int | None = None, entries: int = 0) -> DataFrame:
    """The blocks (see ``dealt``) of entries (id, dl, tokens): the words of a few entries are shuffled as one row for each part."""
    kind, parts = dict(forward.dtypes)["id"], _parts(forward.sparkSession, length)
    return dealt(forward.select("id", "dl", "tokens").mapInArrow(partial(_lists, parts, _salts(entries)), _listed(kind)), kind, parts, avg_dl, size)


def _parts(spark: SparkSession, length: int | None) -> int:
    """Parts of the postings: so many for ``length`` words together that none grows with the corpus."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) if length is None else max(1, -(-length // RANGE))


def _salts(entries: int) -> int:
    """Parts that a word's postings go to: no more than ``HOT`` go to one, by which a task's memory is bounded."""
    return max(1, -(-entries // HOT))


def _listed(kind: str) -> str:
    return f"part int, terms array<string>, sizes array<int>, ids array<{kind}>, tfs array<int>, dls array<int>"


def dealt(lists: DataFrame, kind: str, parts: int, avg_dl: float, size: int = BLOCK) -> DataFrame:
    """(term, best, n, ids, tfs, dls): lists of postings (see ``_packed``) joined and cut anew, those of a word in a part in blocks of
    falling contribution; ``n`` is their number at the first of these blocks, else null."""
    return lists.repartitionById(parts, "part").drop("part").mapInArrow(partial(_joined, avg_dl, size), f"term string, best double, n int, ids array<{kind}>, tfs array<int>, dls array<int>")


def _part(terms: pa.Array, salt: int, parts: int) -> np.ndarray:
    """The part that each word's postings go to."""
    return (pd.util.hash_array(terms.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False) % parts + salt).astype(np.int64) % parts


def _packed(part: np.ndarray, terms: pa.Array, sizes: np.ndarray, ids: pa.Array, tfs: pa.Array, dls: pa.Array) -> pa.RecordBatch:
    """(part, terms, sizes, ids, tfs, dls): one row for each part, with its words and how many postings each has; words are sorted by part."""
    which, first = np.unique(part, return_index=True)
    ends = np.r_[first, len(part)].astype(np.int32)
    upto = np.r_[0, np.cumsum(sizes)][ends].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), v) for at, v in ((ends, terms), (ends, pa.array(sizes, pa.int32())), (upto, ids), (upto, tfs), (upto, dls))]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *lists], names=["part", "terms", "sizes", "ids", "tfs", "dls"])


def _lists(parts: int, salts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists of entries (id, dl, tokens): words are counted where they lie, a list for each word of a few entries."""
    turn = TaskContext.get().partitionId()
    for batch in batches:
        for first, end in _spans(batch.column(1).to_numpy(zero_copy_only=False), COUNTED, TOKENS):
            few = batch.slice(first, end - first)
            row, code, terms = _coded(few.column(2))
            part = _part(terms, turn % salts, parts)
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key, tf = np.unique(rank[code] * few.num_rows + row, return_counts=True)
            code, row = np.divmod(key, few.num_rows)
            at = pa.array(row)
            yield _packed(part[order], terms.take(pa.array(order)), np.bincount(code, minlength=len(order)), few.column(0).take(at), pa.array(tf, pa.int32()), few.column(1).take(at))
            turn += 1


def _joined(avg_dl: float, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a part's lists (terms, sizes, ids, tfs, dls), words in order."""
    rows = [batch for batch in batches if batch.num_rows]  # a part, which is bounded
    if not rows:
        return
    flat = lambda c: pa.concat_arrays([batch.column(c).flatten() for batch in rows])
    words, (sizes, ids, tf, dl) = flat(0).dictionary_encode(), map(flat, range(1, 5))
    if not len(ids):
        return
    inorder = pc.sort_indices(words.dictionary)
    rank = np.empty(len(inorder), np.int64)
    rank[inorder.to_numpy()] = np.arange(len(inorder))
    group = np.repeat(rank[words.indices.to_numpy()], sizes.to_numpy())
    tfs, dls = tf.to_numpy().astype(np.float64), dl.to_numpy().astype(np.float64)
    w = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * dls / avg_dl))  # as ``weight``
    place = ids.to_numpy() if pa.types.is_integer(ids.type) else pc.rank(ids, tiebreaker="first").to_numpy()
    order = np.lexsort((place, -w, group))
    # a word's blocks, one after another
    n = np.bincount(group)
    first, many = np.cumsum(n) - n, -(-n // size)
    of = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(of)) - (np.cumsum(many) - many)[of]
    starts = first[of] + nth * size
    offsets, at = pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(order)
    lists = [pa.ListArray.from_arrays(offsets, v.take(at)) for v in (ids, tf, dl)]
    terms = words.dictionary.take(inorder).take(pa.array(of))
    yield pa.RecordBatch.from_arrays([terms, pa.array(w[order[starts]]), pa.array(n[of].astype(np.int32), mask=nth > 0), *lists], names=["term", "best", "n", "ids", "tfs", "dls"])


def _coded(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word's number) of all tokens, and the words."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sizes), dtype=np.int64), sizes), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


@dataclass
class Index:
    """Stored segments (see ``maintained``): blocks (seg, b, term, best, n, built, ids, tfs, dls), terms (seg, term, df, top, built, lead),
    forward (seg, id, dl, tokens, sig) and the ``n_gone`` rows of gone (seg, id), the entries of a segment that don't count any more;
    ``n_docs`` entries of ``length`` words together.  ``built`` is the average length by which a segment's contributions were worked out."""

    blocks: DataFrame
    terms: DataFrame
    stored: DataFrame
    gone: DataFrame | None
    n_docs: int
    length: int
    n_gone: int = 0

    @property
    def avg_dl(self) -> float:
        return self.length / self.n_docs if self.length else 1.0

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (seg, id, ...) of entries that count."""
        if self.gone is None:
            return rows
        return among(rows, self.gone, self.n_gone, ["seg", "id"], "left_anti", self.length).select(*rows.columns)

    @property
    def forward(self) -> DataFrame:
        return self.live(self.stored)

    def hits(self, words: DataFrame) -> DataFrame:
        """(w, id, tf, dl): the postings of words (term, w) that count; blocks of other words aren't unpacked."""
        rows = self.blocks.join(F.broadcast(words), "term").select("seg", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return self.live(rows.select("seg", "w", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))).drop("seg")

    def grown(self, value: Column) -> Column:
        """A bound on a contribution under today's average length."""
        return value * F.greatest(F.lit(1.0), F.lit(self.avg_dl) / F.col("built"))


def among(rows: DataFrame, ids: DataFrame, n: int, on: list[str], how: str, length: int) -> DataFrame:
    """Rows joined (semi or anti) with ``n`` rows of ids: as long as these are few they are broadcast, and the rows stay where they are.

    Else both are dealt out, to so many parts for ``n`` and the ``length`` of all words together that none that is sorted grows with the corpus.
    """
    if n <= GONE:
        return rows.join(F.broadcast(ids), on, how)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // RANGE), -(-n // COUNTED))
    return rows.repartition(parts, *on).join(ids.repartition(parts, *on), on, how)


def _kth(scored: DataFrame, k: int, name: str) -> DataFrame:
    """(qid, bound): each query's k-th best score, for the queries that have so many."""
    return ranked(scored, k).where(F.col("rank") == k).select("qid", F.col("score").alias(name))


def _asked(queries: DataFrame, index: Index, q_col: str) -> DataFrame:
    """(qid, term, df, idf, most, lead) of the known words of queries; ``most`` is the most that a word can add."""
    # words are written first: Spark sees how few they are, and the stored words stay where they are
    words = staged(queries.select("qid", F.explode(F.array_distinct(T.tokens(q_col))).alias("term")), "words")
    parts = words.join(index.terms, "term").withColumn("top", index.grown(F.col("top")))  # a row for each segment with the word
    known = parts.groupBy("qid", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.max_by("lead", "top").alias("lead")).where("df > 0")
    known = known.withColumn("idf", rarity(F.lit(index.n_docs), F.col("df")))
    return known.select("qid", "term", "df", "idf", (F.col("idf") * F.col("top")).alias("most"), "lead")


def _postings(read: DataFrame, index: Index) -> DataFrame:
    """(qid, id, part): contributions of the postings of read blocks (qid, idf, seg, ids, tfs, dls) that count."""
    rows = read.select("qid", "idf", "seg", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("qid", "seg", F.col("p.ids").alias("id"), (F.col("idf") * weight(F.col("p.tfs"), F.col("p.dls"), index.avg_dl)).alias("part"))
    return index.live(rows).drop("seg")


@dataclass
class Words:
    """A block of queries, in the order of their numbers, and their words: query i has the words ``word[begin[i] : begin[i + 1]]``."""

    block: Column | None
    qids: np.ndarray
    begin: np.ndarray
    word: np.ndarray
    known: pa.Array
    idf: np.ndarray

    @staticmethod
    def of(asked: DataFrame) -> list[Words]:
        n = max(1, -(-asked.count() // WORDS))
        blocks = [F.pmod(F.xxhash64("qid"), F.lit(n)) == b for b in range(n)] if n > 1 else [None]
        return [Words._of(asked, block) for block in blocks]

    @staticmethod
    def _of(asked: DataFrame, block: Column | None) -> Words:
        t = (asked if block is None else asked.where(block)).select("qid", "term", "idf").orderBy("qid", "term").toArrow()  # a block
        qids, begin = np.unique(t["qid"].to_numpy(), return_index=True)
        known = pc.unique(t["term"].combine_chunks())
        word = pc.index_in(t["term"].combine_chunks(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        idf = np.zeros(len(known))
        idf[word] = t["idf"].to_numpy()
        return Words(block, qids, np.r_[begin, len(word)], word, known, idf)


def _exact(pairs: DataFrame, words: list[Words], index: Index) -> DataFrame:
    """(qid, id, score) of pairs, from the stored tokens: each entry's words are counted once, whatever the number of its queries."""
    kind, few, out = dict(index.stored.dtypes)["id"], pairs.count() <= FEW, None
    for w in words:
        wanted = (pairs if w.block is None else pairs.where(w.block)).groupBy("id").agg(F.collect_list("qid").alias("qids"))  # a block's queries at most
        docs = index.stored.join(F.broadcast(wanted.select("id")), "id", "left_semi") if few else index.stored
        rows = _counted(docs.select(F.struct("seg", "id").alias("id"), F.col("tokens").alias("t")), w.known).where("size(n) > 0")
        # what has gone leaves once words are counted, so that no tokens are shuffled
        rows = index.live(rows.select("id.seg", "id.id", "dl", "n", "tf")).drop("seg").join(wanted, "id")
        part = rows.select("qids", "id", "dl", "n", "tf").mapInArrow(partial(_scored, w.qids, w.begin, w.word, w.idf, index.avg_dl), f"qid long, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return out


def _scored(qids: np.ndarray, begin: np.ndarray, word: np.ndarray, idf: np.ndarray, avg_dl: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, id, score) of entries (qids, id, dl, n, tf): their queries, and the numbers and counts of their known words."""
    sizes = np.diff(begin)
    for batch in batches:
        step = max(1, CELLS // max(len(idf), 1))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            lengths = lambda c: pc.list_value_length(part.column(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            row, tf = np.repeat(np.arange(part.num_rows), lengths(3)), flat(4)
            dl = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[row]
            cells = np.zeros((part.num_rows, len(idf)))
            n = flat(3)
            cells[row, n] = idf[n] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))
            who, query = np.repeat(np.arange(part.num_rows), lengths(0)), np.searchsorted(qids, flat(0))
            for a in range(0, len(who), PAIRS):
                r, q = who[a : a + PAIRS], query[a : a + PAIRS]
                times = sizes[q]
                pair = np.repeat(np.arange(len(q)), times)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + begin[q][pair]
                score = np.round(np.bincount(pair, cells[r[pair], word[at]], len(q)), 6)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), part.column(1).take(pa.array(r)), pa.array(score)], names=["qid", "id", "score"])


def search(queries: DataFrame, index: Index, k: int, q_col: str = "q") -> tuple[DataFrame, DataFrame]:
    """((qid, id, score, rank): the k best entries that share a word with each query, exactly; (qid, had, read): the postings of its
    words, and how many of them were read)."""
    # queries go by numbers, as what names them may be as long as their text
    named = staged(queries.select(F.col("qid").alias("name")).distinct().withColumn("qid", F.monotonically_increasing_id()), "names")
    numbered = queries.select(F.col("qid").alias("name"), q_col).join(named, "name")
    asked = staged(_asked(numbered, index, q_col), "asked")
    words = Words.of(asked)
    at = lambda df: df.join(index.blocks.drop("term"), (F.col("lead.seg") == F.col("seg")) & (F.col("lead.b") == F.col("b")))
    parts = _postings(at(asked.select("qid", "idf", "lead")), index).groupBy("qid", "id").agg(F.sum("part").alias("score"))
    bound = staged(_kth(parts, k, "bound"), "first-bounds")
    # passive words: the least ones that together stay below the bound
    upto = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "term"))
    plan = asked.join(bound, "qid", "left").withColumn("passive", F.coalesce(upto < F.col("bound") - SLACK, F.lit(False)))
    whole = Window.partitionBy("qid")
    plan = plan.withColumns({"all": F.sum("most").over(whole), "rest": F.coalesce(F.sum(F.when(F.col("passive"), F.col("most"))).over(whole), F.lit(0.0))})
    plan = staged(plan, "plan")
    grown = F.col("idf") * index.grown(F.col("best"))
    read = plan.where("not passive").join(index.blocks, "term").where(F.col("bound").isNull() | (grown + F.col("all") - F.col("most") >= F.col("bound") - SLACK))
    read = staged(read.select("qid", "idf", "seg", "ids", "tfs", "dls"), "read-blocks")
    sums = _postings(read, index).groupBy("qid", "id").agg(F.sum("part").alias("part"))
    limits = plan.select("qid", "bound", "rest").distinct()
    found = sums.join(limits, "qid").where(F.col("bound").isNull() | (F.col("part") + F.col("rest") >= F.col("bound") - SLACK))
    found = staged(found.select("qid", "id", "part", "rest"), "candidates")
    promising = staged(ranked(found.select("qid", "id", F.col("part").alias("score")), 2 * k).select("qid", "id"), "promising")
    ahead = staged(_exact(promising, words, index), "ahead")
    better = _kth(ahead, k, "better")
    left = found.join(better, "qid", "left").where(F.col("better").isNull() | (F.col("part") + F.col("rest") >= F.col("better") - SLACK))
    left = staged(left.select("qid", "id").join(ahead.select("qid", "id"), ["qid", "id"], "left_anti"), "left")
    scored = ahead.unionByName(_exact(left, words, index))
    counts = [
        asked.select("qid", F.col("df").alias("had"), F.lit(0).alias("read")),
        read.select("qid", F.lit(0).alias("had"), F.size("ids").alias("read")),
        at(plan.where("passive").select("qid", "lead")).select("qid", F.lit(0).alias("had"), F.size("ids").alias("read")),
        # a candidate's tokens tell its postings of all words
        ahead.select("qid", "id").unionByName(left).join(plan.where("passive").groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", F.lit(0).alias("had"), F.col("n").alias("read")),
    ]
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    report = report.groupBy("qid").agg(F.sum("had").cast("long").alias("had"), F.sum("read").cast("long").alias("read"))
    by_name = lambda df, *columns: df.join(named, "qid").select(F.col("name").alias("qid"), *columns)
    return by_name(ranked(scored.where("score > 0"), k), "id", "score", "rank"), by_name(report, "had", "read")
