"""Batch retrieval: arms over a table of queries, rank fusion, re-scoring by priors, and the routed search.

Every function takes many queries at once.  Scores are rounded to 6 decimals before they are ranked and ties go to the
smallest id, so results don't depend on the order of summation or of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import staged
from . import keys as K

if TYPE_CHECKING:
    from .pruned import Index

#: Published constants of BM25 and of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Weights of the formula, and the least pool.
EXACT, COMMON, CANONICAL, HEAD = 1.0, 1.0, 3.0, 1.5
POOL = 200
#: Bytes of query vectors that are sent to every task at once, bytes of best rows that a task holds, and most queries whose words
#: are sent; more queries are taken in blocks, each written before the next.
VECTOR_BYTES, BEST_BYTES, WORD_BLOCK = 16 << 20, 32 << 20, 4096
#: Scores, or parts of them, that are worked out side by side, and entries whose words are counted at once.
SCORES, COUNTED = 1 << 20, 1024


def pool_size(n: int) -> int:
    return max(POOL, 4 * n)


def ranked(scored: DataFrame, k: int, by: list[Column] | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k best of each query."""
    w = Window.partitionBy("qid").orderBy(*(by or [F.desc("score")]), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Store:
    """What is searched: entries (id, text, commonness, wf_score), their match keys, vectors (id, v) if there are any, and the stored
    ``postings`` (term, id, tf, dl) with the ``corpus`` row (n_docs, avg_dl), without which the ``texts`` (id, text), those of the entries
    if there are no others, are tokenised for each search."""

    entries: DataFrame
    keys: DataFrame
    vectors: DataFrame | None = None
    postings: DataFrame | None = None
    corpus: DataFrame | None = None
    texts: DataFrame | None = None
    #: Stored segments in the place of the postings and the corpus row (``pruned.Index``).
    index: Index | None = None


class Best:
    """The k best entries of each query so far, by falling score and then by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, np.full((queries, k), -np.inf), None

    def add(self, first: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``first`` on (rows) for entries in the order of their ids (columns); -inf for none."""
        rows, k = slice(first, first + len(score)), min(self.k, score.shape[1])
        if self.ids is None:
            self.ids = np.zeros(self.score.shape, ids.dtype)
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        top = np.empty((len(score), k), np.int64)
        for r, bound in enumerate(least):
            at = np.flatnonzero(score[r] >= bound)
            top[r] = at[np.argsort(-score[r, at], kind="stable")[:k]]
        both, own = np.concatenate([self.score[rows], np.take_along_axis(score, top, 1)], 1), np.concatenate([self.ids[rows], ids[top]], 1)
        by = np.argsort(own, axis=1, kind="stable")
        by = np.take_along_axis(by, np.argsort(-np.take_along_axis(both, by, 1), axis=1, kind="stable"), 1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(both, by, 1), np.take_along_axis(own, by, 1)

    def rows(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(qid, id, score) in bounded batches."""
        for at in range(0, len(self.score) if self.ids is not None else 0, 4096):
            q, c = np.nonzero(self.score[at : at + 4096] > -np.inf)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q + at)), pa.array(self.ids[at : at + 4096][q, c], kind), pa.array(self.score[at : at + 4096][q, c])], names=["qid", "id", "score"])


def _blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """Queries in parts of about ``size`` by a hash of qid."""
    n = -(-queries.count() // size)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) for b in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    """Blocks' results."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Corpus:
    """A block of queries' words and the entries' counts of them: entry id, length, and (number of the word, count) for each word.

    ``words`` gives each query's words by number; the entries' rows lie with their ids, so a common word makes no hot key.
    """

    qids: pa.Array
    words: list[np.ndarray]
    known: list[str]
    rows: DataFrame  # id, dl, n array<int>, tf array<int>
    n_docs: int
    avg_dl: float
    df: np.ndarray

    @staticmethod
    def of(queries: DataFrame, docs: DataFrame | None, id_col: str = "id", text_col: str = "text", q_col: str = "q", stored: tuple[DataFrame, DataFrame] | Index | None = None) -> Corpus:
        """From texts, from ``stored`` (postings, corpus) tables, or from segments as the engine keeps them."""
        asked = queries.select("qid", F.array_distinct(T.tokens(q_col)).alias("t")).orderBy("qid").toArrow()  # a block of queries
        t = asked["t"].combine_chunks()
        known = pc.unique(t.flatten()) if len(t) else pa.array([], pa.string())
        numbers = pc.index_in(t.flatten(), value_set=known).to_numpy(zero_copy_only=False) if len(t) else np.zeros(0, np.int32)
        ends = np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False)) if len(t) else np.zeros(0, np.int64)
        words = np.split(numbers.astype(np.int64), ends[:-1]) if len(t) else []
        spark = queries.sparkSession
        if stored is None:
            rows = staged(_counted(docs.select(docs[id_col].alias("id"), T.tokens(text_col).alias("t")), known), "corpus")
            size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
        else:
            table = spark.createDataFrame(pa.table({"term": known, "w": pa.array(range(len(known)), pa.int32())}))  # a block's words
            hits = stored[0].join(F.broadcast(table), "term") if isinstance(stored, tuple) else stored.hits(table)
            rows = staged(hits.groupBy("id", "dl").agg(F.collect_list(F.struct("w", F.col("tf").cast("int").alias("tf"))).alias("x")).select("id", F.col("dl").cast("int").alias("dl"), F.col("x.w").alias("n"), F.col("x.tf").alias("tf")), "corpus")
            size = stored[1].select(F.col("n_docs").alias("n"), F.col("avg_dl").alias("a")).first() if isinstance(stored, tuple) else Row(n=stored.n_docs, a=stored.avg_dl)
        df = np.zeros(len(known), np.int64)
        for r in rows.select(F.explode("n").alias("n")).groupBy("n").agg(F.count("*").alias("df")).collect():  # one row for each word
            df[r.n] = r.df
        return Corpus(asked["qid"].combine_chunks(), words, known.to_pylist(), rows, size.n, size.a or 1.0, df)

    def idf(self) -> np.ndarray:
        return np.log(1 + (self.n_docs - self.df + 0.5) / (self.df + 0.5))

    def top(self, k: int) -> DataFrame:
        """(qid, id, score) of the k best of each query in each task: no more is shuffled."""
        counts = np.bincount(np.concatenate([*self.words, np.zeros(0, np.int64)]), minlength=len(self.known))
        order = np.argsort(np.concatenate([*self.words, np.zeros(0, np.int64)]), kind="stable")
        asking = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])[order]  # queries by word
        begin, idf, avg, qids, kind = np.cumsum(counts) - counts, self.idf(), self.avg_dl, self.qids, dict(self.rows.dtypes)["id"]
        qkind = {"string": "string", "int64": "long", "int32": "int"}[str(qids.type).removeprefix("large_")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, own = Best(len(qids), k), pa.int64()
            for batch in batches:
                own, n = batch.column(0).type, batch.num_rows
                if not n or not len(qids):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                by = np.argsort(ids, kind="stable")
                place = np.empty(n, np.int64)
                place[by] = np.arange(n)
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                word, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                row = np.repeat(place, sizes)
                dl = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), sizes)
                weight = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
                by_row = np.argsort(row, kind="stable")
                row, word, weight, ids = row[by_row], word[by_row], weight[by_row], ids[by]
                for first, last in _spans(np.bincount(row, counts[word], n), max(1, SCORES // len(qids)), SCORES):
                    at = slice(*np.searchsorted(row, (first, last)))
                    times, width = counts[word[at]], last - first
                    who = asking[np.repeat(begin[word[at]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    score = np.bincount(who * width + np.repeat(row[at] - first, times), np.repeat(weight[at], times), len(qids) * width).reshape(len(qids), width)
                    best.add(0, np.where(score > 0, np.round(score, 6), -np.inf), ids[first:last])
            yield from best.rows(qids, own)

        return self.rows.select("id", "dl", "n", "tf").mapInArrow(run, f"qid {qkind}, id {kind}, score double")

    def of_pairs(self, pairs: DataFrame) -> DataFrame:
        """(qid, id, score) of given pairs (qid, id) that share a word."""
        spark = self.rows.sparkSession
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, self.words)]).astype(np.int32), pa.array(np.concatenate([*self.words, np.zeros(0, np.int64)]), pa.int32()))
        asked = spark.createDataFrame(pa.table({"qid": self.qids, "words": lists}))
        idf = spark.createDataFrame(pa.table({"w": pa.array(range(len(self.known)), pa.int32()), "idf": pa.array(self.idf())}))
        shared = pairs.select("qid", "id").join(F.broadcast(asked), "qid").join(self.rows, "id")
        shared = shared.select("qid", "id", "dl", F.explode(F.filter(F.arrays_zip("n", "tf"), lambda x: F.array_contains("words", x["n"]))).alias("x"))
        norm = F.col("x.tf") * (K1 + 1) / (F.col("x.tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(self.avg_dl))))
        scored = shared.join(F.broadcast(idf), F.col("x.n") == F.col("w"))
        return scored.groupBy("qid", "id").agg(F.round(F.sum(F.col("idf") * norm), 6).alias("score"))


def _spans(load: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Spans of up to ``rows`` rows each, whose loads add up to ``most`` at the most (but for a row that has more alone)."""
    upto, first = np.cumsum(load), 0
    while first < len(load):
        last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right"))
        last = max(first + 1, min(last, first + rows, len(load)))
        yield first, last
        first = last


def _counted(docs: DataFrame, known: pa.Array) -> DataFrame:
    """(id, dl, n, tf) of documents (id, tokens): counts of the known words, one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(first, COUNTED)
                t = batch.column(1)
                dl = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
                word = pc.index_in(t.flatten(), value_set=known)
                at = np.flatnonzero(pc.is_valid(word).to_numpy(zero_copy_only=False))
                code = np.repeat(np.arange(len(dl)), dl)[at] * max(len(known), 1) + word.take(pa.array(at)).to_numpy(zero_copy_only=False)
                code, times = np.unique(code, return_counts=True)
                ends = pa.array(np.searchsorted(code, np.arange(len(dl) + 1) * max(len(known), 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code % max(len(known), 1), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl.astype(np.int32)), *lists], names=["id", "dl", "n", "tf"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, dl int, n array<int>, tf array<int>")


def corpora(queries: DataFrame, store: Store) -> list[Corpus]:
    """The store's corpus for each block of queries."""
    stored = store.index or ((store.postings, store.corpus) if store.postings is not None else None)
    texts = store.entries if store.texts is None else store.texts
    return [Corpus.of(block, texts, stored=stored) for block in _blocks(queries, WORD_BLOCK)]


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best entries that share a word with each query, exactly."""
    return text_top(corpora(queries, Store(docs, docs)), k)


def text_top(found: list[Corpus], k: int) -> DataFrame:
    return ranked(_union([c.top(k) for c in found]), k)


def dense(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", v_col: str = "v", q_col: str = "qv") -> DataFrame:
    """(qid, id, score, rank): the k nearest entries by cosine, exactly.

    Queries are broadcast in blocks of bounded bytes; each task multiplies its entries with the block and holds the k best of
    each query, so only k rows per query and task are shuffled.
    """
    held = queries.where(F.col(q_col).isNotNull()).select("qid", F.col(q_col).cast("array<double>").alias("qv"))
    kind, qkind = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["qid"]
    size = (held.select(F.size("qv").alias("n")).first() or [1])[0]
    source = vectors.where(F.col(v_col).isNotNull()).select(id_col, F.col(v_col).cast("array<double>").alias("v"))
    blocks = _blocks(held, max(1, min(VECTOR_BYTES // (8 * max(size, 1)), BEST_BYTES // (16 * k))))
    out = []
    for part in blocks:
        block = part.orderBy("qid").toArrow()
        ids = block["qid"].combine_chunks()
        m = block["qv"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids, m: np.ndarray = m) -> Iterator[pa.RecordBatch]:
            best, own = Best(len(ids), k), pa.int64()
            for batch in batches:
                own = batch.column(0).type
                if not len(ids) or not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                names = batch.column(0).to_numpy(zero_copy_only=False)
                by = np.argsort(names, kind="stable")
                for first in range(0, len(m), step := max(1, SCORES // batch.num_rows)):
                    best.add(first, np.round(m[first : first + step] @ v[by].T, 6) + 0.0, names[by])
            yield from best.rows(ids, own)

        found = source.mapInArrow(run, f"qid {qkind}, id {kind}, score double")
        out.append(staged(found, "nearest") if len(blocks) > 1 else found)
    return ranked(_union(out), k)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)

    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def summed(rows: DataFrame, *sums: Column) -> DataFrame:
    """Sums for each (qid, id) of a union, grouped by the pair as one value.

    Spark 4.1 takes a union whose parts are all dealt out by qid as dealt out by it, but runs it otherwise where parts read a
    reused shuffle, and rows of one pair then stay apart.  It can't tell how the parts are dealt out by the pair.
    """
    return rows.groupBy(F.struct("qid", "id").alias("pair")).agg(*sums).select("pair.*", "score")


def fuse(arms: list[tuple[DataFrame, float]], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, id, score[, rank]): weighted reciprocal rank fusion; an arm that lacks an entry adds nothing."""
    rows = None
    for arm, weight in arms:
        part = arm.select("qid", "id", (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    fused = summed(rows, F.round(F.sum("s"), 6).alias("score"))
    return ranked(fused, k) if k else fused


def with_formula(fused: DataFrame, store: Store, flags: DataFrame, route: str) -> DataFrame:
    """Fused scores plus priors: ja adds commonness and the canonical term, en_word also exactness and heads.

    Only fused rows are touched, never the corpus.
    """
    prior = store.entries.select("id", F.coalesce("commonness", F.lit(0.0)).alias("c"), F.coalesce("wf_score", F.lit(0.0)).alias("wf"))
    rows = fused.drop("rank").join(prior, "id").join(flags, ["qid", "id"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.col("score") + COMMON * F.col("c") + CANONICAL * F.col("wf") * flag("primary") * F.col("c")
    if route == "en_word":
        score = score + EXACT * flag("exact") + HEAD * F.col("wf") * flag("head")
    return rows.select("qid", "id", F.round(score, 6).alias("score"))


def hybrid(queries: DataFrame, store: Store, n: int = 5) -> DataFrame:
    """Unweighted fusion of dense, BM25, and dense within the exact matches."""
    p = pool_size(n)
    flags = K.exact_matches(queries, store.keys)
    arms = [(text_top(corpora(queries, store), p), 1.0)]
    if store.vectors is not None:
        arms += [(dense(queries, store.vectors, p), 1.0), (ranked(_dense_of(queries, store, flags), p), 1.0)]
    return fuse(arms, n)


def _dense_of(queries: DataFrame, store: Store, flags: DataFrame) -> DataFrame:
    """Cosines of the exact matches."""
    pairs = flags.where("exact = 1").join(store.vectors.select("id", "v"), "id").join(queries.where("qv is not null").select("qid", "qv"), "qid")
    return pairs.select("qid", "id", cosine(F.col("v"), F.col("qv")).alias("score"))


def routed(queries: DataFrame, store: Store, n: int = 5) -> DataFrame:
    """(qid, id, score, rank): each query takes the arms and the formula of its route; ``queries`` has qid, q, route[, qv].

    Queries are parted by route before any arm runs, so a route without queries costs next to nothing.
    """
    p = pool_size(n)
    flags = staged(K.exact_matches(queries.where("route <> 'en_sentence'"), store.keys), "flags")
    words = corpora(queries, store)
    by_text = staged(text_top(words, p), "by-text")
    of = {r: queries.where(F.col("route") == r).select("qid") for r in ("ja", "en_word", "en_sentence")}
    only = lambda df, r: df.join(of[r], "qid", "left_semi")
    exact = flags.where("exact = 1")
    # ja: text once, exact by commonness twice
    common = exact.join(store.entries.select("id", F.coalesce("commonness", F.lit(0.0)).alias("score")), "id").select("qid", "id", "score")
    ja = with_formula(fuse([(only(by_text, "ja"), 1.0), (only(ranked(common, p), "ja"), 2.0)], p), store, flags, "ja")
    # en_word: four equal arms, a pool twice as large
    arms = [(only(by_text, "en_word"), 1.0), (ranked(_union([c.of_pairs(only(exact, "en_word")) for c in words]), p), 1.0)]
    sentence = [(only(by_text, "en_sentence"), 1.0)]
    if store.vectors is not None:
        near = staged(dense(queries.where("route <> 'ja'"), store.vectors, p), "near")
        arms += [(only(near, "en_word"), 1.0), (only(ranked(_dense_of(queries, store, flags), p), "en_word"), 1.0)]
        sentence.append((only(near, "en_sentence"), 2.0))
    word = with_formula(fuse(arms, 2 * p), store, flags, "en_word")
    scored = ja.unionByName(word).unionByName(fuse(sentence))
    return ranked(summed(scored, F.max("score").alias("score")), n)


def search(queries: DataFrame, store: Store, n: int = 5, mode: str = "auto", rewrite_mode: str = "heuristic") -> DataFrame:
    """(qid, id, score, rank, q, method): guard, rewrite, candidates in order, route, retrieve, first candidate with results.

    ``queries`` has qid and query[, qv][, japanese]: ``japanese`` is a provider's ranked headwords.  Too long queries have no results.
    """
    ja = queries["japanese"] if "japanese" in queries.columns else None
    vec = "qv" if "qv" in queries.columns else None
    # without query vectors the dense arms stay out
    store = store if vec else Store(store.entries, store.keys, postings=store.postings, corpus=store.corpus, texts=store.texts, index=store.index)
    ok = queries.where(~T.too_long("query"))
    asked = ok.withColumn("__r", T.rewrite(F.lower(T.one_spaced("query")), rewrite_mode, japanese=ja))
    tried = F.array_distinct(F.when(F.lit(mode == "auto"), F.concat(F.col("__r.japanese"), F.array("__r.query"))).otherwise(F.array("__r.query")))
    # a query's own vector stands for its own text; candidates are Japanese and need none
    own = F.col(vec) if vec else F.lit(None).cast("array<double>")
    asked = asked.select("qid", F.col("__r.method").alias("method"), tried.alias("tried"), own.alias("qv"))
    asked = staged(asked.withColumn("owner", F.sha2(F.to_json(F.struct("tried", "qv")), 256)), "questions")
    # equal questions are answered once; every arm reads the rewritten ones, so they are worked out once
    once = asked.groupBy("owner").agg(F.first("tried").alias("tried"), F.first("qv").alias("qv"))
    rows = once.select("owner", F.posexplode("tried").alias("candidate", "q"), "qv").where("q <> ''")
    rows = staged(rows.withColumns({"route": T.route("q"), "qid": F.concat_ws("/", "owner", F.col("candidate").cast("string"))}), "queries")
    if mode == "text":
        found = text_top(corpora(rows, store), n)
    elif mode == "vector":
        found = dense(rows, store.vectors, n)
    elif mode == "hybrid":
        found = hybrid(rows, store, n)
    else:
        found = routed(rows, store, n)
    named = found.join(rows.select("qid", "owner", "candidate", "q"), "qid").drop("qid")
    first = named.groupBy("owner").agg(F.min("candidate").alias("candidate"))
    return named.join(first, ["owner", "candidate"]).join(asked.select("owner", "qid", "method"), "owner").select("qid", "id", "score", "rank", "q", "method")


def first_nonempty(results: DataFrame) -> DataFrame:
    """Of each query's candidates (qid, candidate, ...) the rows of the first that has any."""
    first = results.groupBy("qid").agg(F.min("candidate").alias("candidate"))
    return results.join(first, ["qid", "candidate"])


def promoted(queries: DataFrame, results: DataFrame, segments: DataFrame, n: int = 5) -> DataFrame:
    """Results, and for queries without any their segments as rows of null id and score 0, the first n in order.

    ``segments`` has qid, pos and surface.
    """
    empty = queries.select("qid").distinct().join(results.select("qid").distinct(), "qid", "left_anti")
    w = Window.partitionBy("qid").orderBy("pos")
    rows = segments.join(empty, "qid", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    lifted = rows.select("qid", F.lit(None).cast(dict(results.dtypes)["id"]).alias("id"), F.lit(0.0).alias("score"), "rank", "surface")
    return results.select("qid", "id", "score", "rank", F.lit(None).cast("string").alias("surface")).unionByName(lifted)


def inflection_label(inflected: Column, q: Column) -> Column:
    """The form name of the first row whose surface or kana is the query; null if none."""
    hits = F.filter(inflected, lambda r: (r["surface"] == q) | (r["kana"] == q))
    return F.try_element_at(hits, F.lit(1))["form"]
