"""Training-order materialisation: token ids in fixed-stride binary shards, in the order of a keyed permutation.

1. One scan tokenises the texts, an end mark after each.  The ids of each slice of documents are written once, compressed, with
   the documents' ids, text hashes and numbers of tokens; a unit of ``CHUNKS`` slices is one bucket key of that table.
2. The documents get one global order, by a hash of id, text and copy number, so that the copies of a text stand far apart;
   the tokens before each document in that order say where it begins in one long stream, which is cut into sequences of
   ``length`` ids (the last is filled up with end marks).  Only ids and counts are sorted, never texts or tokens.
3. A keyed Feistel network over the next even power of two, walked along its cycles until it falls below the number of
   sequences, gives each sequence a global slot.
4. The beginnings join the bucketed table, so the tokens aren't shuffled for that; each slice's pieces are dealt out to the
   blocks of slots that they fall into, and one task fills the blocks of a range of shards one after another.
A shard is a file of blocks of ``block_bytes`` at most, a line feed (which Spark's text sink adds) after each block; a slot
is ``length`` little-endian uint16 ids.  Memory is bounded by a block, whatever the size of a shard.  Spark's own file sink
writes and commits the files, on any file system.  Reading resumes at any slot without opening the shards before it.

The order depends on the key and the rows alone, not on files, splits or partitions.  Defined cases: null and empty texts give
their end mark only; no rows give no shards; repeated rows are written as often as they come; ids may be null, repeated
or of any orderable type.  A very long text is one slice by itself, tokenised whole, and spans as many sequences as it needs.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import Workspace, bare, file_names, small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LEVEL = 6
#: Slices of documents in one unit of the written table, tokens that are dealt out together, and the most tasks that fill shards.
CHUNKS, DEALT, TASKS = 16, 1 << 21, 20_000


@lru_cache(maxsize=1)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [bs.mix(np.array([key & (2**64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1)))[0] for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (bs.mix(right + k) & self.mask)
        return (right << self.half) | left

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), keys)
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of ``slots``."""
        return self._walk(slots, self.keys[::-1])


def checks(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number below 2**32 for each id at its place in its sequence; a sequence's checksum is their sum."""
    return (bs.mix(place.astype(np.uint64) << np.uint64(16) | ids.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given length."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _tokenised(docs: DataFrame, id_col: str, text_col: str, ranks: bytes) -> DataFrame:
    """Rows (unit, chunk, docs, hashes, sizes, ids): the documents of one slice and their tokens, end to end."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze, part, read = _encoder(ranks).encode_ordinary, zstandard.ZstdCompressor(LEVEL), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offsets in bs.slices(batch.column(1)):
                hashes = bs.span_hash(bs.prefix(data), offsets[:-1], offsets[1:]).view(np.int64)
                ids = [np.array([*encode(t or ""), END], np.uint16) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ends = pa.array([0, hi - lo], pa.int32())
                whole = [batch.column(0).slice(lo, hi - lo), pa.array(hashes), pa.array([len(x) for x in ids], pa.int32())]
                lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([x])) for x in whole]
                blob = squeeze.compress(np.concatenate(ids).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part << 24 | read // CHUNKS]), pa.array([read % CHUNKS], pa.int32()), *lists, pa.array([blob], pa.binary())], names=["unit", "chunk", "docs", "hashes", "sizes", "ids"])
                read += 1

    return bare(docs, id_col, text_col).mapInArrow(run, f"unit long, chunk int, docs array<{kind}>, hashes array<long>, sizes array<int>, ids binary")


def _bucketed(df: DataFrame, work: Workspace, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``key``, each task its own rows: later joins on the key don't shuffle it."""
    spark, table = df.sparkSession, f"lexloom_{name}_{uuid.uuid4().hex[:12]}"
    work.named.append(table)
    df.write.bucketBy(buckets, key).option("path", work.at(name)).option("compression", "uncompressed").format("parquet").saveAsTable(table)
    return spark.table(table)


def _ranged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out and sorted by ``keys``, with the number of their range as ``part``."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def _before(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """Rows of sorted ranges with ``upto``: the sum of ``value`` over the range's earlier rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(value)).to_numpy().astype(np.int64)
            total = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held + total - n)], names=[*batch.schema.names, "upto"])
            held += int(total[-1]) if len(n) else 0

    return rows.mapInArrow(run, f"{schema}, upto long")


def _copies(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of ranges sorted by (k, h) with ``copy``: how many earlier rows of the range have the same k and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k", "h"))
            new = np.r_[last != (k[0], h[0]), (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
            first = np.where(new, np.arange(len(k)), -held)
            copy = np.arange(len(k)) - np.maximum.accumulate(first)
            last, held = (k[-1], h[-1]), int(copy[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copy)], names=[*batch.schema.names, "copy"])

    return rows.mapInArrow(run, f"{schema}, copy long")


def _beginnings(packed: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """(unit, starts): for each chunk of a unit where its documents begin in the stream; and the stream's length."""
    spark = packed.sparkSession
    rows = packed.select("unit", "chunk", F.posexplode(F.arrays_zip("docs", "hashes", "sizes")).alias("pos", "x"))
    rows = rows.select("unit", "chunk", "pos", F.xxhash64("x.docs", "x.hashes").alias("k"), F.col("x.hashes").alias("h"), F.col("x.sizes").alias("n"))
    schema = "unit long, chunk int, pos int, k long, h long, n int, part int"
    # places among equal rows: the sort may cut a run of copies anywhere
    first = work.table(_copies(_ranged(rows, ["k", "h", "unit", "chunk", "pos"]), schema), "copies")
    carried, last, held = [], None, 0
    for r in sorted(first.groupBy("part").agg(F.min(F.struct("k", "h")).alias("a"), F.max(F.struct("k", "h", "copy")).alias("b")).collect()):  # one row for each range
        same = last == (r.a.k, r.a.h)
        carried.append((r.part, r.a.k, r.a.h, held if same else 0))
        one = (r.a.k, r.a.h) == (r.b.k, r.b.h)
        last, held = (r.b.k, r.b.h), r.b.copy + 1 + (held if same and one else 0)
    more = small(spark, carried, "of long, k0 long, h0 long, more long")
    copy = F.col("copy") + F.when((F.col("k") == F.col("k0")) & (F.col("h") == F.col("h0")), F.col("more")).otherwise(0)
    keyed = first.join(F.broadcast(more), first["part"] == more["of"]).select("unit", "chunk", "pos", "n", F.xxhash64("k", "h", copy).alias("o"), "k", copy.alias("copy"))
    schema = "unit long, chunk int, pos int, n int, o long, k long, copy long, part int"
    sums = work.table(_before(_ranged(keyed, ["o", "k", "copy"]), "n", schema).select("unit", "chunk", "pos", "n", "part", "upto"), "sums")
    work.drop("copies")
    parts = sorted(sums.groupBy("part").agg(F.max(F.col("upto") + F.col("n")).alias("n")).collect())
    begins = np.cumsum([0, *(r.n for r in parts)]).tolist()
    base = small(spark, [(r.part, b) for r, b in zip(parts, begins)], "of long, base long")
    starts = sums.join(F.broadcast(base), sums["part"] == base["of"]).select("unit", "chunk", "pos", (F.col("base") + F.col("upto")).alias("start"))
    # a chunk holds at most a slice's rows, a unit CHUNKS of them
    chunks = starts.groupBy("unit", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "start"))).alias("s"))
    units = chunks.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("chunk", F.col("s.start").alias("s")))).alias("starts"))
    out = work.table(units, "starts")
    work.drop("sums")
    return out, begins[-1]


@dataclass
class Layout:
    """Where sequences, slots, blocks and shards lie."""

    tokens: int
    length: int
    per_block: int
    blocks: int  # of a shard
    order: Feistel

    @property
    def sequences(self) -> int:
        return -(-self.tokens // self.length)

    @property
    def stride(self) -> int:
        return 2 * self.length

    @property
    def per_shard(self) -> int:
        return self.per_block * self.blocks

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    @property
    def per_task(self) -> int:
        """Shards that one task fills."""
        return -(-self.shards // TASKS)

    def full(self, slots: np.ndarray) -> np.ndarray:
        """Tokens in each slot: the last sequence of the stream may have fewer than ``length``."""
        return np.where(self.order.numbers(slots) == self.sequences - 1, self.tokens - (self.sequences - 1) * self.length, self.length)

    def offset(self, slot: int) -> int:
        """Byte of a slot in its shard: a line feed follows each block."""
        within = slot % self.per_shard
        return within * self.stride + within // self.per_block

    def pieces(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents cut at the ends of sequences, in their order: (document, sequence, place there, ids)."""
        first, last = starts // self.length, (starts + sizes - 1) // self.length
        n = last - first + 1
        doc = np.repeat(np.arange(len(starts)), n)
        seq = np.repeat(first, n) + _spread(n)
        a = np.maximum(starts[doc], seq * self.length)
        b = np.minimum((starts + sizes)[doc], (seq + 1) * self.length)
        return doc, seq, a - seq * self.length, b - a


@dataclass
class Shards:
    """What was written, and how to read it."""

    path: str
    layout: Layout
    placed: DataFrame  # chunks with their documents' beginnings

    @property
    def sequences(self) -> int:
        return self.layout.sequences

    @property
    def order(self) -> Feistel:
        return self.layout.order

    def manifest(self) -> DataFrame:
        """(slot, shard, offset, doc_id, n_tokens, checksum, docs) of each sequence; doc_id is that of its first token.

        ``docs`` lists every document in the sequence (doc_id, start, n_tokens), in order; an end mark counts to its document.
        """
        kind, at = dict(self.placed.dtypes)["docs"].removeprefix("array<")[:-1], self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loose = zstandard.ZstdDecompressor()
            for batch in batches:
                for k in range(batch.num_rows):
                    docs, sizes, starts = (batch.column(c)[k].values for c in (0, 1, 2))
                    ids = np.frombuffer(loose.decompress(batch.column(3)[k].as_buffer()), np.uint16)
                    doc, seq, place, n = at.pieces(starts.to_numpy(), sizes.to_numpy().astype(np.int64))
                    begin = np.cumsum(n) - n  # pieces follow each other as the ids do
                    sums = np.add.reduceat(checks(ids, np.repeat(place - begin, n) + np.arange(len(ids))), begin)
                    yield pa.RecordBatch.from_arrays([pa.array(at.order.slots(seq)), pa.array(place.astype(np.int32)), docs.take(pa.array(doc)), pa.array(n.astype(np.int32)), pa.array(sums)], names=["slot", "start", "doc_id", "n", "sum"])

        rows = self.placed.select("docs", "sizes", "starts", "ids").mapInArrow(run, f"slot long, start int, doc_id {kind}, n int, sum long")
        # a sequence has at most ``length`` pieces
        each = rows.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "n"))).alias("p"), F.sum("n").cast("int").alias("n_tokens"), F.sum("sum").alias("checksum"))
        docs = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["n"].alias("n_tokens")))
        within = F.col("slot") % at.per_shard
        offset = within * at.stride + F.floor(within / at.per_block)
        return each.select("slot", F.floor(F.col("slot") / at.per_shard).cast("long").alias("shard"), offset.cast("long").alias("offset"), F.col("p")[0]["doc_id"].alias("doc_id"), "n_tokens", "checksum", docs.alias("docs"))

    def read(self, first: int = 0, count: int | None = None, checksums: bool = False) -> DataFrame:
        """(slot, ids) of ``count`` slots from ``first``, or (slot, found) with checksums: only the shards that hold them are opened."""
        spark, lay = self.placed.sparkSession, self.layout
        length, per = lay.length, lay.per_shard
        last = min(lay.sequences, lay.sequences if count is None else first + count)
        name = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"
        shard = F.regexp_extract("path", name, 1).cast("long") * lay.per_task + F.regexp_extract("path", name, 2).cast("long")
        wanted = range(first // per, max(last - 1, 0) // per + 1)
        paths = [f"{self.path}/{x}" for x in file_names(spark, self.path) if (m := re.search(name, x)) and int(m[1]) * lay.per_task + int(m[2]) in wanted]
        if first >= last or not paths:
            return spark.createDataFrame([], "slot long, found long" if checksums else "slot long, ids binary")
        # all shards are named by their folder; some of them one by one, so that no other is opened
        files = spark.read.format("binaryFile").load(self.path if len(wanted) * per >= lay.sequences else paths).select("path", "content").where(F.col("path").rlike(name))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    a, b = max(0, first - k * per), min(per, last - k * per)
                    for at in range(a, b, 2048):
                        slots = np.arange(at, min(at + 2048, b)) + k * per
                        part = [np.frombuffer(content.as_buffer(), "<u2", count=length, offset=lay.offset(int(s))) for s in slots]
                        if checksums:
                            sums = np.where(np.arange(length) < lay.full(slots)[:, None], checks(np.stack(part), np.arange(length)[None, :]), 0).sum(1)
                        held = pa.array(sums) if checksums else pa.array([r.tobytes() for r in part], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(slots), held], names=["slot", "found" if checksums else "ids"])

        return files.select(shard.alias("k"), "content").mapInArrow(run, "slot long, found long" if checksums else "slot long, ids binary")

    def write(self) -> None:
        """Deal the pieces out to the blocks and fill them."""
        lay = self.layout
        length, per_block, per_task = lay.length, lay.per_block, lay.per_task * lay.blocks

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze, loose, held, size = zstandard.ZstdCompressor(LEVEL), zstandard.ZstdDecompressor(), [], 0

            def flush() -> pa.RecordBatch:
                starts, sizes, ids = (np.concatenate(x) for x in zip(*held))
                _, seq, place, n = lay.pieces(starts, sizes)
                slot = lay.order.slots(seq)
                block = slot // per_block
                by = np.argsort(block, kind="stable")
                begin, n, block = (np.cumsum(n) - n)[by], n[by], block[by]
                ids = ids[np.repeat(begin, n) + _spread(n)]
                spans = np.stack([(slot[by] - block * per_block) * length + place[by], n], 1).astype(np.int32)
                cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
                ends = np.r_[0, np.cumsum(n)][cuts]
                columns = [pa.array((block[cuts[:-1]] // per_task).astype(np.int32)), pa.array(block[cuts[:-1]]), pa.array([squeeze.compress(spans[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary())]
                columns.append(pa.array([squeeze.compress(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.binary()))
                return pa.RecordBatch.from_arrays(columns, names=["task", "block", "spans", "ids"])

            for batch in batches:
                for k in range(batch.num_rows):
                    sizes, starts = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in (0, 1))
                    held.append((starts, sizes, np.frombuffer(loose.decompress(batch.column(2)[k].as_buffer()), np.uint16)))
                    size += len(held[-1][2])
                    if size >= DEALT:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loose, page, now, got = zstandard.ZstdDecompressor(), None, -1, 0

            def done() -> pa.RecordBatch:
                slots = np.arange(now * per_block, min((now + 1) * per_block, lay.sequences))
                if got != lay.full(slots).sum():
                    raise RuntimeError(f"block {now}: {got} of {lay.full(slots).sum()} ids")
                return pa.RecordBatch.from_arrays([pa.array([page[: len(slots) * length].tobytes()], pa.binary())], names=["value"])

            for batch in batches:
                for block, spans, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if block != now:
                        if now >= 0:
                            yield done()
                        page, now, got = np.full(per_block * length, END, "<u2"), block, 0
                    at, n = np.frombuffer(loose.decompress(spans.as_buffer()), np.int32).reshape(-1, 2).T.astype(np.int64)
                    page[np.repeat(at, n) + _spread(n)] = np.frombuffer(loose.decompress(blob.as_buffer()), np.uint16)
                    got += int(n.sum())
            if now >= 0:
                yield done()

        dealt = self.placed.select("sizes", "starts", "ids").mapInArrow(deal, "task int, block long, spans binary, ids binary")
        tasks = -(-lay.shards // lay.per_task)
        filled = dealt.repartitionById(tasks, "task").sortWithinPartitions("block").select("block", "spans", "ids").mapInArrow(fill, "value binary")
        filled.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", lay.blocks).text(self.path)


def write_shards(
    docs: DataFrame, key: int = 1234567, length: int = 1024, shard_bytes: int | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 23, work: Workspace | None = None
) -> Shards:
    """Tokenise ``docs`` and write the shards.

    Without ``shard_bytes`` a shard is one block as long as 4,096 shards suffice, then grows to eight blocks.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "shards")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _bucketed(_tokenised(docs, id_col, text_col, ranks), work, "packed", "unit", buckets)
    starts, tokens = _beginnings(packed, work)
    per_block = max(1, min(block_bytes, shard_bytes or block_bytes) // (2 * length))
    wanted = -(-2 * tokens // (per_block * 2 * length * 4096)) if shard_bytes is None else shard_bytes // (2 * length * per_block)
    blocks = max(1, min(8, wanted) if shard_bytes is None else wanted)
    begins = starts.select(F.col("unit").alias("of"), F.col("starts").alias("all")).hint("shuffle_hash")
    placed = packed.join(begins, packed["unit"] == F.col("of")).select("docs", "sizes", F.element_at("all", F.col("chunk")).alias("starts"), "ids")
    out = Shards(work.at("shards"), Layout(tokens, length, per_block, blocks, Feistel(max(-(-tokens // length), 1), key)), placed)
    if tokens:
        out.write()
    return out


def shard_index(docs: DataFrame, **options) -> DataFrame:
    """Write the shards, read them back, and return each sequence's place and documents with the checksum found there."""
    shards = write_shards(docs, **options)
    if not shards.sequences:
        return shards.manifest().withColumn("intact", F.lit(True))
    found = shards.read(checksums=True)
    return shards.manifest().join(found, "slot", "left").select("slot", "shard", "offset", "doc_id", "n_tokens", "checksum", F.coalesce(F.col("found") == F.col("checksum"), F.lit(False)).alias("intact"), "docs")
