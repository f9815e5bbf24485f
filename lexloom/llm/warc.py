"""WARC archives with revisit records for repeated payloads.

Headers (id, payload digest, payload length) are shuffled by digest without their payloads.  Each id's records of a payload are
counted first; each group of equal payloads of at least ``least`` bytes keeps the record of the smallest id as its response,
and the others revisit it.  Counts and groups are written before they are joined, so both sides of each join are plain
shuffles, of which Spark can split the partition of a digest that a third of all records share; the payloads themselves
join by id.  The records are built by SQL expressions and written through Spark's file sink, which commits them on any file
system; a file begins with a warcinfo record and holds a run of complete records, compressed as one gzip stream.  Each task
numbers its files by the bytes of the records so far, so a file is cut before it grows beyond ``file_bytes``; only a single larger
record makes a larger file.

Record ids are unique: an id's only record of a payload is named by both, one of several also by its place in the output.  A
revisit refers to its response by record id where the response is the only one, and always by target URI and date.

Defined cases: ids may be of any type with a text form, which the archives hold in url encoding; a null payload is empty; rows with one id and one payload are all responses or all revisits; where all
ids of a group are null all are responses; line breaks in a url become %0A and %0D.  A very long payload is one record, whole.
Other columns of the pages aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, bound_batches

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF, _END = "\r\n", "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: ten hex digits are eight base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    """A name-based URN for a record."""
    h = F.md5(F.concat_ws("|", F.lit("record"), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def target(url: Column) -> Column:
    """A url as a header's value."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def named(page: Column) -> Column:
    """An id as a header's value, of visible signs only."""
    return F.url_encode(page.cast("string"))


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest)."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    out = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return out.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"))


def revisits(heads: DataFrame, work: Workspace, least: int = 0) -> DataFrame:
    """(page_id, payload_digest, n, refers_to, refers_n, refers_url): one row for each id's records of a payload.

    ``n`` counts the records.  ``refers_to``, null for responses, is the id of the record revisited, ``refers_n`` how many
    records that id has of the payload, and ``refers_url`` the target of one of them.
    """
    own = heads.groupBy("page_id", "payload_digest").agg(F.count("*").alias("n"), F.min("url").alias("url"), F.max("payload_bytes").alias("bytes"))
    own = work.table(own, "records")
    shared = own.where(F.col("bytes") >= least).where("page_id is not null").groupBy("payload_digest").agg(F.min(F.struct("page_id", "n", "url")).alias("first"))
    groups = work.table(shared.select(F.col("payload_digest").alias("digest"), F.col("first.page_id").alias("first"), F.col("first.n").alias("first_n"), F.col("first.url").alias("first_url")), "groups")
    both = own.join(groups, F.col("payload_digest") == F.col("digest"), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    links = [F.when(again, F.col(c)).alias(name) for c, name in (("first", "refers_to"), ("first_n", "refers_n"), ("first_url", "refers_url"))]
    return work.table(both.select("page_id", "payload_digest", "n", *links), "links")


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = 8 << 20, work: Workspace | None = None, **columns: str) -> None:
    """One record for each row of ``pages``; files hold ``file_bytes`` of records at most, or one longer record."""
    bound_batches(pages.sparkSession)
    heads = headers(pages, **columns)
    links = revisits(heads, work or Workspace(pages.sparkSession, "warc"), least)
    links = links.withColumnsRenamed({"page_id": "__id", "payload_digest": "__digest"})
    rows = heads.join(links, heads["page_id"].eqNullSafe(links["__id"]) & (heads["payload_digest"] == links["__digest"]))
    repeat, place = F.col("refers_to").isNotNull(), F.monotonically_increasing_id()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.when(repeat, http).otherwise(F.concat(http, "payload"))
    kind = F.when(repeat, F.lit("revisit")).otherwise(F.lit("response"))
    name = F.when(F.col("n") == 1, record_id(F.col("page_id"), F.col("payload_digest"))).otherwise(record_id(F.col("page_id"), F.col("payload_digest"), place))
    response = F.when(F.col("refers_n") == 1, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")), F.lit(_CRLF))).otherwise(F.lit(""))
    link = F.concat(F.lit(f"WARC-Profile: {PROFILE}{_CRLF}"), response, F.lit("WARC-Refers-To-Target-URI: "), target(F.col("refers_url")), F.lit(f"{_CRLF}WARC-Refers-To-Date: {DATE}{_CRLF}WARC-Refers-To-Page: "), named(F.col("refers_to")), F.lit(_CRLF))
    page = F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Page: "), named(F.col("page_id")), F.lit(_CRLF)))
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind, F.lit(f"{_CRLF}WARC-Record-ID: "), name, F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}WARC-Target-URI: "), target(F.col("url")), F.lit(_CRLF), page, F.when(repeat, link).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), "payload_digest", F.lit(f"{_CRLF}Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )
    lines = rows.select(record.alias("value")).mapInArrow(lambda batches: _filed(batches, file_bytes), "value string, file int, n long")
    lines = lines.sortWithinPartitions("file", "n").select("value", "file")  # the sink takes a file's records together
    lines.write.partitionBy("file").option("lineSep", _END).option("compression", "gzip").text(path)


def _filed(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """A task's records with the numbers of their files; a warcinfo record leads each file."""
    fields, part, file, used = f"software: lexloom{_CRLF}format: WARC File Format 1.1{_CRLF}", TaskContext.get().partitionId(), -1, 0
    n = 0
    for batch in batches:
        values, files = [], []
        for record in batch.column(0).to_pylist():
            size = len(record.encode()) + len(_END)
            if file < 0 or used + size > file_bytes:
                file, used = file + 1, 0
                name = uuid.UUID(hashlib.md5(f"info|{part}|{file}".encode()).hexdigest())
                values.append(f"WARC/1.1{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: <urn:uuid:{name}>{_CRLF}WARC-Date: {DATE}{_CRLF}Content-Type: application/warc-fields{_CRLF}Content-Length: {len(fields)}{_END}{fields}")
                files.append(file)
            used += size
            values.append(record)
            files.append(file)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.int32()), pa.array(np.arange(n, n + len(values)))], names=["value", "file", "n"])
        n += len(values)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length")
        at = end + 8 + n


def read_archives(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of each record.

    A response's length and digest are taken from the payload that is there, and the digest must be the stated one;
    a revisit's are the stated ones of the payload that it stands for.  Ids are given as ``id_type``.
    """
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload string" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse(gzip.decompress(content.as_buffer())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {f['warc-record-id']} is damaged")
                    else:
                        n = int(next(x for x in head.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                    page, refers = f.get("warc-page"), f.get("warc-refers-to-page")
                    rows.append((page, f["warc-target-uri"], kind, n, digest, refers, payload.decode())[: len(names)])
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(names)]], names=names)

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"part-[^/]*$") & (F.col("length") > 0))
    found = files.select("content").mapInArrow(run, schema)
    return found.withColumns({c: F.url_decode(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 0, work: Workspace | None = None) -> DataFrame:
    """Write the pages as archives and return what the archives hold."""
    spark = pages.sparkSession
    work = work or Workspace(spark, "warc")
    write_archives(pages, work.at("archives"), least, work=work)
    return read_archives(spark, work.at("archives"), id_type=dict(pages.dtypes)["page_id"])
