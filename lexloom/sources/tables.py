"""Sinks and storage maintenance on any Hadoop file system: staged swaps, metadata rows, copies, exports."""

from __future__ import annotations

import logging
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
SCHEMA_VERSION = 1
#: Temporary folders of one-process applications without a shared folder.
_LOCAL: dict[str, str] = {}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder: what it holds becomes visible at once."""
    fs, s = _fs(spark, source)
    t = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(t) or not fs.rename(s, t):
        raise OSError(f"could not move {source} to {target}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table and swap: readers see the old or the new one, and a failed write leaves the old."""
    spark, staged, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    new, away = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (staged, old))
    if fs.exists(target):
        fs.rename(target, away)
    if not fs.rename(new, target):
        fs.rename(away, target)
        raise OSError(f"could not put {staged} in the place of {path}")
    fs.delete(away, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is missing and Spark runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lexloom-"))
    return f"{root.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: a cut in the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, path: str, text: str) -> str:
    """A small text file, on any file system; its path."""
    fs, p = _fs(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


class Refreshed:
    """A table that is held and read anew once it is older than ``seconds``; if reading fails the old one stays."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock, self.lock = load, seconds, clock, threading.Lock()
        self.held: DataFrame | None = None
        self.since = 0.0

    def get(self) -> DataFrame:
        with self.lock:
            if self.held is None or self.clock() - self.since >= self.seconds:
                try:
                    new = self.load().persist()
                    new.count()
                except Exception:
                    if self.held is None:
                        raise
                    LOG.exception("a table could not be read anew")
                else:
                    old, self.held = self.held, new
                    if old is not None:
                        old.unpersist()
                self.since = self.clock()
            return self.held


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_entries(spark: SparkSession, path: str, common_only: bool = False, limit: int | None = None, band: int = 24) -> DataFrame:
    """Entries of a written table, the common ones, or the first ones by id."""
    from ..operators.entries import common_subset

    df = spark.read.parquet(path)
    df = common_subset(df, band) if common_only else df
    return df.orderBy("id").limit(limit) if limit else df


def write_index(index: DataFrame, path: str, parts: int = 8) -> None:
    """A form index, dealt out by form and sorted, with a Bloom filter of each row group's forms: lookups skip files and row groups by
    their least and largest form, and those that hold no wanted form between them by their filters."""
    sorted_rows = index.repartitionByRange(parts, "form").sortWithinPartitions("form", "ord")
    sorted_rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#form", "true").option("parquet.block.size", ROW_GROUP).parquet(path)


#: Bytes of a row group of a form index, and forms up to which a lookup names them in its filter.
ROW_GROUP, NAMED = 1 << 20, 1000


def lookup(spark: SparkSession, path: str, forms: DataFrame, form_col: str = "form") -> DataFrame:
    """The rows of a written form index for wanted forms.

    Up to ``NAMED`` forms go into the scan's filter, by which row groups without any are skipped; more are joined.
    """
    rows, wanted = spark.read.parquet(path), forms.select(F.col(form_col).alias("form")).where("form is not null").distinct()
    few = [r.form for r in wanted.limit(NAMED + 1).collect()]
    return rows.where(F.col("form").isin(few)) if len(few) <= NAMED else rows.join(wanted, "form", "left_semi")


def write_metadata(spark: SparkSession, path: str, counts: dict[str, DataFrame] | None = None, **facts: str | int) -> None:
    """One row of provenance: schema version, the rows of each of ``counts``, and whatever else is named."""
    row = {"schema_version": SCHEMA_VERSION} | facts | {f"rows_{name}": df.count() for name, df in (counts or {}).items()}
    spark.createDataFrame([tuple(str(v) for v in row.values())], ", ".join(f"{k} string" for k in row)).write.mode("overwrite").json(path)


def up_to_date(spark: SparkSession, path: str, **facts: str | int) -> bool:
    """Whether the metadata row says the same."""
    if not exists(spark, path):
        return False
    have = spark.read.json(path).first().asDict()
    return all(str(have.get(k)) == str(v) for k, v in ({"schema_version": SCHEMA_VERSION} | facts).items())


def content(df: DataFrame) -> DataFrame:
    """(rows, a, b): one row that tells a table's content whatever its order and files: the number of rows and sums of two hashes of them."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashes = df.select(F.spark_partition_id().alias("part"), *(F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in ((1, "a"), (2, "b"))))
    # halves of hashes are summed up as longs where the rows lie, and only these sums as decimals
    halves = [f(F.col(c)).alias(f"{c}{n}") for c in "ab" for n, f in enumerate((lambda h: F.sum(h.bitwiseAND(0xFFFFFFFF)), lambda h: F.sum(F.shiftright(h, 32))))]
    parts = hashes.groupBy("part").agg(F.count("*").alias("rows"), *halves)
    whole = lambda c: (F.sum(F.col(f"{c}1").cast("decimal(28,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(F.col(f"{c}0").cast("decimal(28,0)"))).cast("decimal(38,0)").alias(c)
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), whole("a"), whole("b"))


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Copy a table and check its content; the number of rows.

    Tasks read ranges of the source's files and write the copy, on whatever file systems both are; nothing passes through the driver,
    and no file is held as a whole.  The copy appears by a rename once it agrees.
    """
    aside = f"{target}.new-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(source)
    rows.write.parquet(aside)
    wanted, copied = content(rows).first(), content(spark.read.parquet(aside)).first()
    if wanted != copied:
        remove(spark, aside)
        raise OSError(f"{aside} differs from {source}: {copied} instead of {wanted}")
    move(spark, aside, target)
    return copied["rows"]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def has_end_mark(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether a text file, compressed or not, goes on to its end mark: a cut download doesn't."""
    return spark.read.text(path).where(F.col("value").contains(mark)).limit(1).count() > 0


def expire(spark: SparkSession, path: str, days: int, now: str, ts_col: str = "ts") -> int:
    """Rewrite an event table without what is older than ``days`` before ``now``; the number of rows that went.

    To be scheduled: writes never expire anything themselves.
    """
    from ..operators.events import retained

    old = spark.read.parquet(path)
    kept = retained(old, days, F.lit(now).cast(dict(old.dtypes)[ts_col]), ts_col)
    before, after = old.count(), kept.count()
    if after < before:
        replace_table(kept, path)
    return before - after


def write_daily(events: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Events dealt out by day, each day in a folder of its own."""
    events.withColumn("day", F.to_date(ts_col)).write.mode("append").partitionBy("day").parquet(path)


def expire_daily(spark: SparkSession, path: str, days: int, now: str, ts_col: str = "ts") -> list[str]:
    """Remove what is older than ``days`` before ``now`` from a table dealt out by day; the days that were touched.

    Whole days go without being read; only the day of the edge is rewritten, and no other file is.  0 or less keeps all.
    """
    if days <= 0:
        return []
    rows = spark.read.parquet(path)
    edge = spark.range(1).select((F.lit(now).cast(dict(rows.dtypes)[ts_col]) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("edge")).select("edge", F.to_date("edge").cast("string").alias("day")).first()
    old = sorted(n for n in names(spark, path) if n.startswith("day=") and n[4:] < edge.day)
    touched = [n[4:] for n in old]
    if edge.day in {n[4:] for n in names(spark, path) if n.startswith("day=")}:
        day = rows.where(F.col("day") == F.lit(edge.day).cast("date"))
        kept = day.where(F.col(ts_col) >= F.lit(now).cast(dict(rows.dtypes)[ts_col]) - F.expr(f"INTERVAL {int(days)} DAYS"))
        if kept.count() < day.count():
            kept = staged(kept, "edge-day")
            if kept.limit(1).count():
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            else:
                old.append(f"day={edge.day}")
            touched.append(edge.day)
    for n in old:
        remove(spark, f"{path}/{n}")
    return touched


def write_ordered(df: DataFrame, path: str, key: str, parts: int | None = None) -> None:
    """A table in files of one range of the key each, sorted, beside a small table of fences: each file's least and largest key."""
    ranged = df.repartitionByRange(*([parts] if parts else []), key).sortWithinPartitions(key)
    ranged.write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    fences = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
    fences.coalesce(1).write.parquet(f"{path}/fences")


def page(spark: SparkSession, path: str, key: str, after=None, n: int = 100) -> DataFrame:
    """The ``n`` rows that follow the key ``after`` (from the start, if none): only the files that hold them are read.

    A deep page costs what the first one does, as it is found by its key and not by an offset.  Keys are unique and not null.
    """
    fences = spark.read.parquet(f"{path}/fences")
    ahead = (fences if after is None else fences.where(F.col("high") > F.lit(after))).orderBy("low")
    # the first file holds one row more than ``after`` at least, the following ones count whole
    upto = Window.orderBy("low")
    ahead = ahead.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "first": F.first("n").over(upto)})
    found = ahead.where(F.col("before") <= n + F.col("first")).orderBy("low").limit(n + 1).collect()  # a row for each file that may be needed
    rows = spark.read.schema(spark.read.parquet(f"{path}/rows").schema).parquet(*[r.file for r in found]) if found else spark.read.parquet(f"{path}/rows").limit(0)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(n)


def pages(spark: SparkSession, path: str, key: str, n: int = 100) -> DataFrame:
    """All rows with the number of their page of ``n`` rows (from 0), in one pass: a row's place is the number of rows in the files before
    its own, which the fences tell, and its place in the file.  The pages are those that ``page`` finds one after the other.
    """
    rows = spark.read.parquet(f"{path}/rows")
    upto = Window.orderBy("low")  # a row for each file
    before = spark.read.parquet(f"{path}/fences").select("file", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth")).join(F.broadcast(before), "file")
    return placed.withColumn("page", F.floor((F.col("before") + F.col("nth")) / n).cast("int")).select(*rows.columns, "page")


def export_messages(messages: DataFrame, locales: list[str]) -> DataFrame:
    """(key, one column for each locale) with backslashes, tabs and line feeds escaped."""
    text = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return messages.withColumn("text", text).groupBy("key").pivot("locale", locales).agg(F.first("text"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).sortWithinPartitions(df.columns[0]).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report's rows as a Markdown table; more than ``most`` rows are an error, as a report file takes any number."""
    data = rows.limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"more than {most} rows: use write_report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in data)])


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """All rows of a report as JSON lines or CSV with a header."""
    writer = rows.write.mode("overwrite")
    if kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown kind of report: {kind}")
