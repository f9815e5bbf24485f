"""Helpers that the training-data operators share: work folders, batch regrouping, small utilities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which the shuffle files of a query go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of written tables under ``spark.checkpoint.dir``.

    Tables written here cut lineage and survive lost executors.  The setting is read from the session;
    a temporary folder is taken only where it is unset (local tests).  With ``tidy`` a write's shuffle files go when it is done.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
        self.named: list[str] = []  # tables of the catalogue that lie here
        self.spark, self.tidy, self.path = spark, tidy, f"{root.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        before = self.spark.conf.get(_TIDY, "false")
        try:
            if self.tidy:
                self.spark.conf.set(_TIDY, "true")
            df.write.option("compression", codec).parquet(self.at(name))
        finally:
            self.spark.conf.set(_TIDY, before)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        self._delete(self.at(name))

    def remove(self) -> None:
        """Remove the folder with all its tables."""
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(self.path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


def file_names(spark: SparkSession, where: str) -> list[str]:
    """The names in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return [x.getPath().getName() for x in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)]


_LOCAL: dict[str, str] = {}


def _local_root(spark: SparkSession) -> str:
    """One temporary folder for each application in one process."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lexloom-"))


def free(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores after it as it needs to differ from the names that are taken."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


#: Bytes of an Arrow batch between the JVM and Python: long texts must not add up to large batches.
ARROW_BYTES = 8 << 20


def bare(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that extra or clashing names of the input can't interfere; bounds Arrow batches too."""
    bound_batches(df.sparkSession)
    return df.select(*[df[c] for c in wanted])


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``ARROW_BYTES`` unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in ("k", "m", "g") else int(now)
    if size <= 0 or size > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded driver-side list as a local relation (no Python on the executors)."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(_names(schema), r)) for r in rows], schema=_arrow(schema)))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (part.split() for part in schema.split(","))])


def held_out(doc_id: str | Column) -> Column:
    """The rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches of rows sorted by ``keys`` so that no group is cut by a table's end."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        lo, hi = 0, table.num_rows - 1  # the first row of the last group
        while lo < hi:
            mid = (lo + hi) // 2
            if [table.column(k)[mid].as_py() for k in keys] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield table.slice(0, lo).combine_chunks()
        rest = table.slice(lo)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
