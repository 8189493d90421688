"""Helpers that the operators of this subpackage share: tables in the shared folder, bounded broadcasts, row normalisation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows: rows of the corpus tables are whole texts, and a worker and its executor hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Hands memory that this worker has freed back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInPandas or mapInArrow; as a task starts and ends, freed memory goes back, as workers stay for tasks of other stages."""

    def whole(batches: Iterator) -> Iterator:
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def series_udf(f: Callable, kind):
    """A pandas UDF of series, as a stream of batches, that hands freed memory back as trimmed() does."""

    def whole(batches: Iterator) -> Iterator:
        trim()
        try:
            for b in batches:
                yield f(*b) if isinstance(b, tuple) else f(b)
        finally:
            trim()

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return F.pandas_udf(whole, kind, F.PandasUDFType.SCALAR_ITER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (on one machine, as in tests) a folder made once per session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyspan-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


_ROOTS: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Deletes all tables that this process has written to the shared folder; the number of folders. Results that were not saved elsewhere can't be read any more."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, survive lost executors and can be read by column."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/keyspan-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns the reread table; .keyspan_path names its folder."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.keyspan_path = where
        return out

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of jobs that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.keyspan_path)
            path.getFileSystem(conf).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it holds at most max_rows rows, else unchanged: a shuffled join then takes over."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_order(*cols: Column | str) -> Column:
    """A fixed pseudo-random long of the columns."""
    return F.xxhash64(*cols)
