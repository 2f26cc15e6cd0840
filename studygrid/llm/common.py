"""Shared helpers: scratch tables in the cluster's shared folder, and Arrow batch loops.

``spark.checkpoint.dir`` names a folder that driver and executors share. Stages
that are read twice are written there as Parquet, which cuts their lineage and
survives a lost executor. Where it is unset the session's warehouse folder takes
its place, which on a cluster must not be a folder of one machine.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word contract: space and 0x09-0x0D, which is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/studygrid-scratch"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/scratch-{app}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def fit_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session's Arrow batches hold at most ``rows`` rows from now on: whole texts make wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While stages run inside, Arrow batches hold fewer rows, and so less memory in executors and workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Frames that read them must not be used after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def held(column: str, folds: int, fold: int):
    """True where crc32 of the id as text falls into ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def parts(df: DataFrame) -> int:
    """Shuffle partitions for an explicit repartition: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_CACHED: dict = {}


def cached(key, build):
    """What ``build`` made for ``key`` in this Python worker; a worker keeps one thing at a time, that of its latest operator."""
    if key not in _CACHED:
        release()
        _CACHED.clear()
        _CACHED[key] = build()
    return _CACHED[key]


def release() -> None:
    """Forget what an earlier operator keeps in this Python worker, and give its memory back."""
    import ctypes
    import gc

    import pyarrow as pa

    if None in _CACHED:
        return
    _CACHED.clear()
    _CACHED[None] = None
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


class Numbered:
    """The columns of ``df`` under the names ``c0``, ``c1``, ... so that no name of an operator clashes with them.

    ``named`` gives them back their own names beside new columns; a column that is
    called like a new one, in whatever case, is replaced by it.
    """

    def __init__(self, df: DataFrame):
        self.schema, self.columns = df.schema, df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def of(self, name: str) -> str:
        """The number of a column; in another case if there is none in this one."""
        if name not in self.columns:
            found = [i for i, c in enumerate(self.columns) if c.lower() == name.lower()]
            if len(found) != 1:
                raise ValueError(f"no column {name!r} among {self.columns}")
            return f"c{found[0]}"
        return f"c{self.columns.index(name)}"

    def kept(self, new=()) -> list[int]:
        added = {c.lower() for c in new}
        return [i for i, c in enumerate(self.columns) if c.lower() not in added]

    def fields(self, new=()) -> list[T.StructField]:
        return [self.schema.fields[i] for i in self.kept(new)]

    def named(self, df: DataFrame, new: dict | None = None) -> DataFrame:
        """``df``'s numbered columns, then those of ``new``: own names to expressions."""
        new = new or {}
        kept = self.kept(new)
        return df.select(*(f"c{i}" for i in kept), *(x.alias(f"n{i}") for i, x in enumerate(new.values()))).toDF(*(self.columns[i] for i in kept), *new)


def strings(batch, name: str, null: bytes | None = b"") -> list:
    """A text column of an Arrow batch as UTF-8 bytes; null becomes ``null``."""
    import pyarrow as pa

    return [null if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]
