"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of characters other than the six ASCII white spaces.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_own_folder: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or setCheckpointDir(); a local one of our own only in local mode.

    On a cluster every executor would write into a temporary folder of its own
    and reads would miss those files, so there a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="millrace-")
    return _own_folder[app]


def _tables_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and it fixes
    the rows of plans that a retry could order or partition differently.  The
    driver must see the files that executors wrote, else this is an error.
    """
    path = f"{_tables_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if not out.inputFiles():
        raise RuntimeError(f"{path} holds no files that the driver can see: spark.checkpoint.dir isn't shared")
    out._millrace_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished work: Spark deletes them once the driver's collectors find them unreachable, which in a small driver may take long."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs within hand ``rows`` rows at once to Python, for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def discarding() -> Iterator[list[DataFrame]]:
    """Tables that are materialized within, and still in the list given, are deleted at its end; write what reads them before."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for df in _scopes.pop():
            discard(df)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application materialized and did not discard yet (those of lazy results)."""
    _delete(spark, _tables_folder(spark))


#: Rows of a batch that are worked on together, so that what a task holds besides the batch stays small.
SLICE_ROWS = 256


def in_slices(read: Callable[[pa.RecordBatch], pa.RecordBatch], forget: Callable[[], None] | None = None, rows: int = SLICE_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that applies ``read`` to slices of them; when its task ends it forgets and gives memory back to the system.

    Workers live on between tasks; what they keep unused would add up over a pipeline's stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield read(batch.slice(at, rows))
        finally:
            if forget is not None:
                forget()
            release()

    return run


def release() -> None:
    """Give unused memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that the results remembered in one task may take, all memories and generations together.
MEMORY_BYTES = 64_000_000
#: What an entry takes besides the bytes of its key and value, and the longest key that is kept.
_ENTRY, _LONGEST = 150, 256


class Memory(dict):
    """Results of ``find`` by key in two generations, of at most ``limit`` bytes together (and what one text adds).

    A memory belongs to a task and ends with it; long keys aren't kept.
    """

    def __init__(self, find: Callable, limit: int = MEMORY_BYTES):
        super().__init__()
        self.find, self.old, self.size, self.limit = find, {}, 0, limit // 2

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
            if len(key) > _LONGEST:
                return value
        self[key] = value
        self.size += _ENTRY + len(key) + len(value)
        return value

    def age(self) -> None:
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
