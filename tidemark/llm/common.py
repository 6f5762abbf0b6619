"""Helpers shared by the operators: shared folder, materialised tables, words."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, single machine) a folder is made
    and set, so that ``checkpoint()`` works as well; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            current = spark.sparkContext.getCheckpointDir()
        path = current
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and pins the rows: a lost executor can't change what was decided.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def spent(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table._path)


_left: dict[str, Callable] = {}


def on_leaving(module: str, forget: Callable) -> None:
    """In a worker: call ``forget`` when it comes to a task of another module."""
    _left[module] = forget


def _enter(module: str) -> None:
    for other in [m for m in _left if m != module]:
        _left.pop(other)()
        _release()


def _release() -> None:
    """Give freed memory back to the system, as the next task may be another operator's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(task: Callable) -> Callable:
    """A Python task, plain or a generator, beside which its worker keeps no other module's memory."""
    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def run(arg):
            _enter(task.__module__)
            try:
                yield from task(arg)
            finally:
                _release()

    else:

        @functools.wraps(task)
        def run(arg):
            _enter(task.__module__)
            try:
                return task(arg)
            finally:
                _release()

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this run that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(path: str):
    """(pyarrow file system, path in it) for a URI or a plain path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
