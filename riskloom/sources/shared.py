"""Intermediate tables in the shared folder, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside the innermost ``scratch`` of this thread or task; None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: The latest paths made by this process, to look at; nothing is deleted by it.
_WRITTEN: deque[str] = deque(maxlen=256)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, as in tests, gets a temporary one where none is set:
    on a cluster its executors would each write to a disk of their own."""
    directory = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not directory:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        directory = tempfile.mkdtemp(prefix="riskloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(directory)
    return directory


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses."""
    path = f"{shared_folder(spark).rstrip('/')}/riskloom-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append(path)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder (at ``path``, where one is given) and read it back."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def step_by_step(spark: SparkSession) -> Iterator[None]:
    """What a table that is written inside has shuffled leaves the disk when the table is there, and not when the driver
    happens to collect its garbage: a job of several steps holds the files of one. The session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``new_path`` named."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, by this call alone, are deleted at the end: for callers whose result is stored elsewhere by
    then. What other threads write meanwhile stays, and so does what was named before."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        delete(spark, *made)
