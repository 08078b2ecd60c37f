"""Tables of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, scratch, shared_folder, written

__all__ = ["make_room", "new_path", "row_name", "scratch", "shared_folder", "small_batches", "table", "written"]

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole documents pass to Python in Arrow batches: a tenth of Spark's default rows, unless the session has its own."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def make_room(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns that have one of ``names`` renamed to ``in_<name>`` (and so on, until the name is free)."""
    new = {}
    for name in names:
        if name in docs.columns:
            free = f"in_{name}"
            while free in docs.columns or free in new.values() or free in names:
                free = f"in_{free}"
            new[name] = free
    return docs.withColumnsRenamed(new) if new else docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_name(*columns: str) -> Column:
    """A 128-bit name of a row from its columns: rows with one name are equal in all of them."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *reversed(columns))))
