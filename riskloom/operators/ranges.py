"""Running sums over a whole table in order, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (long) over all rows up to and with this one in ``order``, by ``keys``.

    Rows are dealt into sorted ranges and stored; inside a range a window adds up, and a table of one row per range and
    key gives what the ranges before it add.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__value", value.cast("long")).repartitionByRange(parts, *(keys + order)).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    here = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    summed = ranged.withColumn("__here", F.sum("__value").over(here)).join(F.broadcast(sums), on)
    return summed.withColumn(name, F.col("__here") + F.col("__before")).drop("__value", "__part", "__here", "__p", "__before", *[f"__k{i}" for i in range(len(keys))])
