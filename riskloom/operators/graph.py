"""Connected components by large-star / small-star rounds, at once or batch by batch.

Both star steps are joins and grouped minima over the edge list, so no node's neighbourhood is ever gathered. Each round is
cut off by tables in the shared folder, of which only the last is kept, and the only thing that reaches the driver is the
round's change count. A hub's edges are a skewed key of a join between two stored tables, edges and one minimum a node,
which Spark's adaptive execution cuts into pieces, each with its copy of the minimum; minima are combined before shuffles.

Batch by batch, components are a forest that is only added to: a node's row names its parent, a component's smallest node is
its root, and a batch adds a row for each node that it meets first and for each root that it takes into another component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, new_path, scratch, shared_folder, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edge list; component is the smallest node it reaches.

    Self loops keep lone nodes in the result; null ends are ignored; repeated edges change nothing. Node type may be any
    ordered type. Raises if the rounds run out, which takes a path of more than about 2**30 nodes.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    path = new_path(spark, "edges")
    e = written(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    before = None
    for _ in range(max_rounds):
        last, path = path, new_path(spark, "edges")
        with scratch(spark):
            # large star: link each node's larger neighbours to its smallest neighbour
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lowest = written(both.groupBy("u").agg(F.min("v").alias("m")), "lowest")
            large = written(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
            # small star: link each node's smaller neighbours and itself to the smallest
            least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            e = written(small.where("u <> v").distinct(), "edges", path)
        delete(spark, last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            labels = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now
    raise RuntimeError("connected components did not settle")


def _parents(forest: DataFrame) -> DataFrame:
    return forest.groupBy("node").agg(F.max_by("parent", "batch").alias("parent"))


def roots(nodes: DataFrame, forest: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) of each of the distinct ``nodes``: its component so far, or null where the forest has it not. A round for
    each step up the longest way; ``add_edges`` writes the nodes of a batch straight below their roots, so ways stay short."""
    spark = nodes.sparkSession
    parents = _parents(forest).select(F.col("node").alias("at"), "parent")
    path = new_path(spark, "roots")
    way = written(nodes.select("node", F.col("node").alias("at")).join(parents, "at", "left").select("node", F.col("parent").alias("root")), "roots", path)
    for _ in range(max_rounds):
        last, path = path, new_path(spark, "roots")
        up = parents.select(F.col("at").alias("root"), "parent")
        moved = way.where("root is not null").join(up, "root").select("node", F.col("parent").alias("root"), (F.col("parent") != F.col("root")).alias("moved"))
        moved = written(moved.unionByName(way.where("root is null").withColumn("moved", F.lit(False))), "roots", path)
        delete(spark, last)
        way = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return way
    raise RuntimeError("the forest has a longer way than max_rounds")


def read_forest(spark: SparkSession, path: str, before: int | None = None, node_type: str = "string") -> DataFrame:
    """(node, parent, batch) of the batches before ``before`` (all, by default); empty where nothing is written yet."""
    schema = f"node {node_type}, parent {node_type}, batch long"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def add_edges(edges: DataFrame, path: str, batch: int, src: str = "src", dst: str = "dst") -> None:
    """Take a batch of edges into the forest at ``path``.

    The batch's edges are contracted to the components that their ends have so far, and the components of that small graph
    say which of those become one. Edges of earlier batches are not read. A batch that is run again replaces its rows and
    sees only batches before it.
    """
    spark = edges.sparkSession
    kind = edges.schema[src].dataType.simpleString()
    with scratch(spark):
        e = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "batch")
        ends = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
        found = roots(ends, read_forest(spark, path, batch, kind))
        known = written(found.select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")), "known")
        left = e.join(known.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
        pairs = left.join(known.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").select("a", "b").distinct()
        merged = written(connected_components(pairs, "a", "b"), "merged")
        below = known.join(merged.select(F.col("node").alias("root"), "component"), "root")
        # nodes of the batch go straight below their root, and roots that lost out below the one that took them
        rows = below.where(F.col("new") | (F.col("component") != F.col("root"))).select("node", F.col("component").alias("parent"))
        rows = rows.unionByName(merged.where("component <> node").select("node", F.col("component").alias("parent"))).distinct()
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def components_of(forest: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of a forest: ways are halved in each round."""
    spark = forest.sparkSession
    path = new_path(spark, "labels")
    labels = written(_parents(forest), "labels", path)
    for _ in range(max_rounds):
        last, path = path, new_path(spark, "labels")
        up = labels.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        moved = written(labels.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "labels", path)
        delete(spark, last)
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels.select("node", F.col("parent").alias("component"))
    raise RuntimeError("the forest did not settle")
