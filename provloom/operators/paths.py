"""Iterative operators: shortest paths and connected components.

Every round's tables are written to the folder of ``spark.checkpoint.dir``, so lineage stays short and a
lost executor costs nothing, and deleted when the result is written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    Only where ``spark.checkpoint.dir`` is unset and all runs on one machine is that a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="provloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/provloom/{label}-{uuid.uuid4().hex}"


class Rounds:
    """Tables that rounds write; deleted at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Rounds:
        return self

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read again, for what outlives a block of rounds."""
    return Rounds(df.sparkSession)(df, label)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, predicate) in both directions, self-loops left out, without repeats."""
    both = edges.select(F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b")))).alias("_e"), "predicate")
    return both.select("_e.a", "_e.b", "predicate").where("a <> b").groupBy("a", "b").agg(F.min("predicate").alias("predicate"))


def hops_from(edges: DataFrame, source: str, max_hops: int, target: str | None = None, both: DataFrame | None = None) -> DataFrame:
    """(id, hops, parent, predicate) of the nodes within ``max_hops`` undirected edges of a node.

    Breadth first, one join per level; visited nodes are taken out before repeats are, so a hub's
    neighbours don't multiply.  The parent is the smallest of those a level nearer.  ``both``: what
    ``undirected`` returns, written, for several searches of one graph.
    """
    spark = edges.sparkSession
    with Rounds(spark) as write:
        both = both or write(undirected(edges), "bfs-edges")
        reached = spark.createDataFrame([(source, 0, None, None)], "id string, hops int, parent string, predicate string")
        frontier = reached
        for level in range(1, max_hops + 1):
            step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.col("a").alias("parent"), "predicate")
            new = step.join(reached.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("parent", "predicate")).alias("_p"))
            frontier = write(new.select("id", F.lit(level).alias("hops"), "_p.parent", "_p.predicate"), "bfs-level")
            if frontier.isEmpty():
                break
            reached = reached.unionAll(frontier)
            if target is not None and not frontier.where(F.col("id") == target).isEmpty():
                break
        return written(reached, "bfs-reached")


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 5, both: DataFrame | None = None):
    """(labels, predicates) of the shortest path with the smallest parents, or None; no edge if both ends are one node."""
    reached = hops_from(edges, source, max_hops, target, both)
    ids, predicates, at = [target], [], target
    while at != source:  # one row per hop, max_hops at most
        row = reached.where(F.col("id") == at).select("parent", "predicate").collect()
        if not row:
            return None
        at = row[0]["parent"]
        ids.append(at)
        predicates.append(row[0]["predicate"])
    labels = {r["id"]: r["label"] for r in nodes.where(F.col("id").isin(ids)).select("id", "label").collect()}
    return [labels.get(i) for i in reversed(ids)], predicates[::-1]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a component is its smallest id, a node without edges its own.

    Edges with an unknown endpoint are ignored.  In each round nodes are ranked, in the first two by
    their ids, which settles stars around a smallest node at once, then by a hash of their id and the
    round's number; every node points to the one of lowest rank among itself and its
    neighbours, that step is taken twice, and edges follow, until none is left: the number of rounds
    is logarithmic however long a chain is and however its ids are ordered.
    """
    ids = nodes.select("id").distinct()
    known = edges.select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).where("a <> b").distinct()
    known = known.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    with Rounds(nodes.sparkSession) as write:
        left, maps = write(known, "cc-edges"), []
        while not left.isEmpty():
            step = write(_lowest(left, len(maps)), "cc-step")
            to = write(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("_then")), "to").select("id", F.col("_then").alias("to")), "cc-map")
            maps.append(to)
            left = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            left = write(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        if not maps:
            return ids.withColumn("component", F.col("id"))
        found = maps[-1]
        for step in reversed(maps[:-1]):
            found = step.join(found.select(F.col("id").alias("to"), F.col("to").alias("_last")), "to", "left").select("id", F.coalesce("_last", "to").alias("to"))
        found = write(found, "cc-roots")
        smallest = found.groupBy("to").agg(F.min("id").alias("component"))
        found = written(found.join(smallest, "to").select("id", "component"), "cc-found")
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _lowest(edges: DataFrame, number: int) -> DataFrame:
    """(id, to): the one of lowest rank among a node and its neighbours."""

    def rank(node: str) -> Column:
        return F.xxhash64(F.lit(number), F.col(node))

    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if number < 2:
        return both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
    lowest = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("_r"))
    return lowest.select(F.col("a").alias("id"), F.when(F.col("_r") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to"))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_summary(found: DataFrame) -> DataFrame:
    """Number of components, largest, its share in per cent, and components of one node."""
    sizes = component_sizes(found)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest"),
        F.round(100.0 * F.max("size") / F.sum("size"), 6).alias("largest_pct"),
        F.count_if(F.col("size") == 1).alias("singletons"),
    )
