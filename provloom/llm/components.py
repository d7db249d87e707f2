"""Connected components by contraction, with nothing but joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b), two long columns; a component is its smallest node.

    Each round ranks the nodes, the first two by their numbers, which settles stars around a smallest
    node at once, the others at random (by a hash with the round's number); it maps every node to the
    one of lowest rank among itself and its neighbours, follows that map once more and contracts the
    edges along it, until none are left.  A round takes a fixed share of the nodes whatever the order
    of their numbers, so a chain of n nodes takes a number of rounds logarithmic in n.  The lowest
    neighbour is aggregated before rows are exchanged, so a node with very many neighbours is no hot
    spot.  Each round's tables are written to the shared folder and deleted at the end.

    Edges with a null end and self-loops count for nothing; no edges give no rows.
    """
    with scratch(edges.sparkSession) as keep:
        left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        maps = []
        while not left.isEmpty():
            maps.append(cut(_lowest(left, len(maps)), "contraction"))
            to = maps[-1]
            moved = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            left = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not maps:
            return keep(left.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        found = maps[-1]
        for earlier in reversed(maps[:-1]):
            found = earlier.join(found.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        found = cut(found, "roots")
        smallest = found.groupBy("to").agg(F.min("node").alias("component"))
        return keep(found.join(smallest, "to").select("node", "component"), "components")


def _lowest(edges: DataFrame, number: int) -> DataFrame:
    """(node, to): where two steps to the neighbour of lowest rank lead."""

    def rank(node: str) -> Column:
        return F.xxhash64(F.lit(number), F.col(node))

    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if number < 2:
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
    else:
        step = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("r"))
        step = step.select(F.col("a").alias("node"), F.when(F.col("r") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to"))
    step = cut(step, "step")
    return step.join(step.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to"))
