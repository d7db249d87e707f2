"""The graph query API over nodes (id, label, type) and edges (subject_id, predicate, object_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paths
from .assemble import endpoints


class PropertyGraph:
    """A typed graph kept as two DataFrames.  Methods return DataFrames; none runs a job but
    ``resolve``, ``shortest_path`` and ``components``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges
        self._both: DataFrame | None = None

    def __enter__(self) -> PropertyGraph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def get_entity(self, id_or_label: str) -> DataFrame:
        """At most one node with this id or, ignoring case, this label; an id match comes first, then the smallest id."""
        hit = (F.col("id") == id_or_label) | (F.lower("label") == F.lower(F.lit(id_or_label)))
        return self.nodes.where(hit).orderBy(F.when(F.col("id") == id_or_label, 0).otherwise(1), "id").limit(1).select("id", "label", "type")

    def resolve(self, id_or_label: str) -> str:
        """The id of ``get_entity``; KeyError if there is none."""
        found = self.get_entity(id_or_label).collect()
        if not found:
            raise KeyError(f"no entity for {id_or_label!r}")
        return found[0]["id"]

    def search_entities(self, name: str, entity_type: str | None = None, limit: int = 20) -> DataFrame:
        """Nodes whose label holds ``name``, ignoring case; shortest labels first."""
        found = self.nodes.where(F.contains(F.lower("label"), F.lower(F.lit(name))))
        if entity_type:
            found = found.where(F.col("type") == entity_type)
        return found.orderBy(F.length("label"), "label", "id").limit(limit).select("id", "label", "type")

    def neighbors(self, entity: str, rel_type: str | None = None, direction: str = "both", limit: int | None = 100) -> DataFrame:
        """Nodes one edge away: out, in or both; parallel edges repeat, a self-loop counts once."""
        edges = self.edges.where(F.col("predicate") == rel_type) if rel_type else self.edges
        sides = {
            "out": edges.where(F.col("subject_id") == entity).select("predicate", F.lit("out").alias("direction"), F.col("object_id").alias("id")),
            "in": edges.where(F.col("object_id") == entity).select("predicate", F.lit("in").alias("direction"), F.col("subject_id").alias("id")),
        }
        if direction == "both":
            near = sides["out"].unionAll(sides["in"].where(F.col("id") != entity))
        else:
            near = sides[direction]
        found = near.join(self.nodes.select("id", "label", "type"), "id").select("id", "label", "type", "predicate", "direction")
        return found.orderBy("id", "predicate", "direction").limit(limit) if limit else found

    def get_edges(self, subject: str | None = None, predicate: str | None = None, obj: str | None = None, min_confidence: float | None = None, limit: int | None = 100, weight: str = "confidence") -> DataFrame:
        """Edges that pass all the filters given; '' is no filter, a confidence of 0 is one, and a null confidence never passes it."""
        edges = self.edges
        for column, value in (("subject_id", subject), ("predicate", predicate), ("object_id", obj)):
            if value:
                edges = edges.where(F.col(column) == value)
        if min_confidence is not None:
            edges = edges.where(F.col(weight) >= min_confidence)
        label = lambda role: self.nodes.select(F.col("id").alias(f"{role}_id"), F.col("label").alias(role))
        found = edges.join(label("subject"), "subject_id").join(label("object"), "object_id")
        found = found.select("subject_id", "subject", "predicate", "object_id", "object", F.col(weight).alias("confidence"))
        return found.orderBy("subject_id", "predicate", "object_id").limit(limit) if limit else found

    def shortest_path(self, source: str, target: str, max_hops: int = 5):
        """(labels, predicates) of a shortest undirected path of up to ``max_hops`` edges, or None.

        The edges in both directions are written by the first search of a graph.
        """
        if self._both is None:
            self._both = paths.written(paths.undirected(self.edges), "graph-edges")
        return paths.shortest_path(self.nodes, self.edges, source, target, max_hops, self._both)

    def components(self) -> DataFrame:
        return paths.components(self.nodes, self.edges)

    def degrees(self) -> DataFrame:
        """(id, type, degree) of every node, 0 included; a self-loop counts twice, unknown endpoints don't."""
        counts = endpoints(self.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id", "label", "type").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))

    def stats(self) -> DataFrame:
        """(kind, key, n): totals, nodes by type, edges by predicate and by source."""
        by = lambda df, kind, c: df.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
        parts = [by(self.nodes, "nodes", F.lit("all")), by(self.nodes, "type", F.col("type")), by(self.edges, "edges", F.lit("all")), by(self.edges, "predicate", F.col("predicate"))]
        if "sources" in self.edges.columns:
            parts.append(by(self.edges.select(F.explode("sources").alias("s")), "source", F.col("s")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out
