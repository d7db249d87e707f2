"""From assertions to a graph: reconciled ids, nodes, and unique edges with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_wins


def _set(c: Column) -> Column:
    """Sorted distinct values that aren't empty."""
    return F.sort_array(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))


def reconcile(triples: DataFrame, canonical: DataFrame) -> DataFrame:
    """Subject and object ids replaced by their canonical ones (source_id -> canonical_id), where known.

    The map is broadcast only if it is below the planner's threshold.
    """
    ids = canonical.groupBy("source_id").agg(F.min("canonical_id").alias("canonical_id"))
    for role in ("subject_id", "object_id"):
        m = ids.select(F.col("source_id").alias(role), F.col("canonical_id").alias("_to"))
        triples = triples.join(m, role, "left").withColumn(role, F.coalesce("_to", role)).drop("_to")
    return triples


def nodes_of(triples: DataFrame, order: str = "ord") -> DataFrame:
    """(id, label, type) of all endpoints; the first mention wins, a subject before the object of its row."""
    mention = lambda role, n: triples.select(F.col(f"{role}_id").alias("id"), F.col(f"{role}_label").alias("label"), F.col(f"{role}_type").alias("type"), F.col(order).alias("_o"), F.lit(n).alias("_r"))
    return first_wins(mention("subject", 0).unionAll(mention("object", 1)), ["id"], ["_o", "_r"]).drop("_o", "_r")


def aggregate_evidence(triples: DataFrame, predicates: DataFrame | None = None, default: float | None = 0.5, order: str = "ord", with_spans: bool = False) -> DataFrame:
    """One edge for each (subject, predicate, object) with what its assertions say.

    Highest and lowest confidence (a missing one is ``default``, or left out if that is None), number
    of assertions, and sorted distinct sources and evidence types; with ``with_spans`` also
    publications and spans.  Endpoint types are those of the first row.  Predicates outside
    ``predicates`` are dropped.  Partially aggregated before the one shuffle.
    """
    if predicates is not None:
        triples = triples.join(predicates.select("predicate").distinct(), "predicate", "left_semi")
    confidence = F.col("confidence") if default is None else F.coalesce("confidence", F.lit(default))
    extra = [_set(F.col("publication_id")).alias("evidence_pmids"), _set(F.col("evidence_span")).alias("evidence_spans")] if with_spans else []
    return triples.groupBy("subject_id", "predicate", "object_id").agg(
        F.min_by("subject_type", order).alias("subject_type"),
        F.min_by("object_type", order).alias("object_type"),
        F.max(confidence).alias("confidence"),
        F.min(confidence).alias("confidence_min"),
        F.max(confidence).alias("confidence_max"),
        F.count(F.lit(1)).alias("evidence_count"),
        _set(F.col("source")).alias("sources"),
        _set(F.col("evidence_type")).alias("evidence_types"),
        *extra,
    )


def with_endpoints(edges: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Labels and types of both endpoints; by default edges without both are lost."""
    for role in ("subject", "object"):
        n = nodes.select(F.col("id").alias(f"{role}_id"), F.col("label").alias(f"{role}_label"), F.col("type").alias(f"{role}_type"))
        edges = edges.drop(f"{role}_label", f"{role}_type").join(n, f"{role}_id", how)
    return edges


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ``new`` overlaid on (subject, predicate, object), and the new rows that lack an endpoint."""
    from .relational import upsert

    ids = nodes.select("id").distinct()
    has = new.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    keys = ["subject_id", "predicate", "object_id"]
    return upsert(edges, has, keys), new.join(has.select(*keys).distinct(), keys, "left_anti")


def referenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge has as an endpoint."""
    return nodes.join(endpoints(edges).select("id").distinct(), "id", "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge (id, role); one scan, no union."""
    return edges.select(F.explode(F.array(F.struct(F.col("subject_id").alias("id"), F.lit("subject").alias("role")), F.struct(F.col("object_id").alias("id"), F.lit("object").alias("role")))).alias("_e")).select("_e.id", "_e.role")


def load_literature(nodes: DataFrame, assertions: DataFrame, new_nodes: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that aren't there yet are added, every extracted row becomes an assertion of its own."""
    added = new_nodes.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(added, allowMissingColumns=True), assertions.unionByName(new_rows, allowMissingColumns=True)
