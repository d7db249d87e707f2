"""Repair of a graph: retyping by vote or by rule, decisions of reviewers, re-homed and dropped edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import GENERA, clean, compound_flags, first_token, microbe_flags, rehomed_predicate, triage_bucket
from .qa import conformance


def vote_types(nodes: DataFrame, edges: DataFrame, schema: DataFrame) -> DataFrame:
    """(id, current, winner, votes, current_votes, retype) of nodes with a vote.

    An edge votes on an endpoint if its predicate allows one type in that role; parallel edges and
    self-loops all vote.  The winner has the most votes, the first name on ties; it replaces the
    current type only with strictly more votes.
    """
    single = schema.select("predicate", F.when(F.size("subject_types") == 1, F.get("subject_types", 0)).alias("_s"), F.when(F.size("object_types") == 1, F.get("object_types", 0)).alias("_o"))
    roles = F.array(F.struct(F.col("subject_id").alias("id"), F.col("_s").alias("vote")), F.struct(F.col("object_id").alias("id"), F.col("_o").alias("vote")))
    votes = edges.join(single, "predicate").select(F.explode(roles).alias("_r")).select("_r.id", "_r.vote").where("vote is not null").groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    tallied = votes.join(nodes.select("id", F.col("type").alias("current")), "id").groupBy("id", "current").agg(
        F.min(F.struct((-F.col("n")).alias("_n"), F.col("vote").alias("winner"))).alias("_w"),
        F.coalesce(F.sum(F.when(F.col("vote") == F.col("current"), F.col("n"))), F.lit(0)).cast("long").alias("current_votes"),
    )
    out = tallied.select("id", "current", F.col("_w.winner").alias("winner"), (-F.col("_w._n")).cast("long").alias("votes"), "current_votes")
    return out.withColumn("retype", (F.col("winner") != F.col("current")) & (F.col("votes") > F.col("current_votes")))


def apply_types(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the types of ``changes`` (id, type)."""
    return nodes.join(changes.select("id", F.col("type").alias("_t")), "id", "left").withColumn("type", F.coalesce("_t", "type")).drop("_t")


def retype_then_drop(nodes: DataFrame, edges: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes retyped by vote, and edges with ``action``: self_loop, violation or keep, by the new types.

    Loops go first; edges of unknown predicates are kept.
    """
    changes = vote_types(nodes, edges, schema).where("retype").select("id", F.col("winner").alias("type"))
    retyped = apply_types(nodes, changes)
    judged = conformance(edges, retyped, schema)
    action = F.when(F.col("subject_id") == F.col("object_id"), "self_loop").when(F.coalesce(F.col("reason").isin("subject_type", "object_type"), F.lit(False)), "violation").otherwise("keep")
    return retyped, judged.withColumn("action", action)


def known_genera(nodes: DataFrame, literature_prefix: str = "LLM:") -> DataFrame:
    """(genus): the built-in ones and the first words of curated microbes, of four letters or more."""
    spark = nodes.sparkSession
    curated = nodes.where(~F.startswith("id", F.lit(literature_prefix)) & (F.col("type") == "Microbe")).select(first_token(F.col("label")).alias("genus")).where("length(genus) >= 4")
    return spark.createDataFrame([(g,) for g in GENERA], "genus string").union(curated).distinct()


def triage(nodes: DataFrame, degrees: DataFrame | None = None, literature_prefix: str = "LLM:") -> DataFrame:
    """Literature nodes that a rule wants reviewed: their flags, bucket, degree and suggested type."""
    genera = known_genera(nodes, literature_prefix).select(F.col("genus").alias("_first"), F.lit(True).alias("_genus"))
    lit = nodes.where(F.startswith("id", F.lit(literature_prefix))).withColumn("_first", first_token(F.col("label"))).join(genera, "_first", "left")
    lit = lit.withColumn("microbe_flags", microbe_flags(F.col("label"), F.coalesce("_genus", F.lit(False)))).withColumn("compound_flags", compound_flags(F.col("label")))
    lit = lit.withColumn("bucket", triage_bucket(F.col("label"), F.col("type"), F.col("microbe_flags"), F.col("compound_flags"))).where("bucket is not null")
    suggested = F.when(F.col("bucket").isin("high_confidence_microbe", "medium_microbe"), "Microbe").when(F.col("bucket") == "compound_candidate", "Bioactive").otherwise("keep")
    out = lit.withColumn("suggested_decision", suggested).drop("_first", "_genus")
    if degrees is None:
        return out.withColumn("degree", F.lit(None).cast("long"))
    return out.join(degrees.select("id", "degree"), "id", "left")


def review_order(review: DataFrame) -> DataFrame:
    """What ``triage`` found as a reviewer reads it: by bucket, highest degree first, an unknown one as 0, then by id."""
    return review.orderBy("bucket", F.coalesce("degree", F.lit(0)).desc(), "id")


def first_phase(nodes: DataFrame) -> DataFrame:
    """Nodes with only the high-confidence microbes retyped."""
    sure = triage(nodes).where("bucket = 'high_confidence_microbe'").select("id", F.lit("Microbe").alias("type"))
    return apply_types(nodes, sure)


def apply_decisions(nodes: DataFrame, decisions: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes retyped exactly as decisions (id, decision) say; and each decision's status."""
    d = decisions.select(clean(F.col("id")).alias("id"), clean(F.col("decision")).alias("decision")).where("id <> ''")
    judged = d.join(nodes.select("id", F.col("type").alias("current")), "id").withColumn("status", scores.decision_status(F.col("decision"), F.col("current"), types))
    changes = judged.where("status = 'retype'").groupBy("id").agg(F.max("decision").alias("type"))
    return apply_types(nodes, changes), judged


def fix_edges(edges: DataFrame, violations: DataFrame, rehome: DataFrame, new_predicate: str = "produces") -> DataFrame:
    """Edges with ``action``: rehome (predicate replaced, in its own case), drop or keep.

    A violating edge (subject, predicate in any case, object) is re-homed if its two ends are in
    ``rehome``, else dropped.  Filter on ``action`` to apply; the rest is the log.
    """
    broken = violations.select("subject_id", F.lower("predicate").alias("_p"), "object_id").distinct()
    moved = rehome.select("subject_id", "object_id", F.lit(True).alias("_move")).distinct()
    keyed = broken.join(moved, ["subject_id", "object_id"], "left").select("subject_id", "_p", "object_id", F.coalesce("_move", F.lit(False)).alias("_move"))
    j = edges.withColumn("_p", F.lower("predicate")).join(keyed, ["subject_id", "_p", "object_id"], "left")
    action = F.when(F.col("_move").isNull(), "keep").when(F.col("_move"), "rehome").otherwise("drop")
    out = j.withColumn("action", action)
    return out.withColumn("predicate", F.when(F.col("action") == "rehome", rehomed_predicate(F.col("predicate"), new_predicate)).otherwise(F.col("predicate"))).drop("_p", "_move")


def unmatched_violations(edges: DataFrame, violations: DataFrame) -> DataFrame:
    """Violations that no edge has: keys to warn about."""
    v = violations.select("subject_id", F.lower("predicate").alias("_p"), "object_id").distinct()
    return v.join(edges.select("subject_id", F.lower("predicate").alias("_p"), "object_id"), ["subject_id", "_p", "object_id"], "left_anti").withColumnRenamed("_p", "predicate")


def prune(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes without the listed ids."""
    return nodes.join(ids.select("id"), "id", "left_anti")
