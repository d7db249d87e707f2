"""Evaluation of extracted triples against gold: fuzzy matching, precision and recall, refusals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import names_match, normalize_name


def real_triples(rows: DataFrame, sentinels: tuple[str, ...] = ("NONE", "")) -> DataFrame:
    """Rows that state a triple.  The evaluation drops NONE and empty predicates; loading drops ERROR too."""
    return rows.where(~F.coalesce(F.col("predicate").isin(*sentinels), F.lit(True)))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", normalize_name(F.col("subject_name"))).withColumn("_o", normalize_name(F.col("object_name")))


def candidate_pairs(gold: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("annot_id", "predicate"), order: str = "ord") -> DataFrame:
    """(keys, gold_ord, found_ord): rows of equal keys whose subjects and objects match as names."""
    g = _named(gold).select(*keys, F.col(order).alias("gold_ord"), F.col("_s").alias("_gs"), F.col("_o").alias("_go"))
    f = _named(found).select(*keys, F.col(order).alias("found_ord"), F.col("_s").alias("_fs"), F.col("_o").alias("_fo"))
    return g.join(f, list(keys)).where(names_match(F.col("_gs"), F.col("_fs")) & names_match(F.col("_go"), F.col("_fo"))).select(*keys, "gold_ord", "found_ord")


def greedy_match(pairs: DataFrame, group: str = "annot_id") -> DataFrame:
    """One-to-one: gold rows in order take the first extracted row that is still free.

    A group's pairs stand together and are read in order; what a task holds is the set of rows a
    group has used so far.
    """
    schema = pairs.select(group, "gold_ord", "found_ord").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, done = None, set(), None
        for batch in batches:
            rows: list[tuple] = []
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if g != at:
                    at, taken, done = g, set(), None
                if a != done and b not in taken:
                    taken.add(b)
                    done = a
                    rows.append((g, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.schema.field(i).type) for i in range(3)], schema=batch.schema)

    ordered = pairs.select(group, "gold_ord", "found_ord").repartition(group).sortWithinPartitions(group, "gold_ord", "found_ord")
    return ordered.mapInArrow(run, schema)


def prf(tp: Column, n_found: Column, n_gold: Column) -> list[Column]:
    """Precision, recall and F1, 0 where undefined."""
    p, r = scores.ratio(tp, n_found), scores.ratio(tp, n_gold)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(scores.f1(p, r), 6).alias("f1")]


def score_by(gold: DataFrame, found: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 for each key that gold or extraction has; ``by`` may be empty.

    ``matched`` has a row for each true positive, with the keys.
    """
    count = lambda df, kind: df.select(*by, F.lit(kind).alias("_k"))
    rows = count(gold, "gold").unionAll(count(found, "found")).unionAll(count(matched, "tp"))
    n = lambda kind: F.count_if(F.col("_k") == kind)
    grouped = rows.groupBy(*by).agg(n("tp").alias("tp"), n("found").alias("_f"), n("gold").alias("_g"))
    return grouped.select(*by, "tp", (F.col("_f") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"), *prf(F.col("tp"), F.col("_f"), F.col("_g")))


def refusals(gold: DataFrame, found: DataFrame, group: str = "annot_id") -> DataFrame:
    """(ok, violated, bogus): of groups whose gold rows are all NONE, those with no extracted triple, the
    others, and the triples that these have.  A group without extracted rows counts as refused."""
    none = F.coalesce(F.col("predicate").isin("NONE", ""), F.lit(True))
    g = gold.groupBy(group).agg(F.every(none).alias("_none")).where("_none").select(group)
    f = found.groupBy(group).agg(F.count_if(~none).alias("_n"))
    j = g.join(f, group, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return j.agg(F.count_if(F.col("_n") == 0).alias("ok"), F.count_if(F.col("_n") > 0).alias("violated"), F.coalesce(F.sum("_n"), F.lit(0)).alias("bogus"))


def type_violations(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(predicate, n) of rows whose types their predicate doesn't allow."""
    from .qa import conforms_to_pair

    return conforms_to_pair(rows, pairs).where("not valid").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def evaluate(gold: DataFrame, found: DataFrame, strata: DataFrame | None = None, order: str = "ord") -> dict[str, DataFrame]:
    """All of it: overall, by predicate, by stratum (annot_id, stratum), and refusals."""
    g, f = real_triples(gold), real_triples(found)
    pairs = greedy_match(candidate_pairs(g, f, order=order))
    matched = pairs.join(g.select("annot_id", F.col(order).alias("gold_ord"), "predicate"), ["annot_id", "gold_ord"])
    out = {"overall": score_by(g, f, matched, []), "predicate": score_by(g, f, matched, ["predicate"]), "refusals": refusals(gold, found)}
    if strata is not None:
        s = lambda df: df.select("annot_id").join(strata, "annot_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
        out["stratum"] = score_by(s(g), s(f), s(matched), ["stratum"])
    return out
