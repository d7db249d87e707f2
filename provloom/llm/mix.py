"""Mixing sources to target weights (operator 5): DataFrame functions only.

Each source gets a budget of words by weight, bounded by a multiple of its size.  Documents get
hash-random keys and are range-sorted within their source; prefix sums of word counts are built in
two levels (sums of key ranges, then within a range), so that no task sees a whole source however
large it is; the order is cut at exactly the budget, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of one key range of one source, about.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def budgets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Targets by water-filling over one row per source (source, source_size, n_docs).

    Every source would get words in proportion to its weight; a source can't get more than
    ``cap`` times its size, and what it can't take goes to the others by weight, until none is
    above.  With sources in order of cap over weight, all before the first that the common level
    doesn't fill are at their caps.  One row per source goes through the window without a key.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    level = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_no", F.row_number().over(by_fill))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
        .withColumn("_first", F.min(F.when(F.col("_fill") > F.col("_level"), F.struct("_no", "_level"))).over(Window.partitionBy()))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_first._level"), F.lit(float("inf"))) * F.col("_w"))
    return level.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    df: DataFrame,
    weights: list[int],
    share: float = 1.5,
    cap: float = 2.0,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 17,
) -> DataFrame:
    """How much of each document a mix takes.

    ``weights`` go to the sources in order of code point (null last), repeating.  Returns ``keep``
    (by default ``id_col``) and size, source_size, target (of the source, double) and taken: the
    document's words in the mix with repeats.  Each source's taken words add up to its target,
    rounded; the document at the cut gives its first words only.  A document is taken whole
    ``floor(target / source_size)`` times and once more if it stands before the cut.

    Null texts have size 0 and null sources form one source.  Equal keys are ordered by id, then by
    text, so that reruns agree; rows that repeat are documents of their own.  A source without
    words has target 0.  An empty table gives none.  Other columns are not read unless kept.
    """
    keep = keep or [id_col]
    # 60 bits of a digest that every engine has, so that the order can be checked elsewhere.
    key = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), df[id_col].cast("string"))), F.lit(15)), 16, 10).cast("long")
    sized = df.select(
        *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)],
        df[source_col].alias("source"),
        key.alias("_key"),
        df[id_col].alias("_id"),
        F.xxhash64(df[text_col]).alias("_text"),
        word_count(df[text_col]).alias("size"),
    )
    slim = cut(sized.drop(*[f"_k{i}" for i in range(len(keep))]) if keep != [id_col] else sized, "mix-sizes")
    if keep == [id_col]:
        sized = slim
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = cut(
        budgets(totals, weights, share, cap)
        .withColumn("_budget", F.round("target").cast("long"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_ranges", F.ceil(F.col("n_docs") / RANGE_ROWS))
        .withColumnRenamed("source", "_source"),
        "mix-plan",
    )
    # Tables in the shared folder have known sizes: the planner broadcasts the plan only if it is small.
    ranged = lambda rows: (
        rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
        .withColumn("_range", F.shiftright(F.shiftright("_key", 29) * F.col("_ranges"), 31))
    )
    sums = ranged(slim).groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_start")),
        "mix-ranges",
    )
    rows = ranged(sized)
    rows = rows.join(starts, rows["_source"].eqNullSafe(starts["_s"]) & (rows["_range"] == starts["_r"]))
    within = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - prefix))
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        *([] if source_col in keep else [F.col("source").alias(source_col)]),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
    )
