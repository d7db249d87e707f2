"""Deterministic sampling and splitting: order by a hash of the id, so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified(df: DataFrame, stratum: str, key: str, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """Up to a target of rows of each stratum; all if it has fewer, none without a target."""
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(stratum))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("_goal", goal).where("_goal is not null").withColumn("_rank", rank).where("_rank <= _goal").drop("_goal", "_rank")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """A column ``split``: test for the rounded (half to even) share of each stratum, one row at least; else dev."""
    w = Window.partitionBy(stratum)
    quota = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(share)).cast("int"))
    rank = F.row_number().over(w.orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("split", F.when(rank <= quota, "test").otherwise("dev"))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random by a seed."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def few_shot(df: DataFrame, stratum: str, key: str, richness: str, strata: list[str], n: int = 5, least: int = 2) -> DataFrame:
    """The richest row of each stratum, in a fixed order of strata, ``n`` at most; filled up with the first other rows.

    Rows need ``least`` triples to stand for their stratum.
    """
    priority = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(stratum))
    rich = df.where(F.col(richness) >= least).withColumn("_p", priority).where("_p > 0")
    best = rich.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(richness), key))).where("_r = 1")
    picked = best.orderBy("_p").limit(n)
    rest = df.join(picked.select(key), key, "left_anti").withColumn("_p", F.lit(1_000_000).cast("long"))
    return picked.drop("_r").withColumn("_p", F.col("_p").cast("long")).unionByName(rest.orderBy(key).limit(n)).orderBy("_p", key).limit(n).drop("_p")


def hash_split(df: DataFrame, key: Column, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """A column ``split`` with shares of about ``weights``, by a hash of the key; no shuffle."""
    u = F.conv(F.left(hash_order(key, seed), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return df.withColumn("split", out.otherwise(list(weights)[-1]))


def volume_estimate(df: DataFrame, test: Column, first: int, total: int) -> DataFrame:
    """Rows expected to pass among ``total``, from the share among the first ones: a preview of a large file."""
    head = df.limit(first)
    return head.agg(F.count(F.lit(1)).alias("seen"), F.count_if(test).alias("passed")).withColumn("estimate", F.when(F.col("seen") > 0, F.round(F.col("passed") / F.col("seen") * total)).otherwise(0).cast("long"))
