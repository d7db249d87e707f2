"""Small relational operators with the tie and null rules that the others rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import written


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order; one shuffle on the keys."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def override(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` has, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: values of ``new`` over those of ``old``; a null in ``new`` changes nothing."""
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"_{p}_{c}") for p, t in (("n", new), ("o", old)) if c in t.columns])
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done: what is left to do after a resume."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def numbered(df: DataFrame, name: str, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """1, 2, 3, ... in order within ``by``.

    Without ``by`` the whole table is numbered by range partitions: each counts its rows, and a row's
    number is its place in its partition plus the rows of those before.  No task sees all rows.
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, as the partitioning has to be the same when its rows are counted and when they are numbered.
    kept = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def running_count(df: DataFrame, name: str, test: Column, by: str, order: str) -> DataFrame:
    """How many rows so far, in order within ``by``, pass a test.

    ``by`` may have a handful of values: its groups are cut into ranges, each counts its rows, and what
    stands before a range in its group is added.  No task sees a whole group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, as the partitioning has to be the same when its rows are counted and when they are numbered.
    kept = written(df.withColumn("_hit", F.coalesce(test, F.lit(False)).cast("long")).repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()), "running")
    sums = kept.groupBy(by, "_part").agg(F.sum("_hit").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = F.sum("_hit").over(Window.partitionBy("_part", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = kept.withColumn("_within", within).join(before, (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_hit", "_part", "_of", "_by", "_before", "_within")


def top(df: DataFrame, key: list[str], n: int, count: str = "n") -> DataFrame:
    """The most frequent keys; ties by key.  A top-k of partial sums, no full sort."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), *key).limit(n)


def histogram(df: DataFrame, value: Column, name: str = "bin") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """Count, mean, quartiles, minimum and maximum of the values that are numbers; exact percentiles."""
    v = value.try_cast("double")
    quantile = lambda q: F.percentile(v, F.lit(q))
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"), quantile(0.9).alias("p90"), F.max(v).alias("max")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def shares(df: DataFrame, key: list[str]) -> DataFrame:
    """Count of each key and its percentage of all rows."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("_all")).drop("_all")  # one row on the right


def with_total(df: DataFrame, key: str, counts: dict[str, Column], label: str = "TOTAL") -> DataFrame:
    """Aggregates by key, and a last row over all."""
    rolled = df.rollup(key).agg(*[c.alias(n) for n, c in counts.items()], F.grouping(key).alias("_all"))
    return rolled.withColumn(key, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(key))).drop("_all")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the rows too many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("redundant", F.col("n") - 1)


def unique_or_fail(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key isn't unique (runs a job)."""
    found = duplicates(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"not unique: {found[0].asDict()}")
