"""A property graph over the tables of orders, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import aggregate_evidence
from ..operators.graph import PropertyGraph
from ..schema import predicate_schema
from .registry import table

#: predicate, subject types, object types; the last one is wrong on purpose.
SCHEMA = (
    ("IN_REGION", ("Nation",), ("Region",)),
    ("LOCATED_IN", ("Customer", "Supplier"), ("Nation",)),
    ("SUPPLIES", ("Supplier",), ("Part",)),
    ("ORDERED", ("Customer",), ("Nation",)),
)


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    node = lambda t, kind, key, label, origin=None: table(spark, d, t).select(_id(kind, key).alias("id"), F.col(label).alias("label"), F.lit(kind.capitalize()).alias("type"), (F.lit("curated") if origin is None else origin).alias("origin"))
    parts = [
        node("region", "region", "r_regionkey", "r_name"),
        node("nation", "nation", "n_nationkey", "n_name"),
        node("customer", "customer", "c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, "LLM").otherwise("curated")),
        node("supplier", "supplier", "s_suppkey", "s_name"),
        node("part", "part", "p_partkey", "p_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """A row for each nation in a region, customer and supplier in a nation, and line item (twice: supplied, ordered)."""
    fixed = lambda t, s, sk, p, o, ok, st, ot: table(spark, d, t).select(_id(s, sk).alias("subject_id"), F.lit(p).alias("predicate"), _id(o, ok).alias("object_id"), F.lit(st).alias("subject_type"), F.lit(ot).alias("object_type"), F.lit(1.0).alias("confidence"), F.lit("dim").alias("source"), F.lit("curated").alias("evidence_type"), F.lit(None).cast("string").alias("publication_id"), F.col(sk).cast("long").alias("ord"))
    line = lambda s, sk, p, st: [_id(s, sk).alias("subject_id"), F.lit(p).alias("predicate"), _id("part", "l_partkey").alias("object_id"), F.lit(st).alias("subject_type"), F.lit("Part").alias("object_type"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"), F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("evidence_type"), F.col("l_orderkey").cast("string").alias("publication_id"), F.col("l_orderkey").cast("long").alias("ord")]
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_linestatus", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return (
        fixed("nation", "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey", "Nation", "Region")
        .unionAll(fixed("customer", "customer", "c_custkey", "LOCATED_IN", "nation", "c_nationkey", "Customer", "Nation"))
        .unionAll(fixed("supplier", "supplier", "s_suppkey", "LOCATED_IN", "nation", "s_nationkey", "Supplier", "Nation"))
        .unionAll(items.select(*line("supplier", "l_suppkey", "SUPPLIES", "Supplier")))
        .unionAll(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*line("customer", "o_custkey", "ORDERED", "Customer")))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_evidence(assertions(spark, d))


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph(nodes(spark, d), edges(spark, d))


def schema(spark: SparkSession) -> DataFrame:
    return predicate_schema(spark, SCHEMA)


_ITEM = "CAST(1.0 AS DOUBLE) - l_discount AS confidence, l_linestatus AS source, l_returnflag AS evidence_type, CAST(l_orderkey AS VARCHAR) AS publication_id"
_DIM = "CAST(1.0 AS DOUBLE) AS confidence, 'dim' AS source, 'curated' AS evidence_type, CAST(NULL AS VARCHAR) AS publication_id"

NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'Region' AS type, 'curated' AS origin FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation', 'curated' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer', CASE WHEN c_acctbal < 0 THEN 'LLM' ELSE 'curated' END FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier', 'curated' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'Part', 'curated' FROM part)"""
ASSERTIONS_SQL = f"""assertions AS (
  SELECT 'nation:' || n_nationkey AS subject_id, 'IN_REGION' AS predicate, 'region:' || n_regionkey AS object_id, {_DIM} FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey, {_DIM} FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, {_DIM} FROM supplier
  UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey, {_ITEM} FROM lineitem
  UNION ALL SELECT 'customer:' || o_custkey, 'ORDERED', 'part:' || l_partkey, {_ITEM} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES_SQL = """edges AS (
  SELECT subject_id, predicate, object_id, max(confidence) AS confidence, min(confidence) AS confidence_min, count(*) AS evidence_count,
    string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(DISTINCT evidence_type, '|' ORDER BY evidence_type) AS evidence_types
  FROM assertions GROUP BY ALL)"""
SCHEMA_SQL = """pschema AS (
  SELECT * FROM (VALUES ('IN_REGION', ['Nation'], ['Region']), ('LOCATED_IN', ['Customer', 'Supplier'], ['Nation']),
    ('SUPPLIES', ['Supplier'], ['Part']), ('ORDERED', ['Customer'], ['Nation'])) AS t(predicate, subject_types, object_types))"""
ENDS_SQL = """ends AS (SELECT subject_id AS id, 'subject' AS role FROM edges UNION ALL SELECT object_id, 'object' FROM edges)"""
DEGREES_SQL = """degrees AS (SELECT n.id, n.label, n.type, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY ALL)"""
GRAPH_SQL = f"WITH RECURSIVE {NODES_SQL}, {ASSERTIONS_SQL}, {EDGES_SQL}, {SCHEMA_SQL}, {ENDS_SQL}, {DEGREES_SQL}"
