"""Quality checks of a graph: integrity, schema conformance, topology, distributions, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assemble import endpoints, with_endpoints


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    return nodes.join(endpoints(edges).select("id"), "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, role, n): endpoints that aren't nodes."""
    return endpoints(edges).join(nodes.select("id"), "id", "left_anti").groupBy("id", "role").agg(F.count(F.lit(1)).alias("n"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("subject_id") == F.col("object_id"))


def missing_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): nodes without id or label, edges without sources, literature edges without publication."""
    from_literature = F.coalesce(F.array_contains("sources", "LLM"), F.lit(False))
    n = nodes.agg(F.count_if(F.col("id").isNull()).alias("node_id"), F.count_if(F.col("label").isNull()).alias("node_label"))
    e = edges.agg(F.count_if(F.col("sources").isNull()).alias("edge_sources"), F.count_if(from_literature & F.col("publication_id").isNull()).alias("literature_publication"))
    unpivot = lambda df: df.unpivot([], df.columns, "check", "n")
    return unpivot(n).unionAll(unpivot(e))


def conformance(edges: DataFrame, nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges with both endpoints known and ``reason``: null if they conform, else unknown_predicate, subject_type or
    object_type (the subject's reason wins)."""
    typed = with_endpoints(edges, nodes).join(schema, "predicate", "left")
    reason = (
        F.when(F.col("subject_types").isNull(), "unknown_predicate")
        .when(~F.coalesce(F.array_contains("subject_types", F.col("subject_type")), F.lit(False)), "subject_type")
        .when(~F.coalesce(F.array_contains("object_types", F.col("object_type")), F.lit(False)), "object_type")
    )
    return typed.withColumn("reason", reason).drop("subject_types", "object_types")


def conforms_to_pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose predicate allows exactly their two types; nulls equal nulls."""
    p = pairs.select("predicate", F.col("subject_type").alias("_s"), F.col("object_type").alias("_o"))
    return rows.join(p, "predicate", "left").withColumn("valid", F.coalesce(F.col("subject_type").eqNullSafe(F.col("_s")) & F.col("object_type").eqNullSafe(F.col("_o")) & F.col("_s").isNotNull(), F.lit(False))).drop("_s", "_o")


def endpoint_distribution(edges: DataFrame, nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """(predicate, subject_type, object_type, n, allowed) over all predicates, in one aggregation."""
    typed = with_endpoints(edges, nodes).groupBy("predicate", "subject_type", "object_type").agg(F.count(F.lit(1)).alias("n")).join(schema, "predicate", "left")
    ok = F.array_contains("subject_types", F.col("subject_type")) & F.array_contains("object_types", F.col("object_type"))
    return typed.select("predicate", "subject_type", "object_type", "n", F.coalesce(ok, F.lit(False)).alias("allowed"))


def multiplicity(assertions: DataFrame) -> DataFrame:
    """Rows, distinct (subject, predicate, object), rows for each; 0 for none."""
    unique = assertions.groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("c"))
    return unique.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("c") > 1).alias("repeated")).withColumn("factor", F.when(F.col("n_unique") > 0, F.round(F.col("total") / F.col("n_unique"), 6)).otherwise(0.0))


def degree_by_type(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


def hubs(degrees: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes of highest degree, numbered; ties by id.  Only the k rows are sorted in one place."""
    return degrees.orderBy(F.desc("degree"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


def provenance(edges: DataFrame, is_literature: Column, by: str = "predicate") -> DataFrame:
    """Curated and literature edges of each predicate."""
    return edges.groupBy(by).agg(F.count_if(~is_literature).alias("curated"), F.count_if(is_literature).alias("literature"), F.count(F.lit(1)).alias("total"))


def name_collisions(nodes: DataFrame, form: Column) -> DataFrame:
    """Normalised labels that nodes of several types have."""
    named = nodes.withColumn("name", form).where("name <> ''")
    return named.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"), F.count_distinct("type").alias("n_types"), F.count(F.lit(1)).alias("n")).where("n_types > 1")


def cell_degrees(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(id, degree): how many cells of any column of a table equal a node's id."""
    cells = table.select([F.col(c).cast("string").alias(c) for c in table.columns]).unpivot([], table.columns, "column", "id")
    counts = cells.where("id is not null").join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def load_gate(nodes: DataFrame, edges: DataFrame, types: list[str], predicates: list[str]) -> DataFrame:
    """(problem, value, n): unexpected types, predicates and endpoints; empty if the graph may be loaded."""
    t = nodes.where(~F.coalesce(F.col("type").isin(types), F.lit(False))).groupBy(F.lit("type").alias("problem"), F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    p = edges.where(~F.coalesce(F.col("predicate").isin(predicates), F.lit(False))).groupBy(F.lit("predicate"), "predicate").agg(F.count(F.lit(1)))
    d = dangling(nodes, edges).groupBy(F.lit("endpoint"), "role").agg(F.sum("n"))
    return t.unionAll(p).unionAll(d)


def samples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order, each with the number of all rows (``total``), for a report."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # one row on the right


def check_gate(found: DataFrame) -> None:
    """Raises on the first few problems of ``load_gate``."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("not loadable: " + "; ".join(f"{r['problem']} {r['value']} ({r['n']})" for r in rows))


def report(graph, assertions: DataFrame, schema: DataFrame) -> str:
    """The checks as Markdown; each table is aggregated to a few rows before it is collected."""
    from .paths import component_summary

    def section(title: str, df: DataFrame) -> str:
        rows = df.limit(50).collect()
        head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
        return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows) + "\n"

    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    degrees = graph.degrees()
    bad = conformance(graph.edges, graph.nodes, schema).where("reason is not null")
    checks = {"orphan nodes": orphans(graph.nodes, graph.edges), "dangling endpoints": dangling(graph.nodes, graph.edges), "self-loops": self_loops(graph.edges), "schema violations": bad}
    out = ["# Graph report\n\n", section("Size", graph.stats().orderBy("kind", "key")), section("Multiplicity", multiplicity(assertions)), "## Integrity\n\n"]
    for name, df in checks.items():
        n = count(df).collect()[0]["n"]
        out.append(f"- {'PASS' if n == 0 else 'WARN'}: {name}: {n}\n")
    out += ["\n", section("Violations", bad.groupBy("predicate", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("predicate", "reason")), section("Degree by type", degree_by_type(degrees).orderBy("type")), section("Hubs", hubs(degrees, 10)), section("Components", component_summary(graph.components()))]
    return "".join(out)
