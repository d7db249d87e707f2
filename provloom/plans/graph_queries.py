"""Graph lookups, assembly, quality checks, repair and iteration over the test graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_form
from ..operators import assemble, paths, qa, relational, repair
from ..sources import sinks
from . import testgraph as tg
from .registry import query, table

G = tg.GRAPH_SQL


@query(f"{G} SELECT id, label, type FROM nodes WHERE id = 'customer#000000007' OR lower(label) = lower('customer#000000007') ORDER BY CASE WHEN id = 'customer#000000007' THEN 0 ELSE 1 END, id LIMIT 1")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).get_entity("customer#000000007")


@query(f"{G} SELECT id, label, type FROM nodes WHERE contains(lower(label), 'ring') AND type = 'Part' ORDER BY length(label), label, id LIMIT 20")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).search_entities("RING", "Part")


_NEAR = "SELECT n.id, n.label, n.type, e.predicate, e.direction FROM e JOIN nodes n ON n.id = e.id"


@query(f"{G}, e AS (SELECT object_id AS id, predicate, 'out' AS direction FROM edges WHERE subject_id = 'supplier:3') {_NEAR}")
def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).neighbors("supplier:3", direction="out", limit=None)


@query(f"{G}, e AS (SELECT subject_id AS id, predicate, 'in' AS direction FROM edges WHERE object_id = 'nation:5' AND predicate = 'LOCATED_IN') {_NEAR}")
def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).neighbors("nation:5", "LOCATED_IN", "in", limit=None)


@query(f"{G}, e AS (SELECT object_id AS id, predicate, 'out' AS direction FROM edges WHERE subject_id = 'nation:5' UNION ALL SELECT subject_id, predicate, 'in' FROM edges WHERE object_id = 'nation:5') {_NEAR}")
def neighbors_both(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).neighbors("nation:5", limit=None)


@query(f"{G} SELECT e.subject_id, s.label AS subject, e.predicate, e.object_id, o.label AS object, e.confidence FROM edges e JOIN nodes s ON s.id = e.subject_id JOIN nodes o ON o.id = e.object_id WHERE e.predicate = 'SUPPLIES' AND e.confidence >= 0.97")
def edges_filtered(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).get_edges(predicate="SUPPLIES", obj="", min_confidence=0.97, limit=None)


@query(f"{G} SELECT subject_id, predicate, object_id, confidence, confidence_min, confidence AS confidence_max, evidence_count, sources, evidence_types FROM edges")
def evidence_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = tg.edges(spark, d)
    return e.select("subject_id", "predicate", "object_id", "confidence", "confidence_min", "confidence_max", "evidence_count", F.array_join("sources", "|").alias("sources"), F.array_join("evidence_types", "|").alias("evidence_types"))


@query(f"{G} SELECT subject_id, predicate, object_id, max(confidence) AS confidence, count(*) AS evidence_count, coalesce(string_agg(DISTINCT publication_id, '|' ORDER BY publication_id), '') AS evidence_pmids FROM assertions WHERE predicate = 'SUPPLIES' GROUP BY ALL")
def evidence_with_publications(spark: SparkSession, d: str) -> DataFrame:
    a = tg.assertions(spark, d).where("predicate = 'SUPPLIES'").withColumn("evidence_span", F.lit(None).cast("string"))
    e = assemble.aggregate_evidence(a, default=None, with_spans=True)
    return e.select("subject_id", "predicate", "object_id", "confidence", "evidence_count", F.array_join("evidence_pmids", "|").alias("evidence_pmids"))


@query(f"""{G} SELECT 'nodes' AS kind, 'all' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type
UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY predicate
UNION ALL SELECT 'source', s, count(*) FROM (SELECT unnest(string_split(sources, '|')) AS s FROM edges) GROUP BY s""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return tg.graph(spark, d).stats()


@query(f"{G}, u AS (SELECT subject_id, predicate, object_id, count(*) AS c FROM assertions GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS n_unique, count(*) FILTER (c > 1) AS repeated, round(sum(c) / count(*), 6) AS factor FROM u")
def triple_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return qa.multiplicity(tg.assertions(spark, d))


@query(f"{G} SELECT id, label, type FROM nodes WHERE id NOT IN (SELECT subject_id FROM edges WHERE evidence_count > 2 UNION SELECT object_id FROM edges WHERE evidence_count > 2)")
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    return qa.orphans(g.nodes, g.edges.where("evidence_count > 2")).select("id", "label", "type")


@query(f"{G} SELECT id, role, count(*) AS n FROM ends WHERE id NOT IN (SELECT id FROM nodes WHERE NOT (type = 'Part' AND contains(label, 'ring'))) GROUP BY ALL")
def integrity_dangling(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    return qa.dangling(g.nodes.where("not (type = 'Part' and contains(label, 'ring'))"), g.edges)


@query("SELECT 'user:' || user_id AS subject_id, event_type AS predicate, 'user:' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS object_id FROM events WHERE user_id = CAST(json_extract(props, '$.k') AS BIGINT)")
def integrity_self_loops(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject_id"), F.col("event_type").alias("predicate"), F.concat(F.lit("user:"), k.cast("string")).alias("object_id"))
    return qa.self_loops(e)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS redundant FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def integrity_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(f"""{G} SELECT 'node_id' AS "check", count(*) FILTER (id IS NULL) AS n FROM nodes UNION ALL SELECT 'node_label', count(*) FILTER (label IS NULL) FROM nodes
UNION ALL SELECT 'edge_sources', count(*) FILTER (CASE WHEN source = 'F' THEN NULL ELSE source END IS NULL) FROM assertions
UNION ALL SELECT 'literature_publication', count(*) FILTER (source = 'dim' AND publication_id IS NULL) FROM assertions""")
def integrity_missing(spark: SparkSession, d: str) -> DataFrame:
    renamed = F.when(F.col("source") == "dim", "LLM").otherwise(F.col("source"))
    a = tg.assertions(spark, d).withColumn("sources", F.when(F.col("source") != "F", F.array(renamed)))
    return qa.missing_properties(tg.nodes(spark, d), a)


@query(f"""{G} SELECT e.predicate, coalesce(CASE WHEN p.predicate IS NULL THEN 'unknown_predicate' WHEN NOT list_contains(p.subject_types, s.type) THEN 'subject_type'
WHEN NOT list_contains(p.object_types, o.type) THEN 'object_type' END, 'ok') AS reason, count(*) AS n
FROM edges e JOIN nodes s ON s.id = e.subject_id JOIN nodes o ON o.id = e.object_id LEFT JOIN pschema p ON p.predicate = e.predicate AND p.predicate <> 'IN_REGION' GROUP BY ALL""")
def schema_conformance(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    judged = qa.conformance(g.edges, g.nodes, tg.schema(spark).where("predicate <> 'IN_REGION'"))
    return judged.groupBy("predicate", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{G} SELECT a.predicate, s.type AS subject_type, o.type AS object_type, s.type || '-' || o.type IN ('Nation-Region', 'Supplier-Part') AS valid, count(*) AS n
FROM assertions a JOIN nodes s ON s.id = a.subject_id JOIN nodes o ON o.id = a.object_id GROUP BY ALL""")
def schema_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("IN_REGION", "Nation", "Region"), ("SUPPLIES", "Supplier", "Part"), ("ORDERED", "Part", "Customer")], "predicate string, subject_type string, object_type string")
    rows = tg.assertions(spark, d).groupBy("predicate", "subject_type", "object_type").agg(F.count(F.lit(1)).alias("n"))
    return qa.conforms_to_pair(rows, pairs).select("predicate", "subject_type", "object_type", "valid", "n")


@query(f"""{G} SELECT e.predicate, s.type AS subject_type, o.type AS object_type, count(*) AS n, bool_and(list_contains(p.subject_types, s.type) AND list_contains(p.object_types, o.type)) AS allowed
FROM edges e JOIN nodes s ON s.id = e.subject_id JOIN nodes o ON o.id = e.object_id JOIN pschema p ON p.predicate = e.predicate GROUP BY e.predicate, s.type, o.type""")
def endpoint_distribution(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    return qa.endpoint_distribution(g.edges, g.nodes, tg.schema(spark))


@query(f"""{G} SELECT type, count(degree) AS n, round(avg(degree), 6) AS mean, min(degree) AS min, quantile_cont(CAST(degree AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median,
quantile_cont(CAST(degree AS DOUBLE), 0.75) AS q3, round(quantile_cont(CAST(degree AS DOUBLE), 0.9), 6) AS p90, max(degree) AS max FROM degrees GROUP BY type""")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = relational.describe(tg.graph(spark, d).degrees(), F.col("degree"), ["type"])
    return found.select("type", "n", F.round("mean", 6).alias("mean"), F.col("min").cast("long").alias("min"), "q1", "median", "q3", F.round("p90", 6).alias("p90"), F.col("max").cast("long").alias("max"))


@query(f"{G} SELECT type, count(*) AS n, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM degrees GROUP BY type")
def degree_by_type(spark: SparkSession, d: str) -> DataFrame:
    return qa.degree_by_type(tg.graph(spark, d).degrees())


@query(f"{G}, t AS (SELECT * FROM degrees ORDER BY degree DESC, id LIMIT 20) SELECT id, label, type, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM t")
def top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return qa.hubs(tg.graph(spark, d).degrees(), 20)


@query(f"{G} SELECT predicate, count(*) AS n, round(min(confidence), 6) AS lo, round(quantile_cont(confidence, 0.25), 6) AS q1, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS q3, round(max(confidence), 6) AS hi, round(avg(confidence), 6) AS mean FROM edges GROUP BY predicate")
def confidence_quartiles(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return relational.describe(tg.edges(spark, d), F.col("confidence"), ["predicate"]).select("predicate", "n", r("min", "lo"), r("q1", "q1"), r("median", "median"), r("q3", "q3"), r("max", "hi"), r("mean", "mean"))


@query(f"{G} SELECT predicate, count(*) FILTER (NOT contains(sources, 'O')) AS curated, count(*) FILTER (contains(sources, 'O')) AS literature, count(*) AS total FROM edges GROUP BY predicate")
def provenance_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return qa.provenance(tg.edges(spark, d), F.array_contains("sources", "O"))


@query(f"{G} SELECT coalesce(type, 'TOTAL') AS type, count(*) FILTER (origin = 'LLM') AS literature, count(*) FILTER (origin = 'curated') AS curated FROM nodes GROUP BY ROLLUP (type)")
def provenance_rollup(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_total(tg.nodes(spark, d), "type", {"literature": F.count_if(F.col("origin") == "LLM"), "curated": F.count_if(F.col("origin") == "curated")})


@query(f"{G} SELECT type, origin, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 6) AS pct FROM nodes GROUP BY type, origin")
def provenance_shares(spark: SparkSession, d: str) -> DataFrame:
    return relational.shares(tg.nodes(spark, d), ["type", "origin"]).withColumn("pct", F.round("pct", 6))


@query(f"{G} SELECT evidence_count AS bin, count(*) AS n FROM edges GROUP BY ALL")
def evidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(tg.edges(spark, d), F.col("evidence_count"))


@query(f"{G} SELECT round(confidence, 2) AS bin, count(*) AS n FROM assertions GROUP BY ALL")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(tg.assertions(spark, d), F.round("confidence", 2))


@query(f"{G} SELECT evidence_type, source, count(*) AS n, count(DISTINCT publication_id) AS publications FROM assertions GROUP BY ALL")
def evidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    return tg.assertions(spark, d).groupBy("evidence_type", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("publication_id").alias("publications"))


_VOTES = f"""{G}, roles AS (SELECT subject_id AS id, p.subject_types AS ts FROM edges e JOIN pschema p USING (predicate) UNION ALL SELECT object_id, p.object_types FROM edges e JOIN pschema p USING (predicate)),
votes AS (SELECT id, ts[1] AS vote, count(*) AS n FROM roles WHERE len(ts) = 1 GROUP BY ALL),
won AS (SELECT n.id, n.type AS current, v.vote AS winner, v.n AS votes, row_number() OVER (PARTITION BY n.id ORDER BY v.n DESC, v.vote) AS r, CAST(coalesce(sum(v.n) FILTER (v.vote = n.type) OVER (PARTITION BY n.id), 0) AS BIGINT) AS current_votes FROM votes v JOIN nodes n ON n.id = v.id),
tally AS (SELECT id, current, winner, votes, current_votes, winner <> current AND votes > current_votes AS retype FROM won WHERE r = 1)"""


@query(f"{_VOTES} SELECT * FROM tally")
def majority_vote_types(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    return repair.vote_types(g.nodes, g.edges, tg.schema(spark))


@query(f"""{_VOTES}, retyped AS (SELECT n.id, CASE WHEN t.retype THEN t.winner ELSE n.type END AS type FROM nodes n LEFT JOIN tally t ON t.id = n.id)
SELECT e.predicate, CASE WHEN e.subject_id = e.object_id THEN 'self_loop' WHEN NOT list_contains(p.subject_types, s.type) OR NOT list_contains(p.object_types, o.type) THEN 'violation' ELSE 'keep' END AS action, count(*) AS n
FROM edges e JOIN retyped s ON s.id = e.subject_id JOIN retyped o ON o.id = e.object_id JOIN pschema p ON p.predicate = e.predicate GROUP BY ALL""")
def retype_then_drop(spark: SparkSession, d: str) -> DataFrame:
    g = tg.graph(spark, d)
    _, judged = repair.retype_then_drop(g.nodes, g.edges, tg.schema(spark))
    return judged.groupBy("predicate", "action").agg(F.count(F.lit(1)).alias("n"))


_CANON = "canon AS (SELECT 'part:' || p_partkey AS source_id, min('part:' || p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical_id FROM part)"


def _canonical_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("source_id"), "p_name", "p_brand")
    return p.join(p.groupBy("p_name", "p_brand").agg(F.min("source_id").alias("canonical_id")), ["p_name", "p_brand"]).select("source_id", "canonical_id")


@query(f"{G}, {_CANON} SELECT coalesce(s.canonical_id, a.subject_id) AS subject_id, a.predicate, coalesce(o.canonical_id, a.object_id) AS object_id, count(*) AS n FROM assertions a LEFT JOIN canon s ON s.source_id = a.subject_id LEFT JOIN canon o ON o.source_id = a.object_id GROUP BY ALL")
def canonical_reconcile(spark: SparkSession, d: str) -> DataFrame:
    done = assemble.reconcile(tg.assertions(spark, d).select("subject_id", "predicate", "object_id"), _canonical_parts(spark, d))
    return done.groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT 's' || l_suppkey AS id, l_shipmode_like AS label, 'Supplier' AS type, o, 0 AS r FROM (SELECT l_suppkey, l_partkey, l_returnflag AS l_shipmode_like, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS o FROM lineitem)
UNION ALL SELECT 'p' || l_partkey, l_linestatus, 'Part', l_orderkey * 100000000 + l_partkey * 10 + l_linenumber, 1 FROM lineitem)
SELECT id, arg_min(label, (o, r, label)) AS label, arg_min(type, (o, r, label)) AS type FROM m GROUP BY id""")
def first_wins_nodes(spark: SparkSession, d: str) -> DataFrame:
    o = F.struct((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("o"))
    t = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject_id"), F.col("l_returnflag").alias("subject_label"), F.lit("Supplier").alias("subject_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object_id"), F.col("l_linestatus").alias("object_label"), F.lit("Part").alias("object_type"), o.alias("ord"))
    mention = lambda r, n: t.select(F.col(f"{r}_id").alias("id"), F.col(f"{r}_label").alias("label"), F.col(f"{r}_type").alias("type"), "ord", F.lit(n).alias("_r"))
    return relational.first_wins(mention("subject", 0).unionAll(mention("object", 1)), ["id"], ["ord", "_r", "label"]).select("id", "label", "type")


@query("""SELECT coalesce(o.id, n.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.balance, o.balance) AS balance, o.segment FROM (SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance, c_mktsegment AS segment FROM customer) o
FULL JOIN (SELECT s_suppkey * 3 AS id, s_name AS label, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier) n ON o.id = n.id""")
def upsert_overlay(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("label"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return relational.upsert(old, new, ["id"])


@query(f"{G} SELECT a.predicate, count(*) AS kept, (SELECT count(*) FROM edges b WHERE b.predicate = a.predicate) - count(*) AS lost FROM edges a WHERE a.subject_id IN (SELECT id FROM nodes WHERE origin = 'curated') AND a.object_id IN (SELECT id FROM nodes WHERE origin = 'curated') GROUP BY a.predicate")
def upsert_edges_lost(spark: SparkSession, d: str) -> DataFrame:
    new = tg.edges(spark, d).select("subject_id", "predicate", "object_id", "confidence")
    kept, lost = assemble.upsert_edges(new.limit(0), new, tg.nodes(spark, d).where("origin = 'curated'"))
    count = lambda df, n: df.groupBy("predicate").agg(F.count(F.lit(1)).alias(n))
    return count(kept, "kept").join(count(lost, "lost"), "predicate", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))


@query(f"{G} SELECT trim(regexp_replace(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, string_agg(DISTINCT t, '|' ORDER BY t) AS types, count(DISTINCT t) AS n_types, count(*) AS n FROM (SELECT p_name AS label, p_type AS t FROM part) GROUP BY 1 HAVING count(DISTINCT t) > 1")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    return qa.name_collisions(table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_type").alias("type")), loose_form(F.col("label")))


@query(f"{G}, cells AS (SELECT subject_id AS id FROM assertions UNION ALL SELECT object_id FROM assertions UNION ALL SELECT source FROM assertions UNION ALL SELECT publication_id FROM assertions) SELECT n.id, count(c.id) AS degree FROM nodes n LEFT JOIN cells c ON c.id = n.id GROUP BY n.id")
def unpivot_degree(spark: SparkSession, d: str) -> DataFrame:
    return qa.cell_degrees(tg.nodes(spark, d), tg.assertions(spark, d).select("subject_id", "object_id", "source", "publication_id"))


@query(f"""{G} SELECT 'type' AS problem, type AS value, count(*) AS n FROM nodes WHERE type NOT IN ('Region', 'Nation', 'Part') GROUP BY type
UNION ALL SELECT 'predicate', predicate, count(*) FROM edges WHERE predicate NOT IN ('SUPPLIES') GROUP BY predicate
UNION ALL SELECT 'endpoint', role, count(*) FROM ends WHERE id NOT IN (SELECT id FROM nodes WHERE origin = 'curated') GROUP BY role""")
def load_gate(spark: SparkSession, d: str) -> DataFrame:
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    gate = qa.load_gate(n, e, ["Region", "Nation", "Part"], ["SUPPLIES"]).where("problem <> 'endpoint'")
    ends = qa.dangling(n.where("origin = 'curated'"), e).groupBy(F.lit("endpoint").alias("problem"), F.col("role").alias("value")).agg(F.sum("n").alias("n"))
    return gate.unionAll(ends)


_EXPORT = "coalesce(CAST({c} AS VARCHAR), '')"


@query(f"{G} SELECT e.subject_id, s.label AS subject_label, e.predicate, e.object_id, o.label AS object_label, CAST(e.evidence_count AS VARCHAR) AS evidence_count, e.sources, e.evidence_types FROM edges e LEFT JOIN nodes s ON s.id = e.subject_id LEFT JOIN nodes o ON o.id = e.object_id")
def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tg.edges(spark, d).select("subject_id", "predicate", "object_id", "evidence_count", "sources", "evidence_types")
    return sinks.flat_edges(e, tg.nodes(spark, d))


@query(f"{G} SELECT DISTINCT subject_id AS head, predicate AS relation, object_id AS tail FROM assertions")
def training_triples(spark: SparkSession, d: str) -> DataFrame:
    return sinks.training_triples(tg.assertions(spark, d))


@query(f"{G}, bad AS (SELECT subject_id, lower(predicate) AS p, object_id FROM edges WHERE evidence_count > 1), move AS (SELECT subject_id, object_id FROM edges WHERE predicate = 'SUPPLIES') SELECT e.subject_id, e.object_id, CASE WHEN b.p IS NULL THEN e.predicate WHEN m.subject_id IS NOT NULL THEN 'PRODUCES' ELSE e.predicate END AS predicate, CASE WHEN b.p IS NULL THEN 'keep' WHEN m.subject_id IS NOT NULL THEN 'rehome' ELSE 'drop' END AS action FROM edges e LEFT JOIN bad b ON b.subject_id = e.subject_id AND b.object_id = e.object_id AND b.p = lower(e.predicate) LEFT JOIN move m ON m.subject_id = e.subject_id AND m.object_id = e.object_id")
def edge_fixes(spark: SparkSession, d: str) -> DataFrame:
    e = tg.edges(spark, d)
    bad = e.where("evidence_count > 1").select("subject_id", F.lower("predicate").alias("predicate"), "object_id")
    move = e.where("predicate = 'SUPPLIES'").select("subject_id", "object_id")
    return repair.fix_edges(e.select("subject_id", "predicate", "object_id"), bad, move).select("subject_id", "object_id", "predicate", "action")


@query(f"{G}, dec AS (SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Supplier' WHEN c_custkey % 5 = 1 THEN 'Keep' WHEN c_custkey % 5 = 2 THEN '' WHEN c_custkey % 5 = 3 THEN 'Planet' ELSE 'Customer' END AS decision FROM customer) SELECT status, count(*) AS n FROM (SELECT CASE WHEN decision = 'Supplier' THEN 'retype' WHEN decision = 'Planet' THEN 'unrecognised' ELSE 'none' END AS status FROM dec) GROUP BY status")
def decision_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    dec = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.when(k == 0, "Supplier").when(k == 1, "Keep").when(k == 2, "").when(k == 3, "Planet").otherwise("Customer").alias("decision"))
    _, judged = repair.apply_decisions(tg.nodes(spark, d), dec, ("Customer", "Supplier", "Part"))
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{G} SELECT type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size = 1) GROUP BY type")
def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return repair.prune(tg.nodes(spark, d), gone).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents), s AS (SELECT component, count(*) AS size FROM c GROUP BY component)
SELECT size, count(*) AS n FROM s GROUP BY size""")
def components_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.format_string("d%012d", "doc_id").alias("id"), F.sha2("text", 256).alias("text"))
    links = docs.join(docs.groupBy("text").agg(F.min("id").alias("object_id")), "text").select(F.col("id").alias("subject_id"), "object_id")
    return paths.component_sizes(paths.components(docs.select("id"), links)).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{G}, u AS (SELECT DISTINCT * FROM (SELECT subject_id AS a, object_id AS b FROM edges UNION ALL SELECT object_id, subject_id FROM edges) WHERE a <> b),
r AS (SELECT 'customer:0' AS id, 0 AS hops UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.id WHERE r.hops < 5),
m AS (SELECT id, min(hops) AS hops FROM r GROUP BY id) SELECT hops, count(*) AS n FROM m GROUP BY hops""")
def shortest_path_hops(spark: SparkSession, d: str) -> DataFrame:
    e = tg.assertions(spark, d).select("subject_id", "predicate", "object_id")
    return paths.hops_from(e, "customer:0", 5).groupBy(F.col("hops").cast("int").alias("hops")).agg(F.count(F.lit(1)).alias("n"))
