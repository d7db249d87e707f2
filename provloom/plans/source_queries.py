"""Sources and sinks over whole tables: a table is written in a format, read by its source, and compared in SQL.

Files lie in the shared folder of the session.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import assemble, ingest, qa, repair, resolve, sample
from ..operators.paths import shared_path
from ..sources import extraction, ontologies, remote, sinks, tables
from ..streaming import ingest as streaming
from . import testgraph as tg
from .registry import query, table

G = tg.GRAPH_SQL


def _file(folder: str) -> str:
    """The one file that was written to a folder."""
    return next(p for p in sorted(glob.glob(f"{folder}/part-*")) if os.path.getsize(p))


def _lines(df: DataFrame, label: str, **options: str) -> str:
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).text(path)
    return path


# ---- delimited files ------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    path = shared_path(spark, "tsv")
    sinks.write_tsv(p, path)
    schema = p.select("p_partkey", "p_name", "p_brand", "p_size").schema
    return tables.read_tsv(spark, path, schema, lines=False)


@query(f"{G} SELECT id, label, type, origin FROM nodes")
def node_scan(spark: SparkSession, d: str) -> DataFrame:
    """Fields end in a carriage return, as files from other systems have them."""
    path = shared_path(spark, "nodes")
    sinks.write_tsv(tg.nodes(spark, d).withColumn("label", F.concat(F.lit(" "), "label", F.lit(" \r"))), path)
    return tables.read_nodes(spark, path).select("id", "label", "type", "origin")


@query(f"{G} SELECT predicate, count(*) AS n, count(DISTINCT subject_id) AS subjects, count(DISTINCT object_id) AS objects FROM edges GROUP BY predicate")
def edge_columns_scan(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by the names that edge files use."""
    path = shared_path(spark, "edges")
    e = tg.assertions(spark, d).select(F.col("object_id").alias("tail"), F.col("predicate").alias("rel_type"), F.col("subject_id").alias("head")).distinct()
    sinks.write_tsv(e, path)
    raw = spark.read.csv(path, sep="\t", header=True)
    at = tables.edge_columns(raw.columns)
    return raw.groupBy(F.col(at["predicate"]).alias("predicate")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(at["subject"]).alias("subjects"), F.count_distinct(at["object"]).alias("objects"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
def csv_columns_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three columns of a large file, one of them read as a number."""
    path = shared_path(spark, "csv")
    table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus").write.csv(path, header=True)
    found = tables.read_csv_columns(spark, path, {"l_orderkey": "long", "l_returnflag": "string"})
    return found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _lines(n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")), "json")  # a table of 25 rows
    return tables.read_json_array(spark, path, n.schema)


@query("SELECT conv_id AS pmid, arg_max(role, turn) AS title, arg_max(md5(text), turn) AS abstract FROM conversations GROUP BY conv_id")
def jsonl_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A record a line, some broken; of several of one key the last of the file counts."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("pmid"), F.col("role").alias("title"), F.md5("text").alias("abstract"), "turn")
    value = F.explode(F.array(F.to_json(F.struct("pmid", "title", "abstract")), F.lit('{"pmid": "1", "title": ')))
    path = _lines(c.coalesce(1).sortWithinPartitions("turn").select(value.alias("value")), "jsonl")
    found = tables.last_records(tables.read_jsonl(spark, path))
    return found.select(F.col("pmid").cast("long").alias("pmid"), "title", "abstract")


@query("SELECT 'P:' || p_partkey AS id, p_name AS label, p_brand AS exact, p_type AS other FROM part")
def obo_scan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    stanza = F.concat(F.lit("[Term]\nid: P:"), F.col("p_partkey").cast("string"), F.lit("\nname: "), "p_name", F.lit('\nsynonym: "'), "p_brand", F.lit('" EXACT []\nsynonym: "'), "p_type", F.lit('" RELATED []\n'))
    found = ontologies.read_ontology(spark, _obo(p.select(stanza.alias("value"))))
    return found.select("id", "label", F.get("exact", 0).alias("exact"), F.get("other", 0).alias("other"))


def _obo(stanzas: DataFrame) -> str:
    path = shared_path(stanzas.sparkSession, "terms") + ".obo"
    stanzas.write.text(path)
    return path


@query("SELECT 'N:' || n_nationkey AS id, n_name AS label, len(list_filter([n_name, CASE WHEN n_regionkey > 1 THEN 'x' END], lambda x: x IS NOT NULL)) AS names FROM nation")
def owl_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    more = F.when(F.col("n_regionkey") > 1, F.lit("<oboInOwl:hasRelatedSynonym>x</oboInOwl:hasRelatedSynonym>")).otherwise(F.lit(""))
    one = F.concat(F.lit('<owl:Class rdf:about="http://x.org/obo/N_'), F.col("n_nationkey").cast("string"), F.lit('"><rdfs:label>'), "n_name", F.lit("</rdfs:label><oboInOwl:hasExactSynonym>"), "n_name", F.lit("</oboInOwl:hasExactSynonym>"), more, F.lit("</owl:Class>"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">'
    path = _lines(n.agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), ""), F.lit("</rdf:RDF>")).alias("value")), "owl")  # a table of 25 rows
    return ontologies.read_owl(spark, _file(path)).select("id", "label", F.size("exact").cast("long").alias("names"))


@query("SELECT p_partkey AS tax_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'scientific name' ELSE 'synonym' END AS name_class FROM part")
def taxon_names_scan(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "scientific name").otherwise("synonym")
    line = F.concat(F.concat_ws("\t|\t", F.col("p_partkey").cast("string"), "p_name", F.lit(""), kind), F.lit("\t|"))
    path = _lines(table(spark, d, "part").select(F.explode(F.array(line, F.lit("short\t|"))).alias("value")), "names")
    return tables.read_taxon_names(spark, path).select("tax_id", "name", "name_class")


@query("""WITH RECURSIVE l AS (SELECT CAST(p_partkey AS BIGINT) AS tax_id, 0 AS depth, CAST(p_partkey AS BIGINT) AS ancestor FROM part UNION ALL SELECT l.tax_id, l.depth + 1, l.ancestor // 3 FROM l WHERE l.ancestor > 0)
SELECT depth, count(*) AS n, CAST(sum(ancestor) AS BIGINT) AS ancestors FROM l GROUP BY depth""")
def taxon_lineage(spark: SparkSession, d: str) -> DataFrame:
    """A dump of parents (a third of the number, the root its own), and every taxon's line up to the root."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    every = spark.range(0, p.agg(F.max("k")).first()[0] + 1).select(F.col("id").alias("k"))
    line = F.concat(F.concat_ws("\t|\t", F.col("k").cast("string"), F.floor(F.col("k") / 3).cast("string"), F.lit("species")), F.lit("\t|"))
    nodes = tables.read_taxon_nodes(spark, _lines(every.select(line.alias("value")), "taxa"))
    found = resolve.lineage(p.select(F.col("k").alias("tax_id")), nodes)
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("ancestor").alias("ancestors"))


@query("SELECT s_suppkey AS compound, n_name AS pathway FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def service_cache_scan(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers of a link service, with its prefixes."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = _lines(s.select(F.concat(F.lit("cpd:"), F.col("s_suppkey").cast("string"), F.lit("\tpath:"), "n_name").alias("value")), "links")
    return remote.read_two_column_tsv(spark, path, "compound", "pathway").select(F.col("compound").cast("long").alias("compound"), "pathway")


# ---- services, with clients that answer by rule ------------------------------------


@query("SELECT '/link/cpd/' || g AS request, 'C' || i AS compound, 'p' || g || i AS pathway FROM range(4) a(g), range(6) b(i) WHERE i < 2 + g")
def service_requests(spark: SparkSession, d: str) -> DataFrame:
    def client(request: str) -> str:
        g = int(request.rpartition("/")[2])
        return "\n".join(f"cpd:C{i}\tpath:p{g}{i}" for i in range(2 + g))

    return remote.read_service(spark, [f"/link/cpd/{g}" for g in range(4)], client, "compound", "pathway", per_second=1000.0)


@query("SELECT 'q' || m AS query, CAST(i AS VARCHAR) AS id FROM (VALUES (2), (3), (7)) t(m), range(900) r(i) WHERE i % m = 0")
def paged_search(spark: SparkSession, d: str) -> DataFrame:
    """Three searches, 50 results a page; pages overlap by one result, which counts once."""

    def client(query: str, at: int, page: int) -> list[str]:
        every = [str(i) for i in range(900) if i % int(query[1:]) == 0]
        return every[max(0, at - 1) : at + page]

    return remote.search_pages(spark, [("q2", 450), ("q3", 300), ("q7", 129)], client, page=50)


@query("""SELECT DISTINCT p_brand AS name, CASE WHEN ends_with(p_brand, '1') THEN 'B:' || lower(p_brand) WHEN ends_with(p_brand, '2') THEN 'F:' || left(lower(p_brand), 5) END AS id, CASE WHEN ends_with(p_brand, '1') THEN lower(p_brand) WHEN ends_with(p_brand, '2') THEN 'near' END AS label,
CASE WHEN ends_with(p_brand, '1') THEN 'exact' WHEN ends_with(p_brand, '2') THEN 'fuzzy' ELSE 'no_match' END AS match_type FROM part""")
def remote_look_up(spark: SparkSession, d: str) -> DataFrame:
    def exact(name: str) -> tuple[str, str] | None:
        return (f"B:{name}", name) if name.endswith("1") else None

    def fuzzy(name: str) -> tuple[str, str] | None:
        return (f"F:{name[:5]}", "near") if name.endswith("2") else None

    return remote.look_up(table(spark, d, "part"), "p_brand", exact, fuzzy)


class _RuleClient:
    """Answers a request by its id: every fifth fails in the first batch that holds it."""

    def __init__(self, folder: str):
        self.folder = folder

    def submit(self, requests: list[tuple[str, str]]) -> str:
        os.makedirs(self.folder, exist_ok=True)
        batch_id = f"{len(requests):05}-{requests[0][0]}-{os.getpid()}-{os.urandom(4).hex()}"
        with open(f"{self.folder}/{batch_id}", "w", encoding="utf-8") as f:
            f.writelines(f"{i}\n" for i, _ in requests)
        return batch_id

    def _ids(self, batch_id: str) -> list[str]:
        with open(f"{self.folder}/{batch_id}", encoding="utf-8") as f:
            return f.read().split()

    def status(self, batch_id: str) -> dict[str, int]:
        return {"succeeded": len(self._ids(batch_id)), "processing": 0}

    def results(self, batch_id: str) -> list[tuple[str, str, str | None]]:
        ids = self._ids(batch_id)
        first = any(int(i) % 5 for i in ids)  # a retry holds failed ones alone
        triple = '{{"subject_name": "s", "subject_type": "Food", "predicate": "CONTAINS", "object_name": "{}", "object_type": "Bioactive", "evidence_span": "x", "evidence_type": "y", "confidence": 0.9, "notes": ""}}'
        return [(i, "errored", None) if first and int(i) % 5 == 0 else (i, "succeeded", '{"triples": [' + (triple.format(i) if int(i) % 2 else "") + "]}") for i in ids]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CASE WHEN o_orderkey % 2 = 1 THEN 'T1' ELSE 'T0' END AS triple_id, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '-' END AS object_name FROM orders")
def extraction_batches(spark: SparkSession, d: str) -> DataFrame:
    """All orders as requests: submitted in batches, processed, the failed ones submitted again and processed."""
    from ..schema import pair_schema

    folder = shared_path(spark, "extraction")
    job = extraction.Extraction(spark, folder, _RuleClient(f"{folder}-service"), batch_size=1000)
    requests = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.lit("p").alias("prompt"), F.lit(10).cast("long").alias("input_tokens"))
    job.submit(requests)
    job.process()
    job.retry(requests)
    job.process()
    return job.rows(pair_schema(spark)).select("pmid", "triple_id", "object_name")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, 'title ' || doc_id AS title, 'AIM: ' || md5(text) || md5(text) || md5(text) || md5(text) AS abstract, '19' || (doc_id % 90 + 10) AS year FROM documents WHERE doc_id % 3 <> 0")
def article_parse(spark: SparkSession, d: str) -> DataFrame:
    """Article records from XML; every third has too short an abstract."""
    doc = F.col("doc_id").cast("string")
    long = F.when(F.col("doc_id") % 3 != 0, F.repeat(F.md5("text"), F.lit(4))).otherwise(F.lit("short"))
    year = (F.col("doc_id") % 90 + 10).cast("string")
    xml = F.concat(F.lit("<A><MedlineCitation><PMID>"), doc, F.lit("</PMID><Article><ArticleTitle>title "), doc, F.lit('</ArticleTitle><Abstract><AbstractText Label="AIM">'), long, F.lit("</AbstractText></Abstract><Journal><JournalIssue><PubDate><MedlineDate>19"), year, F.lit(" Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></A>"))
    return remote.parse_articles(table(spark, d, "documents").select(xml.alias("response"))).select("pmid", "title", "abstract", "year")


# ---- sinks, loads, caches ------------------------------------------------------------


@query(f"{G} SELECT predicate, count(*) AS n, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM edges GROUP BY predicate UNION ALL SELECT type, count(*), NULL FROM nodes GROUP BY type")
def graph_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A graph is stored, then replaced by itself read back."""
    path = shared_path(spark, "graph")
    for _ in range(2):
        stored = [spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges")] if _ else [tg.nodes(spark, d), tg.edges(spark, d)]
        sinks.replace_graph(*stored, path)
    nodes, edges = (spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges"))
    by = edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence_count").cast("long").alias("evidence"))
    return by.unionAll(nodes.groupBy(F.col("type").alias("predicate")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("evidence")))


@query("SELECT c_nationkey % 4 AS kind, count(*) AS n FROM customer GROUP BY kind")
def table_cache(spark: SparkSession, d: str) -> DataFrame:
    """Built once: the second call reads what the first one wrote."""
    path = shared_path(spark, "cache")
    build = lambda: table(spark, d, "customer").groupBy((F.col("c_nationkey") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    sinks.cached(spark, path, build)

    def never() -> DataFrame:
        raise AssertionError("built twice")

    return sinks.cached(spark, path, never)


@query(f"{G} SELECT 'nodes_by_type' AS kind, type AS key, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges_by_predicate', predicate, count(*) FROM edges GROUP BY predicate UNION ALL SELECT 'total_nodes', 'all', count(*) FROM nodes UNION ALL SELECT 'total_edges', 'all', count(*) FROM edges")
def release_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The figures that a release's files are written from."""
    found = sinks.statistics(tg.graph(spark, d).stats())
    rows = [(k, key, n) for k in ("nodes_by_type", "edges_by_predicate") for key, n in found[k].items()] + [(k, "all", found[k]) for k in ("total_nodes", "total_edges")]
    return spark.createDataFrame(rows, "kind string, key string, n long")


@query(f"{G}, l AS (SELECT 'part:' || (p_partkey * 2) AS id, 'new' AS label, 'Part' AS type FROM part), n AS (SELECT id, label, type, origin FROM nodes UNION ALL SELECT id, label, type, NULL FROM l WHERE id NOT IN (SELECT id FROM nodes)) SELECT label = 'new' AS added, type, count(*) AS n, (SELECT count(*) FROM assertions) + (SELECT count(*) FROM l) AS assertions FROM n GROUP BY ALL")
def literature_load(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that aren't there yet are added, every extracted row becomes an assertion."""
    new = table(spark, d, "part").select(F.concat(F.lit("part:"), (F.col("p_partkey") * 2).cast("string")).alias("id"), F.lit("new").alias("label"), F.lit("Part").alias("type"))
    rows = new.select(F.col("id").alias("subject_id"), F.lit("SUPPLIES").alias("predicate"), F.col("id").alias("object_id"))
    nodes, assertions = assemble.load_literature(tg.nodes(spark, d), tg.assertions(spark, d), new, rows)
    total = assertions.agg(F.count(F.lit(1)).alias("assertions"))
    return nodes.groupBy((F.col("label") == "new").alias("added"), "type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row on the right


@query(f"{G} SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM ends) GROUP BY type")
def referenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    return assemble.referenced(tg.nodes(spark, d), tg.assertions(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS seen, count(*) FILTER (value > 10) AS passed, CAST(round(count(*) FILTER (value > 10) / count(*) * 5145533) AS BIGINT) AS estimate FROM events")
def volume_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The report's share is of the first rows; here they are all rows."""
    return sample.volume_estimate(table(spark, d, "events"), F.col("value") > 10, 2**31 - 1, 5_145_533)


@query("SELECT subject_id, predicate, object_id, evidence_count FROM (SELECT user_id AS subject_id, event_type AS predicate, CAST(value > 10 AS VARCHAR) AS object_id, count(DISTINCT event_id % 50) AS evidence_count FROM events GROUP BY ALL)")
def streamed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Assertions that arrive as a stream of files, with repeats, appended once each and aggregated."""
    inbox, store, at = (shared_path(spark, x) for x in ("inbox", "store", "stream"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("predicate"), (F.col("value") > 10).cast("string").alias("object_id"), (F.col("event_id") % 50).cast("string").alias("source_id"))
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    e = e.select("*", F.lit("s").alias("source"), none("evidence_type"), none("subject_type"), none("object_type"), F.lit(1.0).alias("confidence"))
    for part in range(2):  # two arrivals
        e.where(F.pmod(F.xxhash64("source_id"), F.lit(2)) == part).write.mode("append").parquet(inbox)
        streaming.append_to(spark.readStream.schema(e.schema).parquet(inbox), store, at).awaitTermination()
    return streaming.edges_of(spark, store).select(F.col("subject_id").cast("long").alias("subject_id"), "predicate", "object_id", "evidence_count")


# ---- the rest of the operators ---------------------------------------------------------


@query("SELECT DISTINCT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL') OR p_partkey IN (SELECT s_suppkey FROM supplier)")
def superclass_or_allowed(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return ingest.in_classes(table(spark, d, "part").select("p_partkey", "p_type", "p_size"), "p_type", ("ECONOMY", "SMALL"), "p_partkey", ids)


@query(f"{G}, r AS (SELECT n.id, n.type AS bucket, CASE WHEN p.p_size % 2 = 0 THEN CAST(p.p_size AS BIGINT) END AS degree FROM nodes n LEFT JOIN part p ON n.id = 'part:' || p.p_partkey) SELECT id, bucket, degree, row_number() OVER (ORDER BY bucket, coalesce(degree, 0) DESC, id) AS place FROM r")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in a reviewer's order: an unknown degree stands as 0."""
    from ..operators.relational import numbered

    part = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")).alias("degree"))
    r = tg.nodes(spark, d).select("id", F.col("type").alias("bucket")).join(part, "id", "left")
    ordered = repair.review_order(r)
    return numbered(ordered, "place", ["bucket", F.coalesce("degree", F.lit(0)).desc(), "id"])


@query("SELECT lang AS type, count(DISTINCT doc_id % 500) AS n FROM documents WHERE n_chars > 800 GROUP BY lang")
def new_nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ingest.new_nodes_by_type(table(spark, d, "documents").select((F.col("doc_id") % 500).alias("id"), F.col("lang").alias("type"), (F.col("n_chars") > 800).alias("is_new")))


@query("SELECT 'source' AS kind, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM events WHERE contains(upper(event_type), 'CLI'))) AS covered, count(DISTINCT user_id) AS total, round(100.0 * count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM events WHERE contains(upper(event_type), 'CLI'))) / count(DISTINCT user_id), 6) AS pct FROM events UNION ALL SELECT 'match', count(DISTINCT p_name) FILTER (p_name IN (SELECT p_name FROM part WHERE p_size > 40)), count(DISTINCT p_name), round(100.0 * count(DISTINCT p_name) FILTER (p_name IN (SELECT p_name FROM part WHERE p_size > 40)) / count(DISTINCT p_name), 6) FROM part")
def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    e, p = table(spark, d, "events"), table(spark, d, "part")
    a = ingest.source_coverage(e, e, "user_id", "event_type", "cli")
    b = ingest.match_coverage(p.select(F.col("p_name").alias("name")), p.where("p_size > 40").select(F.col("p_name").alias("query"), F.col("p_brand").alias("id")))
    return a.select(F.lit("source").alias("kind"), "*").unionAll(b.select(F.lit("match").alias("kind"), "*"))


@query("SELECT l_returnflag, count(*) AS total, min(x) AS x FROM (SELECT l_returnflag, l_orderkey + 0 AS x FROM lineitem) GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 2")
def first_samples(spark: SparkSession, d: str) -> DataFrame:
    """The smallest order of the first two flags, each beside the number of rows of its flag."""
    line = table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").cast("long").alias("x"))
    flags = [r[0] for r in line.select("l_returnflag").distinct().orderBy("l_returnflag").limit(2).collect()]
    one = [qa.samples(line.where(F.col("l_returnflag") == f), ["x"], 1) for f in flags]
    return one[0].unionAll(one[1]).select("l_returnflag", "total", "x")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS part FROM (SELECT CAST('0x' || left(md5(CAST(event_id AS VARCHAR) || ':42'), 8) AS BIGINT) / 4294967296.0 AS u FROM events)) GROUP BY part")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    split = sample.hash_split(table(spark, d, "events"), F.col("event_id"), {"train": 8, "valid": 1, "test": 1})
    return split.groupBy(F.col("split").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, count(DISTINCT printf('%.3g', CAST(l_extendedprice AS DOUBLE))) AS forms, min(printf('%.3g', CAST(l_extendedprice AS DOUBLE))) AS least FROM lineitem GROUP BY l_linestatus")
def three_digit_notes(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "lineitem").select("l_linestatus", scores.format_g3(F.col("l_extendedprice").cast("double")).alias("v"))
    return shown.groupBy("l_linestatus").agg(F.count_distinct("v").alias("forms"), F.min("v").alias("least"))


@query("SELECT p_partkey, trim(p_name) AS cleaned, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS parts, round(100.0 * p_size / 50, 6) AS pct FROM part")
def field_helpers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    joined = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("||"), "p_brand")).otherwise(F.concat("p_name", F.lit("|")))
    return p.select("p_partkey", text.clean(F.concat(F.lit(" "), "p_name", F.lit("\r "))).alias("cleaned"), F.size(text.split_list(joined)).cast("long").alias("parts"), F.round(text.percent(F.col("p_size"), F.lit(50)), 6).alias("pct"))


@query(f"{G} SELECT * FROM (SELECT 'orphan nodes' AS name, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM ends) UNION ALL SELECT 'dangling endpoints', count(*) FROM ends WHERE id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'self-loops', count(*) FROM edges WHERE subject_id = object_id)")
def report_checks(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a report's checks, read from its text."""
    import re

    made = qa.report(tg.graph(spark, d), tg.assertions(spark, d), tg.schema(spark))
    rows = [(name, int(n)) for name, n in re.findall(r"- (?:PASS|WARN): ([a-z -]+): (\d+)", made) if name != "schema violations"]
    return spark.createDataFrame(rows, "name string, n long")
