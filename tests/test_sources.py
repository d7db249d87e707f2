"""Readers, writers, parsers and the stream, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from provloom import schema
from provloom.operators.assemble import aggregate_evidence
from provloom.operators.graph import PropertyGraph
from provloom.operators.qa import report
from provloom.sources import ontologies, remote, sinks, tables
from provloom.streaming import ingest as streaming


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv(spark, tmp_path):
    p = write(tmp_path / "t.tsv", 'object_id\tsubject_id\tconfidence\tnotes\no1\ts1\t0.5\t"say ""hi"""\no2\ts2\tbad\t\n')
    got = tables.read_triples(spark, p, schema.TRIPLE).orderBy("subject_id").collect()
    assert [(r.subject_id, r.object_id, r.confidence, r.notes, r.method, r._source_file) for r in got] == [("s1", "o1", 0.5, 'say "hi"', None, "t.tsv"), ("s2", "o2", None, None, None, "t.tsv")]


def test_nodes_and_edge_columns(spark, tmp_path):
    p = write(tmp_path / "n.tsv", "id\tlabel\ttype\na \tx y\tFood\n")
    assert [tuple(r) for r in tables.read_nodes(spark, p).collect()] == [("a", "x y", "Food", "")]
    with pytest.raises(ValueError, match="label"):
        tables.read_nodes(spark, write(tmp_path / "m.tsv", "id\ttype\na\tb\n"))
    assert tables.edge_columns(["Subject_ID", "rel_type", "my_object"]) == {"subject": "Subject_ID", "predicate": "rel_type", "object": "my_object"}
    assert tables.edge_columns(["a", "b"]) is None


def test_csv_json_dmp(spark, tmp_path):
    c = write(tmp_path / "c.csv", 'id,x,junk\n1,2.5,"a,b"\n2,NS,z\n')
    assert [tuple(r) for r in tables.read_csv_columns(spark, c, {"id": "int", "x": "double"}).orderBy("id").collect()] == [(1, 2.5), (2, None)]
    a = write(tmp_path / "a.json", json.dumps([{"k": 1}, {"k": 2}]))
    assert tables.read_json_array(spark, a, "k int").count() == 2
    j = write(tmp_path / "j.jsonl", '{"pmid": "1", "mesh_terms": ["a"]}\nbroken\n{"pmid": "2"}\n')
    assert [r.pmid for r in tables.read_jsonl(spark, j).orderBy("pmid").collect()] == ["1", "2"]
    d = write(tmp_path / "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tshort\t|\n9\t|\tEsch\t|\tEsch <x>\t|\tsynonym\t|\n")
    assert [(r.tax_id, r["name"], r.name_class) for r in tables.read_taxon_names(spark, d).orderBy("tax_id").collect()] == [(1, "root", "scientific name"), (9, "Esch", "synonym")]


def test_ontologies(spark, tmp_path):
    obo = write(tmp_path / "o.obo", 'format-version: 1.2\n\n[Term]\nid: X:1\nname: acid\nsynonym: "sour" EXACT []\nsynonym: "tart" RELATED []\n\n[Typedef]\nid: r\n\n[Term]\nid: X:2\nname: base\n')
    got = ontologies.read_ontology(spark, obo).orderBy("ord").collect()
    assert [(r.id, r.label, r.exact, r.other) for r in got] == [("X:1", "acid", ["sour"], ["tart"]), ("X:2", "base", [], [])]
    ns = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:o="http://www.geneontology.org/formats/oboInOwl#"'
    owl = write(tmp_path / "o.owl", f'<rdf:RDF {ns}><owl:Class rdf:about="http://x/obo/FOODON_12"><rdfs:label>milk</rdfs:label><o:hasRelatedSynonym>lait</o:hasRelatedSynonym></owl:Class></rdf:RDF>')
    assert [(r.id, r.label, r.exact) for r in ontologies.read_ontology(spark, owl).collect()] == [("FOODON:12", "milk", ["lait"])]
    with pytest.raises(ValueError):
        ontologies.read_ontology(spark, "x.txt")


def test_remote(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert remote.retried(flaky, sleep=lambda s: None) == "up"
    ids = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "id string")
    assert sorted(tuple(r) for r in remote.fetch(ids, "id", lambda some: [f"<{s}>" for s in some], partitions=2).collect()) == [("1", "<1>"), ("2", "<2>")]


def test_articles(spark):
    body = "word " * 30
    xml = f'<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Spring</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">{body}</AbstractText><AbstractText>end</AbstractText></Abstract><ELocationID EIdType="doi">10.1/x</ELocationID><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>Diet</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>'
    short = xml.replace(body, "x")
    got = remote.parse_articles(spark.createDataFrame([(xml,), (short,)], "response string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.pmid, r.year, r.doi, r.publication_types, r.mesh_terms) == ("7", "2019", "10.1/x", ["Review"], ["Diet"]) and r.abstract.startswith("AIM: word") and r.abstract.endswith("word end")


def test_extractions(spark):
    good = {"subject_name": "oat", "subject_type": "Food", "predicate": "CONTAINS", "object_name": "glucan", "object_type": "Bioactive", "evidence_span": "s", "evidence_type": "t", "confidence": 0.8, "notes": ""}
    bad = good | {"subject_type": "Microbe"}
    df = spark.createDataFrame([("1", "succeeded", json.dumps({"triples": [bad, good]})), ("2", "succeeded", json.dumps({"triples": [bad]})), ("3", "errored", None), ("4", "succeeded", "{}")], "pmid string, status string, answer string")
    got = sorted((r.pmid, r.triple_id, r.predicate) for r in remote.parse_extractions(df, schema.pair_schema(spark)).collect())
    assert got == [("1", "T1", "CONTAINS"), ("2", "T0", "NONE"), ("3", "ERROR", "ERROR"), ("4", "T0", "NONE")]


def test_few_shot_text(spark):
    src = spark.createDataFrame([("A1", "1", "t", "abs"), ("A2", "2", "t", "abs")], "annot_id string, pmid string, title string, abstract string")
    rows = spark.createDataFrame([("A1", 1, "s", "Food", "CONTAINS", "o", "Bioactive", "sp", "et", "-", None), ("A2", 1, "-", "-", "NONE", "-", "-", "-", "-", "-", None)], "annot_id string, ord int, subject_name string, subject_type string, predicate string, object_name string, object_type string, evidence_span string, evidence_type string, your_confidence string, notes string")
    got = {r.annot_id: r.example for r in remote.few_shot_text(src, rows).collect()}
    assert '"confidence" : 0.7' in got["A1"] and "Off-scope" in got["A2"]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x", "Food", None), ("b", "y", "Bioactive", "c")], schema.NODE)
    edges = spark.createDataFrame([("a", "P", "b", ["s", "t"])], "subject_id string, predicate string, object_id string, sources array<string>")
    assert [tuple(r) for r in sinks.flat_edges(edges, nodes).collect()] == [("a", "x", "P", "b", "y", "s|t")]
    assert sinks.write_tsv(edges.limit(0).select("predicate"), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    sinks.write_snapshot(nodes, edges, str(tmp_path / "snap"))
    assert spark.read.csv(str(tmp_path / "snap/nodes"), sep="\t", header=True).count() == 2
    assert sinks.replace_graph(nodes, edges, str(tmp_path / "g")) == (2, 1)
    new = spark.createDataFrame([("1", "x"), ("2", "y")], "pmid string, t string")
    store = str(tmp_path / "store")
    assert sinks.append_missing(new, store, "pmid") == 2 and sinks.append_missing(new.union(spark.createDataFrame([("3", "z")], "pmid string, t string")), store, "pmid") == 1
    built = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), lambda: built.append(1) or new).count() == 2
    assert built == [1]
    stats = PropertyGraph(nodes, edges).stats()
    assert sinks.statistics(stats)["edges_by_source"] == {"s": 1, "t": 1}
    assert sinks.write_release(stats, str(tmp_path / "rel"), "1.0").endswith("rel.zip")


def test_report(spark):
    nodes = spark.createDataFrame([("a", "x", "Food", "c"), ("b", "y", "Bioactive", "c")], schema.NODE)
    a = spark.createDataFrame([(1, "a", "Food", "CONTAINS", "b", "Bioactive", 0.5, "s", "e")], "ord int, subject_id string, subject_type string, predicate string, object_id string, object_type string, confidence double, source string, evidence_type string")
    text = report(PropertyGraph(nodes, aggregate_evidence(a)), a, schema.predicate_schema(spark))
    assert "PASS: orphan nodes: 0" in text and "## Components" in text


def test_stream(spark, tmp_path):
    fields = "subject_id string, predicate string, object_id string, source_id string, source string, subject_type string, object_type string, confidence double, evidence_type string"
    rows = [("a", "P", "b", "1", "s", "Food", "Bioactive", 0.5, "e"), ("a", "P", "b", "1", "s", "Food", "Bioactive", 0.5, "e"), ("a", "P", "b", "2", "s", "Food", "Bioactive", 0.9, "e")]
    inbox, store, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second round brings only repeats
        spark.createDataFrame(rows, fields).write.mode("append").parquet(inbox)
        streaming.append_to(spark.readStream.schema(fields).parquet(inbox), store, cp).awaitTermination()
    got = streaming.edges_of(spark, store).collect()
    assert [(r.evidence_count, r.confidence) for r in got] == [(2, 0.9)]
    assert spark.read.parquet(store).select(F.count("*")).first()[0] == 2
