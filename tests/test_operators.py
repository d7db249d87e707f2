"""Operators on hand-made rows: ties, nulls, loops, dangling ends, empty tables."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provloom import schema
from provloom.operators import assemble, evaluate, ingest, paths, qa, relational, repair, resolve, sample, vectors
from provloom.operators.graph import PropertyGraph

NODE = "id string, label string, type string, origin string"
EDGE = "subject_id string, predicate string, object_id string, confidence double"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("n1", "Oat", "Food", "c"), ("n2", "oat bran", "Food", "c"), ("n3", "Beta-glucan", "Bioactive", "c"), ("n4", "Roseburia", "Microbe", "LLM"), ("n5", "lonely", "Food", "c")], NODE)
    edges = spark.createDataFrame([("n1", "CONTAINS", "n3", 0.9), ("n1", "CONTAINS", "n3", None), ("n2", "CONTAINS", "n3", 0.4), ("n3", "INCREASES", "n4", 0.0), ("n4", "SELF", "n4", 0.7), ("n1", "CONTAINS", "gone", 0.8)], EDGE)
    return PropertyGraph(nodes, edges)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_lookup(graph):
    assert rows(graph.get_entity("OAT"), "id") == [("n1",)]
    assert rows(graph.get_entity("n3"), "id") == [("n3",)]
    assert graph.get_entity("nothing").collect() == []
    with pytest.raises(KeyError):
        graph.resolve("nothing")
    assert [r["id"] for r in graph.search_entities("OAT").collect()] == ["n1", "n2"]
    assert rows(graph.search_entities("a", "Microbe"), "id") == [("n4",)]


def test_neighbors_and_edges(graph):
    assert rows(graph.neighbors("n3"), "id", "direction") == [("n1", "in"), ("n1", "in"), ("n2", "in"), ("n4", "out")]
    assert rows(graph.neighbors("n4", direction="both"), "id", "direction") == [("n3", "in"), ("n4", "out")]
    assert len(graph.get_edges("n1", obj="").collect()) == 2  # the dangling one has no label
    assert rows(graph.get_edges(min_confidence=0.0), "subject_id", "confidence") == [("n1", 0.9), ("n2", 0.4), ("n3", 0.0), ("n4", 0.7)]


def test_degrees_count_loops_twice(graph):
    assert dict(rows(graph.degrees(), "id", "degree")) == {"n1": 3, "n2": 1, "n3": 4, "n4": 3, "n5": 0}


def test_integrity(graph, spark):
    assert rows(qa.orphans(graph.nodes, graph.edges), "id") == [("n5",)]
    assert rows(qa.dangling(graph.nodes, graph.edges)) == [("gone", "object", 1)]
    assert rows(qa.self_loops(graph.edges), "subject_id") == [("n4",)]
    judged = qa.conformance(graph.edges, graph.nodes, schema.predicate_schema(spark))
    assert rows(judged.groupBy("predicate", "reason").count()) == [("CONTAINS", None, 3), ("INCREASES", "unknown_predicate", 1), ("SELF", "unknown_predicate", 1)]
    with pytest.raises(ValueError):
        qa.check_gate(qa.load_gate(graph.nodes, graph.edges, ["Food"], ["CONTAINS"]))


def test_paths(graph):
    assert graph.shortest_path("n1", "n4") == (["Oat", "Beta-glucan", "Roseburia"], ["CONTAINS", "INCREASES"])
    assert graph.shortest_path("n4", "n2") == (["Roseburia", "Beta-glucan", "oat bran"], ["INCREASES", "CONTAINS"])
    assert graph.shortest_path("n1", "n5") is None
    assert graph.shortest_path("n1", "n4", max_hops=1) is None
    assert graph.shortest_path("n1", "n1") == (["Oat"], [])


def test_components(graph, spark):
    assert dict(rows(graph.components(), "id", "component")) == {"n1": "n1", "n2": "n1", "n3": "n1", "n4": "n1", "n5": "n5"}
    empty = graph.edges.limit(0)
    assert rows(paths.component_summary(paths.components(graph.nodes, empty))) == [(5, 1, 20.0, 5)]
    rng = random.Random(3)
    pairs = [(f"v{rng.randrange(60):02d}", "p", f"v{rng.randrange(60):02d}", 1.0) for _ in range(45)]
    nodes = spark.createDataFrame([(f"v{i:02d}", "", "", "") for i in range(60)], NODE)
    root = {f"v{i:02d}": f"v{i:02d}" for i in range(60)}
    for _ in range(60):
        for a, _, b, _ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(rows(paths.components(nodes, spark.createDataFrame(pairs, EDGE)), "id", "component")) == root


def test_aggregation(spark):
    t = spark.createDataFrame(
        [(2, "a", "Food", "P", "b", "X", None, "s2", "", "1"), (1, "a", "Meal", "P", "b", "Y", 0.9, "s1", "e", "1"), (3, "a", "Food", "Q", "b", "X", 0.1, "s1", "e", "2")],
        "ord int, subject_id string, subject_type string, predicate string, object_id string, object_type string, confidence double, source string, evidence_type string, publication_id string",
    )
    known = spark.createDataFrame([("P",)], "predicate string")
    got = assemble.aggregate_evidence(t, known).collect()
    assert [(r.subject_type, r.object_type, r.confidence, r.confidence_min, r.evidence_count, r.sources, r.evidence_types) for r in got] == [("Meal", "Y", 0.9, 0.5, 2, ["s1", "s2"], ["e"])]
    assert assemble.aggregate_evidence(t.limit(0), known).collect() == []


def test_first_wins_upsert_override(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "y")], "k string, o int, v string")
    assert rows(relational.first_wins(df, ["k"], ["o"]), "k", "v") == [("a", None), ("b", "y")]
    assert {r.k: r.v for r in relational.last_wins(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "y"}
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "k string, n int, v string")
    assert {r.k: (r.n, r.v) for r in relational.upsert(old, new, ["k"]).collect()} == {"a": (1, "x"), "b": (2, "z"), "c": (3, None)}
    assert {r.k: (r.n, r.v) for r in relational.override(old, new, ["k"]).collect()} == {"a": (1, "x"), "b": (None, "z"), "c": (3, None)}
    with pytest.raises(ValueError):
        relational.unique_or_fail(df, ["k"])


def test_numbered_without_key(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert rows(relational.numbered(df, "n", ["v"]), "v", "n") == [(i, i + 1) for i in range(1000)]


def test_votes(spark):
    s = spark.createDataFrame([("EATS", ["Food"], ["Bug", "Drug"]), ("IN", ["Bug"], ["Gut"])], "predicate string, subject_types array<string>, object_types array<string>")
    nodes = spark.createDataFrame([("x", "", "Drug", ""), ("y", "", "Food", ""), ("z", "", "Bug", "")], NODE)
    edges = spark.createDataFrame([("x", "EATS", "z", 1.0), ("x", "IN", "z", 1.0), ("y", "EATS", "x", 1.0), ("y", "IN", "q", 1.0), ("z", "IN", "z", 1.0)], EDGE)
    got = {r.id: (r.winner, r.votes, r.retype) for r in repair.vote_types(nodes, edges, s).collect()}
    assert got == {"x": ("Bug", 1, True), "y": ("Bug", 1, False), "z": ("Gut", 2, True)}


def test_decisions_and_fixes(spark):
    nodes = spark.createDataFrame([("a", "", "Food", ""), ("b", "", "Food", ""), ("c", "", "Food", "")], NODE)
    d = spark.createDataFrame([("a", "Microbe\r"), ("b", "keep"), ("c", "Planet"), ("zz", "Food")], "id string, decision string")
    changed, judged = repair.apply_decisions(nodes, d, ("Food", "Microbe"))
    assert dict(rows(changed, "id", "type")) == {"a": "Microbe", "b": "Food", "c": "Food"}
    assert dict(rows(judged, "id", "status")) == {"a": "retype", "b": "none", "c": "unrecognised"}
    edges = spark.createDataFrame([("a", "CONTAINS", "b", 1.0), ("a", "contains", "c", 1.0), ("b", "CONTAINS", "c", 1.0)], EDGE)
    bad = spark.createDataFrame([("a", "contains", "b"), ("a", "contains", "c"), ("q", "p", "r")], "subject_id string, predicate string, object_id string")
    move = spark.createDataFrame([("a", "b")], "subject_id string, object_id string")
    assert rows(repair.fix_edges(edges, bad, move), "subject_id", "object_id", "predicate", "action") == [("a", "b", "PRODUCES", "rehome"), ("a", "c", "contains", "drop"), ("b", "c", "CONTAINS", "keep")]
    assert rows(repair.unmatched_violations(edges, bad), "subject_id") == [("q",)]


def test_ontology_cascade(spark):
    onto = spark.createDataFrame([("1", "Butyrate (anion)", ["butanoate"], ["salt"], 1), ("2", "butyrate", [], [], 2), ("3", "sodium butyrate", ["butyrate"], [], 3), ("4", None, None, ["xbutyratex"], 4)], "id string, label string, exact array<string>, other array<string>, ord long")
    q = spark.createDataFrame([("Butyrate",), ("butanoate",), ("nope",)], "query string")
    got = [(r.query, r.rank, r.id, r.match_type) for r in resolve.search_ontology(q, onto).orderBy("query", "rank").collect()]
    assert got == [("Butyrate", 1, "2", "exact_label"), ("Butyrate", 2, "3", "exact_synonym"), ("Butyrate", 3, "1", "label_starts_with"), ("Butyrate", 4, "4", "substring_synonym"), ("butanoate", 1, "1", "exact_synonym")]
    assert {r.query: (r.id, r.match_type) for r in resolve.resolve_exact(q, onto).collect()} == {"Butyrate": ("2", "exact_label"), "butanoate": ("1", "exact_synonym"), "nope": (None, None)}


def test_resolve_entities_type_overrides(spark):
    nodes = spark.createDataFrame([("n1", "Apples", "Food", 1), ("n2", "apple", "Bioactive", 2)], "id string, label string, type string, ord int")
    m = spark.createDataFrame([("the apple", "Microbe"), ("Pear_juice", "Food")], "name string, type string")
    got = {r.name: (r.id, r.type, r.is_new) for r in resolve.resolve_entities(m, nodes).collect()}
    assert got == {"the apple": ("n1", "Food", False), "Pear_juice": ("LLM:pear_juice", "Food", True)}


def test_evaluation(spark):
    cols = "ord int, annot_id string, predicate string, subject_name string, object_name string"
    gold = spark.createDataFrame([(1, "A1", "P", "oat", "beta glucan"), (2, "A1", "P", "oats", "beta-glucan"), (3, "A2", "NONE", "-", "-"), (4, "A3", "NONE", "-", "-"), (5, "A4", "Q", "x", "y")], cols)
    found = spark.createDataFrame([(1, "A1", "P", "oats", "beta glucans"), (2, "A1", "R", "oat", "beta glucan"), (3, "A3", "P", "a", "b"), (4, "A3", "ERROR", "-", "-")], cols)
    out = evaluate.evaluate(gold, found, spark.createDataFrame([("A1", "s1")], "annot_id string, stratum string"))
    o = out["overall"].collect()[0]
    assert (o.tp, o.fp, o.fn, o.precision, o.recall) == (1, 3, 2, 0.25, 0.333333)
    assert tuple(out["refusals"].collect()[0]) == (1, 1, 2)
    assert {r.stratum: (r.tp, r.fp, r.fn) for r in out["stratum"].collect()} == {"s1": (1, 1, 1), "unknown": (0, 2, 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 5)), max_size=25))
def test_greedy_is_one_to_one(spark, pairs):
    df = spark.createDataFrame(sorted({(f"g{g}", a, b) for g, a, b in pairs}) or [], "annot_id string, gold_ord int, found_ord int")
    got = [tuple(r) for r in evaluate.greedy_match(df).collect()]
    assert len({(g, a) for g, a, _ in got}) == len(got) == len({(g, b) for g, _, b in got})
    want = []
    used, done = set(), set()
    for g, a, b in sorted({(f"g{g}", a, b) for g, a, b in pairs}):
        if (g, a) not in done and (g, b) not in used:
            want.append((g, a, b))
            done.add((g, a))
            used.add((g, b))
    assert sorted(got) == want


def test_sampling(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 3, "small").otherwise("big").alias("s"))
    assert rows(sample.stratified(df, "s", "id", {"small": 10, "big": 5}).groupBy("s").count()) == [("big", 5), ("small", 3)]
    assert rows(sample.stratified_split(df, "s", "id").groupBy("s", "split").count()) == [("big", "dev", 78), ("big", "test", 19), ("small", "dev", 2), ("small", "test", 1)]
    parts = dict(rows(sample.hash_split(spark.range(10000), F.col("id"), {"train": 8, "test": 1, "valid": 1}).groupBy("split").count()))
    assert set(parts) == {"train", "test", "valid"} and abs(parts["train"] - 8000) < 300


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [2.0, 0.0]), (3, "c", [0.0, 1.0]), (4, "d", [0.0, 0.0])], "id int, label string, embedding array<double>")
    e = vectors.Embeddings(df, label_col="label")
    assert e.get_vector("c") == [0.0, 1.0] and e.num_entities == 4 and e.dimension == 2
    assert [(r.id, round(r.similarity, 6)) for r in e.most_similar(1, 3).collect()] == [(2, 1.0), (3, 0.0), (4, 0.0)]
    with pytest.raises(KeyError):
        e.get_vector("zz")
    m = vectors.rank_metrics(spark.createDataFrame([(1,), (2,), (11,)], "rank int")).collect()[0]
    assert (m.mrr, m.hits_at_1, m.hits_at_3, m.hits_at_10, m.mean_rank) == (round((1 + 0.5 + 1 / 11) / 3, 6), 0.333333, 0.666667, 0.666667, 4.666667)
    h, t = [0.1, 0.2, 0.3, 0.4], [0.5, 0.1, 0.2, 0.3]
    one = spark.createDataFrame([(h, [0.5, 1.0], t, [0.1, 0.1, 0.1, 0.1])], "h array<double>, p array<double>, t array<double>, r array<double>")
    got = one.select(vectors.transe(F.col("h"), F.col("r"), F.col("t")), vectors.distmult(F.col("h"), F.col("r"), F.col("t")), vectors.rotate(F.col("h"), F.col("p"), F.col("t"))).collect()[0]
    z = [complex(h[0], h[2]) * complex(math.cos(0.5), math.sin(0.5)) - complex(t[0], t[2]), complex(h[1], h[3]) * complex(math.cos(1), math.sin(1)) - complex(t[1], t[3])]
    want = [-math.sqrt(sum((a + 0.1 - b) ** 2 for a, b in zip(h, t))), sum(a * 0.1 * b for a, b in zip(h, t)), -math.sqrt(sum(abs(x) ** 2 for x in z))]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_ingest_rules(spark):
    lines = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 7)], "annot_id string, pmid int, x int")
    src = spark.createDataFrame([("a", 2), ("b", 9)], "annot_id string, pmid int")
    assert rows(ingest.consistent_groups(lines, src), "annot_id", "pmid") == [("a", 1), ("a", 2)]
    foods = spark.createDataFrame([("oat", "lactose", "high", "-"), ("rye", "?", "high", "n"), ("rice", "-", "low", "-"), ("x", "lactose", "mid", "-")], "food_name string, fodmap_class string, content_level string, notes string")
    classes = spark.createDataFrame(list(ingest.CARBOHYDRATES), "fodmap_class string, object_id string, object_label string")
    got = ingest.carbohydrate_content(foods, classes)
    assert rows(got.where("skip is null"), "food_name", "object_id") == [("oat", "CHEBI:17716"), ("rice", "FODMAP:low_FODMAP")]
    assert rows(got.where("skip is not null"), "food_name", "skip") == [("rye", "unknown_class")]
    find = spark.createDataFrame([("s__A_b", "group_milk", "0.2", "0.01", "0.3", 1), ("s__A_b", "group_milk", "0.3", "0.001", "0.3", 2), ("s__A_b", "x", "1", "NS", "0.3", 3), ("s__unclassified", "milk", "1", "0.01", "0.3", 4)], "Taxa string, Food string, beta string, FDR string, Het_Pval string, ord int")
    food_map = spark.createDataFrame([("group_milk", "cow milk"), ("x", "-")], "food string, label string")
    assert rows(ingest.diet_findings(find, food_map), "subject_label", "predicate", "object_label", "confidence", "ord") == [("cow milk", "increases_abundance_of", "A b", 0.80, 1)]


def test_row_validation(spark):
    t = spark.createDataFrame([("Food", "Bioactive", 0.5), ("Food", "Planet", 0.5), ("Food", "Bioactive", 1.5), ("Food", "Bioactive", float("nan"))], "subject_type string, object_type string, confidence double").withColumn("predicate", F.lit("p"))
    good, bad = schema.split_valid(t)
    assert good.count() == 1 and rows(bad.groupBy("reason").count()) == [("confidence", 2), ("object_type", 1)]
    with pytest.raises(Exception, match="invalid triple"):
        schema.checked(t).collect()


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain whose ids are in order, the worst case of following the smallest neighbour."""
    written = []
    make = paths.Rounds.__call__
    monkeypatch.setattr(paths.Rounds, "__call__", lambda self, df, label: written.append(label) or make(self, df, label))
    n = 1000
    nodes = spark.range(n).select(F.format_string("n%05d", "id").alias("id"))
    edges = spark.range(n - 1).select(F.format_string("n%05d", "id").alias("subject_id"), F.format_string("n%05d", F.col("id") + 1).alias("object_id"))
    assert {r.component for r in paths.components(nodes, edges).collect()} == {"n00000"}
    assert written.count("cc-map") < 15


def test_search_holds_its_tiers_without_comparing_all(spark):
    entries = spark.createDataFrame([(i, f"x:{i}", l, e, o) for i, (l, e, o) in enumerate([("Ring", [], []), ("ring of red", [], []), ("red big ring", [], ["ab"]), ("String", ["Red Ring"], []), ("", [], []), (None, None, None)])], "ord int, id string, label string, exact array<string>, other array<string>")
    q = spark.createDataFrame([("ring",), ("red ring",), ("a",), ("",), ("in",), ("zz",), (None,)], "query string")
    found = resolve.search_ontology(q, entries)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.match_type))
    assert got == {
        "ring": [("x:0", "exact_label"), ("x:1", "label_starts_with"), ("x:2", "tokenized_label"), ("x:3", "substring_label")],
        "red ring": [("x:3", "exact_synonym"), ("x:1", "tokenized_label"), ("x:2", "tokenized_label")],
        "a": [("x:2", "substring_synonym")],
        "in": [("x:0", "substring_label"), ("x:1", "substring_label"), ("x:2", "substring_label"), ("x:3", "substring_label")],
    }
