"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from provloom.functions import scores, text


def run(spark, values, make, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").withColumn("_i", F.monotonically_increasing_id())
    return [r["r"] for r in df.select("_i", make(F.col("v")).alias("r")).orderBy("_i").collect()]


@pytest.mark.parametrize(
    "name, want",
    [
        (None, ""), ("", ""), ("-", ""), ("  The  Oat β-Glucan ", "oat beta-glucan"), ("a the an apple", "apple"), ("the", ""), ("UC", "ulcerative colitis"),
        ("Crohn's disease", "crohn s disease"), ("Crohns disease", "crohn s disease"), ("Eubacterium_coprostanoligenes", "eubacterium coprostanoligenes"), ("crème brûlée (x)", "crème brûlée x"), ("a b", "b"),
    ],
)
def test_normalize_name(spark, name, want):
    assert run(spark, [name], text.normalize_name) == [want]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("apple", "apples", True), ("bees", "bee", True), ("fiber", "dietary fiber", True), ("oat", "oat bran", False), ("red wine extract", "wine extract red", True),
        ("green tea", "black tea", False), ("", "x", False), ("x", "", False), ("", "", False), ("as", "a", False),
    ],
)
def test_names_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b), (b, a)], "a string, b string")
    assert [r[0] for r in df.select(text.names_match(F.col("a"), F.col("b"))).collect()] == [want, want]


def test_name_variants(spark):
    assert run(spark, ["apples", "bus", "gas", "tea", ""], text.name_variants) == [["apples", "apple"], ["bus", "buss"], ["gas", "gass"], ["tea", "teas"], []]


def test_rules(spark):
    labels = ["Lactobacillus GG", "LGG21 strain", "E. coli sp.", "β-glucan", "gallic acid", "2,3-diol", "fructose", "(R)-limonene", "plain rice", None]
    got = run(spark, labels, lambda c: F.concat(text.microbe_flags(c), text.compound_flags(c)))
    assert got[:9] == [["genus"], ["strain_code"], ["consortium/sp."], ["greek_letter"], ["compound_keyword"], ["iupac_pattern"], ["chemical_suffix"], ["iupac_pattern"], []]


def test_triage_first_bucket_wins(spark):
    rows = [("Lactobacillus rhamnosus", "Food"), ("Lactobacillus fermented milk", "Food"), ("Lactobacillus a b c d e", "Food"), ("Lactobacillus x", "Microbe"), ("high fat diet", "Food"), ("citric acid", "Food"), ("citric acid", "Bioactive"), ("bread", "Food")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, type string")
    got = df.select("i", text.triage_bucket(F.col("label"), F.col("type"), text.microbe_flags(F.col("label")), text.compound_flags(F.col("label"))).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == ["high_confidence_microbe", "medium_microbe", "medium_microbe", None, "dietary_pattern", "compound_candidate", None, None]


def test_taxon(spark):
    lineages = ["k__B.p__F.g__Lactobacillus.s__Lactobacillus_delbrueckii", "k__B.g__Blautia.s__Blautia_unclassified", "k__B.g__NA.f__Lach", "s__", None, "p__ .k__B"]
    got = run(spark, lineages, text.most_specific_taxon)
    assert [tuple(r) if r else None for r in got] == [("Lactobacillus delbrueckii", "species"), ("Blautia", "genus"), ("Lach", "family"), None, None, ("B", "kingdom")]


def test_foods_and_binomials(spark):
    assert run(spark, ["group_lf_milk", " red_wine ", "group_cheese"], text.food_name) == ["low-fat milk", "red wine", "cheese"]
    assert run(spark, ["Triticum aestivum", "Common bean", "wheat Bread", "Sus", None, "Allium cepa-x L.", "É bon"], text.is_binomial) == [True, False, False, False, False, True, True]


def test_confidences(spark):
    assert run(spark, [1e-11, 1e-10, 1e-5, 1e-3, 0.01, 0.05, None], scores.confidence_from_fdr, "double") == [0.95, 0.92, 0.88, 0.85, 0.80, 0.5, 0.5]
    df = spark.createDataFrame([("1.2", "16S"), (None, "qPCR"), ("", "16S qPCR"), ("2", "DGGE"), (None, None)], "r string, m string")
    assert [r[0] for r in df.select(scores.confidence_of_finding(F.col("r"), F.col("m"))).collect()] == [0.88, 0.8, 0.85, 0.83, 0.85]
    df = spark.createDataFrame([(0.0, 5.0), (None, 0.0), (-1.0, None), (None, None), (None, 2.0), (1.0, 0.0)], "s double, o double")
    got = df.select(scores.below_detection(F.col("s"), F.col("o")), scores.has_concentration(F.col("s"), F.col("o"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False), (False, False), (False, True), (False, True)]


def test_decide(spark):
    rows = [(None, True, None, True, True), ("1", True, None, None, True), ("1", True, "1", False, True), ("1", True, "1", False, False), ("1", True, "1", True, True), ("1", True, "2", True, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, ea boolean, b string, eb boolean, req boolean")
    got = df.select("i", scores.decide(F.col("a"), F.col("ea"), F.col("b"), F.col("eb"), F.col("req")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == ["MANUAL", "MANUAL", "MANUAL", "MERGE", "MERGE", "KEEP"]


def test_numbers(spark):
    assert run(spark, ["0.5", "NS", "", None, "1e-3"], scores.number) == [0.5, None, None, None, 0.001]
    assert run(spark, [0.000123456, 12345.678, None, 2.0], lambda c: scores.format_g3(c), "double") == ["0.000123", "1.23e+04", None, "2"]


def test_lists_and_ids(spark):
    assert run(spark, ["a|b||c", "", None], text.split_list) == [["a", "b", "c"], [], []]
    assert run(spark, [" x\r", None], text.clean) == ["x", ""]
    assert run(spark, ["a b/c"], lambda c: text.mint_cluster_id(c, "P:")) == ["P:a_b_c"]
    assert run(spark, ["x" * 100], text.mint_literature_id) == ["LLM:" + "x" * 80]
    assert run(spark, ["CONTAINS", "contains"], text.rehomed_predicate) == ["PRODUCES", "produces"]
