"""Ontologies as (id, label, exact, other, ord), from OBO and OWL files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "id string, label string, exact array<string>, other array<string>, ord bigint"


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an OBO file: stanzas are records of a text source, so a large file is read in parallel."""
    stanzas = spark.read.text(path, lineSep="\n[").select("value", F.monotonically_increasing_id().alias("ord")).where("value like 'Term]%' or value like '[Term]%'")  # a file without a header begins with a stanza
    line = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: (.*?)\s*$", 1)
    quoted = r'(?m)^synonym: "((?:[^"\\]|\\.)*)" '
    exact = F.regexp_extract_all("value", F.lit(quoted + "EXACT"), F.lit(1))
    other = F.regexp_extract_all("value", F.lit(quoted + "(?!EXACT)"), F.lit(1))
    return stanzas.select(line("id").alias("id"), F.nullif(line("name"), F.lit("")).alias("label"), exact.alias("exact"), other.alias("other"), "ord")


_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_LABEL = "{http://www.w3.org/2000/01/rdf-schema#}label"
_CLASS = "{http://www.w3.org/2002/07/owl#}Class"
_SYNONYMS = tuple("{http://www.geneontology.org/formats/oboInOwl#}" + n for n in ("hasExactSynonym", "hasRelatedSynonym", "hasNarrowSynonym"))


def owl_classes(path: str) -> Iterator[tuple]:
    """Named classes of an RDF/XML file, by a pull parser that holds one child of the root at a time; all synonyms count as exact."""
    n, depth, root = 0, 0, None
    for event, node in ET.iterparse(path, events=("start", "end")):
        if event == "start":
            root = node if root is None else root
            depth += 1
            continue
        depth -= 1
        if depth == 1:
            root.remove(node)  # the root would keep every child, even an empty one
        if node.tag != _CLASS:
            continue
        about = node.get(f"{_RDF}about")
        if about:
            tail = about.rsplit("/", 1)[-1]
            labels = [x.text for x in node.findall(_LABEL) if x.text]
            exact = [x.text for tag in _SYNONYMS for x in node.findall(tag) if x.text]
            yield tail.replace("_", ":"), labels[0] if labels else None, exact, [], n
            n += 1
        node.clear()


class OwlDataSource(DataSource):
    """``spark.read.format("owl").load(path)``; the file is read by one task."""

    @classmethod
    def name(cls) -> str:
        return "owl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _OwlReader(self.options["path"])


class _OwlReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        yield from owl_classes(self.path)


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OwlDataSource)
    return spark.read.format("owl").option("path", path).load()


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending."""
    if path.endswith(".obo"):
        return read_obo(spark, path)
    if path.endswith((".owl", ".rdf", ".xml")):
        return read_owl(spark, path)
    raise ValueError(f"not an ontology file: {path}")
