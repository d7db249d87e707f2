"""Remote sources as batch data sources with a client that the caller brings, and parsers of what they return.

Without a network the clients read cached files; nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def retried(call: Callable[[], object], attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` returns, tried again with doubled pauses; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)


def fetch(ids: DataFrame, key: str, client: Callable[[list[str]], list[str | None]], batch: int = 200, partitions: int = 8) -> DataFrame:
    """(key, response): distinct ids asked for in batches, by a client that is sent to the tasks."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("response", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            wanted = part.column(0).to_pylist()
            for at in range(0, len(wanted), batch):
                some = wanted[at : at + batch]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(retried(lambda: client(some)), pa.string())], names=[key, "response"])

    return ids.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().repartition(partitions, key).mapInArrow(run, schema)


class Paced:
    """A client that is asked no more often than so many times a second, by one task; see ``fetch(partitions=1)``."""

    def __init__(self, client: Callable, per_second: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.client, self.pause, self.clock, self.sleep, self.last = client, 1.0 / per_second, clock, sleep, None

    def __call__(self, *args):
        now = self.clock()
        if self.last is not None and now < self.last + self.pause:
            self.sleep(self.last + self.pause - now)
            now = self.last + self.pause
        self.last = now
        return self.client(*args)


def read_service(spark: SparkSession, requests: list[str], client: Callable[[str], str], left: str, right: str, per_second: float = 1.0) -> DataFrame:
    """(request, left, right) from a service that answers a request (``/list/x``, ``/link/x/y``) with two columns.

    A stated, short list of requests, asked by one task at a bounded pace, each tried three times.
    """
    paced = Paced(client, per_second)
    asked = spark.createDataFrame([(r,) for r in requests], "request string")
    answers = fetch(asked, "request", lambda some: [retried(lambda r=r: paced(r)) for r in some], partitions=1)
    lines = F.explode(F.transform(F.split("response", r"\r?\n"), lambda x: F.split(x, "\t")))
    bare = lambda i: F.regexp_replace(F.get("_l", i), "^[a-z]+:", "")
    return answers.select("request", lines.alias("_l")).where(F.size("_l") >= 2).select("request", bare(0).alias(left), bare(1).alias(right))


def search_pages(spark: SparkSession, searches: list[tuple[str, int]], client: Callable[[str, int, int], list[str]], page: int = 5000, partitions: int = 8) -> DataFrame:
    """(query, id): distinct results of searches (query, number of results), asked page by page in the tasks.

    ``client(query, offset, page)`` returns the ids of one page; each page is tried three times.
    """
    pages = [(q, at) for q, n in searches for at in range(0, n, page)]
    asked = spark.createDataFrame(pages, "query string, at long").repartition(max(1, min(partitions, len(pages))), "query", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for q, at in zip(*(c.to_pylist() for c in part.columns)):
                found = retried(lambda: client(q, at, page))
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.string()), pa.array(found, pa.string())], names=["query", "id"])

    return asked.mapInArrow(run, "query string, id string").distinct()


def look_up(names: DataFrame, key: str, exact: Callable[[str], tuple[str, str] | None], fuzzy: Callable[[str], tuple[str, str] | None], partitions: int = 8) -> DataFrame:
    """(name, id, label, match_type) from a resolution service: its exact search first, then its fuzzy one, else no_match.

    Each distinct name is asked once, ignoring case and outer white space; null and blank names aren't.
    """
    schema = "_name string, id string, label string, match_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for name in part.column(0).to_pylist():
                for kind, ask in (("exact", exact), ("fuzzy", fuzzy)):
                    if found := retried(lambda: ask(name)):
                        rows.append((name, *found, kind))
                        break
                else:
                    rows.append((name, None, None, "no_match"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["_name", "id", "label", "match_type"])

    asked = names.select(F.lower(F.trim(key)).alias("_name")).where("_name <> ''").distinct().repartition(partitions, "_name")
    found = asked.mapInArrow(run, schema)
    return names.select(F.col(key).alias("name")).distinct().withColumn("_name", F.lower(F.trim("name"))).join(found, "_name").drop("_name")


def read_two_column_tsv(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Cached answers of a list or link service: two columns without a header, prefixes like ``cpd:`` cut off."""
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:", "")
    return spark.read.csv(path, sep="\t", schema="a string, b string").select(bare("a").alias(left), bare("b").alias(right))


def parse_articles(df: DataFrame, xml: str = "response", least: int = 100) -> DataFrame:
    """Abstract records from article XML, one article a row; abstracts under ``least`` characters are dropped.

    Labelled sections are joined as ``LABEL: text``; the year is the year, or the first four
    characters of a free date; the first DOI counts.
    """
    at = lambda path: F.trim(F.coalesce(F.xpath_string(xml, F.lit(path)), F.lit("")))
    each = lambda path: F.xpath(xml, F.lit(path))
    sections = F.regexp_extract_all(xml, F.lit(r"(?s)<AbstractText([^>]*)>(.*?)</AbstractText>"), F.lit(0))

    def section(s: Column) -> Column:
        label = F.regexp_extract(s, r'Label="([^"]*)"', 1)
        text = F.trim(F.regexp_replace(F.regexp_replace(s, "(?s)<[^>]*>", ""), r"\s+", " "))
        return F.when(label != "", F.concat(label, F.lit(": "), text)).otherwise(text)

    year = at("//PubDate/Year")
    out = df.select(
        at("//MedlineCitation/PMID").alias("pmid"),
        at("//ArticleTitle").alias("title"),
        F.array_join(F.transform(sections, section), " ").alias("abstract"),
        at("//Journal/Title").alias("journal"),
        F.when(year != "", year).otherwise(F.left(at("//PubDate/MedlineDate"), F.lit(4))).alias("year"),
        F.coalesce(F.get(each("//ELocationID[@EIdType='doi']/text()"), 0), F.lit("")).alias("doi"),
        each("//PublicationTypeList/PublicationType/text()").alias("publication_types"),
        each("//MeshHeading/DescriptorName/text()").alias("mesh_terms"),
    )
    return out.where(F.length("abstract") >= least)


#: Fields of a triple in an extraction's answer.
ANSWER = "struct<triples:array<struct<subject_name:string,subject_type:string,predicate:string,object_name:string,object_type:string,evidence_span:string,evidence_type:string,confidence:double,notes:string>>>"
_FIELDS = ("subject_name", "subject_type", "predicate", "object_name", "object_type", "evidence_span", "evidence_type", "confidence", "notes")


def parse_extractions(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of (pmid, status, answer as JSON): one for each triple that its predicate's types allow, T1, T2, ...;
    T0/NONE for an answer without any; ERROR for a request that didn't succeed."""
    from ..operators.qa import conforms_to_pair

    parsed = results.withColumn("_a", F.from_json("answer", ANSWER))
    good = parsed.where("status = 'succeeded'")
    triples = good.select("pmid", F.posexplode(F.coalesce("_a.triples", F.array().cast("array<struct<subject_name:string,subject_type:string,predicate:string,object_name:string,object_type:string,evidence_span:string,evidence_type:string,confidence:double,notes:string>>"))).alias("_n", "_t"))
    triples = conforms_to_pair(triples.select("pmid", "_n", *[F.col(f"_t.{c}").alias(c) for c in _FIELDS]), pairs).where("valid")
    from pyspark.sql import Window

    numbered = triples.withColumn("triple_id", F.concat(F.lit("T"), F.row_number().over(Window.partitionBy("pmid").orderBy("_n")).cast("string")))
    none = good.select("pmid").join(numbered.select("pmid").distinct(), "pmid", "left_anti")
    dash = lambda df, tid, p, span, notes: df.select("pmid", F.lit(tid).alias("triple_id"), *[F.lit(p if c == "predicate" else "-").alias(c) for c in _FIELDS[:5]], span.alias("evidence_span"), F.lit("-").alias("evidence_type"), F.lit(0.0).alias("confidence"), notes.alias("notes"))
    empty = dash(none, "T0", "NONE", F.lit("-"), F.lit("Empty extraction or all schema-violating"))
    bad = parsed.where("status <> 'succeeded'")
    errors = dash(bad, "ERROR", "ERROR", F.concat(F.lit("Batch error: "), F.col("status")), F.concat(F.lit("Error type: "), F.col("status")))
    return numbered.select("pmid", "triple_id", *_FIELDS).unionByName(empty).unionByName(errors)


def few_shot_text(source: DataFrame, rows: DataFrame) -> DataFrame:
    """(annot_id, example): a worked example for a prompt, from an abstract and its gold triples in order."""
    triple = F.struct("subject_name", "subject_type", "predicate", "object_name", "object_type", "evidence_span", "evidence_type", F.coalesce(F.col("your_confidence").try_cast("double"), F.lit(0.70)).alias("confidence"), F.coalesce("notes", F.lit("")).alias("notes"))
    real = rows.where("predicate <> 'NONE'").groupBy("annot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", triple.alias("t")))), lambda x: x["t"]).alias("triples"))
    j = source.join(real, "annot_id", "left")
    answer = F.when(F.col("triples").isNull(), F.lit('submit_triples({"triples": []})\n(Off-scope or no extractable claims.)')).otherwise(F.concat(F.lit("submit_triples(\n"), F.to_json(F.struct("triples"), {"pretty": "true"}), F.lit("\n)")))
    text = F.concat_ws("\n", F.lit("<example>"), F.lit("<input>"), F.concat(F.lit("PMID: "), "pmid"), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Abstract: "), F.left("abstract", F.lit(1500))), F.lit("</input>"), F.lit("<output>"), answer, F.lit("</output>"), F.lit("</example>"))
    return j.select("annot_id", text.alias("example"))
