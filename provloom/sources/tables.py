"""Delimited files, JSON and taxonomy dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from ..operators.relational import last_wins
from ..schema import OPTIONAL


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: bool = True, lines: bool = True) -> DataFrame:
    """Tab-separated with doubled quotes; columns by name, so files may order them differently.

    ``lines``: fields may hold line breaks, which keeps a file in one task; turn it off for large
    files without them.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": str(lines).lower(), "encoding": "UTF-8"}
    if not header:
        return spark.read.options(**options).schema(wanted).csv(path)
    raw = spark.read.options(**options).option("header", "true").csv(path)
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def with_order(df: DataFrame) -> DataFrame:
    """``ord``: place in the input, by file and line, for first-wins rules."""
    return df.withColumn("_file", F.input_file_name()).withColumn("ord", F.struct(F.col("_file"), F.monotonically_increasing_id().alias("line"))).drop("_file")


def read_triples(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Triple files with their file name; empty optional columns are null."""
    df = read_tsv(spark, paths, schema)
    for c in OPTIONAL:
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    return df.withColumn("_source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node files, cleaned of carriage returns and outer white space; ``origin`` may be missing.

    ValueError if id, label or type is.
    """
    raw = spark.read.options(sep="\t", quote='"', escape='"', header="true").csv(path)
    raw = raw.toDF(*[c.replace("\r", "").strip() for c in raw.columns])
    lost = [c for c in ("id", "label", "type") if c not in raw.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return raw.select(*[clean(F.col(c)).alias(c) for c in raw.columns], *([] if "origin" in raw.columns else [F.lit("").alias("origin")]))


#: Names that the columns of an edge file go by.
EDGE_COLUMNS = {
    "subject": ("subject_id", "subject", "source_id", "head", "start_id"),
    "predicate": ("predicate", "relation", "rel_type", "type", "edge_type"),
    "object": ("object_id", "object", "target_id", "tail", "end_id"),
}


def edge_columns(header: list[str]) -> dict[str, str] | None:
    """Which columns hold subject, predicate and object: an equal name first, else one that holds the name; None if one isn't found."""
    low = {h.replace("\r", "").strip().lower(): h for h in header}
    found = {}
    for role, names in EDGE_COLUMNS.items():
        exact = next((low[n] for n in names if n in low), None)
        found[role] = exact or next((h for h in header if role in h.lower()), None)
    return found if all(found.values()) else None


def read_csv_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Some columns of a large CSV file with types; malformed lines are dropped.  Splits replace chunks."""
    raw = spark.read.options(header="true", quote='"', escape='"', mode="DROPMALFORMED").csv(path)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document that is a list of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


ABSTRACT = "pmid string, title string, abstract string, journal string, year string, doi string, publication_types array<string>, mesh_terms array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = ABSTRACT, strict: bool = False) -> DataFrame:
    """An object a line; lines that don't parse are skipped, or fail the job if ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def last_records(records: DataFrame, key: str = "pmid") -> DataFrame:
    """One record per key of JSON lines; of several the last of the file counts."""
    return last_wins(with_order(records).where(F.col(key).isNotNull()), [key], ["ord"]).drop("ord")


def read_dmp(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A taxonomy dump: fields between tab-bar-tab, lines end in tab-bar; short lines are skipped."""
    parts = F.split(F.regexp_replace("value", r"\t?\|\s*$", ""), r"\t\|\t")
    df = spark.read.text(path).select(parts.alias("_p"), F.monotonically_increasing_id().alias("ord")).where(F.size("_p") >= len(columns))
    return df.select(*[F.trim(F.get("_p", i)).alias(c) for i, c in enumerate(columns)], "ord")


def read_taxon_names(spark: SparkSession, path: str) -> DataFrame:
    return read_dmp(spark, path, ["tax_id", "name", "unique_name", "name_class"]).withColumn("tax_id", F.col("tax_id").try_cast("long"))


def read_taxon_nodes(spark: SparkSession, path: str) -> DataFrame:
    df = read_dmp(spark, path, ["tax_id", "parent_id", "rank"])
    return df.withColumn("tax_id", F.col("tax_id").try_cast("long")).withColumn("parent_id", F.col("parent_id").try_cast("long"))


def read_sheet(spark: SparkSession, path: str, sheet: str | int, skip: int, columns: list[str]) -> DataFrame:
    """A sheet of a workbook as strings (a small file, read where the driver runs).

    Needs a workbook reader, which isn't a dependency: RuntimeError without one.
    """
    import pandas as pd

    try:
        df = pd.read_excel(path, sheet_name=sheet, skiprows=skip, dtype=str)
    except ImportError as e:
        raise RuntimeError("no workbook reader is installed; export the sheet as TSV and use read_tsv") from e
    df = df[[c for c in columns if c in df.columns]]
    return spark.createDataFrame(df.where(df.notna(), None), T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
