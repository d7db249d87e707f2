"""Exports, snapshots, caches and resumable appends."""

from __future__ import annotations

import json
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as an export has them: labels beside ids, lists joined by a bar, '' for null."""
    label = lambda r: nodes.select(F.col("id").alias(f"{r}_id"), F.col("label").alias(f"{r}_label"))
    j = edges.join(label("subject"), "subject_id", "left").join(label("object"), "object_id", "left")
    arrays = {f.name for f in edges.schema if f.dataType.typeName() == "array"}
    text = lambda c: F.coalesce(F.array_join(c, "|") if c in arrays else F.col(c).cast("string"), F.lit("")).alias(c)
    first = ["subject_id", "subject_label", "predicate", "object_id", "object_label"]
    return j.select(*[text(c) for c in first], *[text(c) for c in edges.columns if c not in first])


def write_tsv(df: DataFrame, path: str, header: bool = True, single: bool = False) -> bool:
    """Writes a folder of tab-separated files (one file if ``single``, for small exports); nothing for an empty table."""
    if df.isEmpty():
        return False
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").options(sep="\t", quote='"', escape='"', header=str(header).lower(), emptyValue="").csv(path)
    return True


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and label, edges by predicate and subject label; range-partitioned sorts, a file per range."""
    write_tsv(nodes.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in nodes.columns]).orderBy("type", "label", "id"), f"{path}/nodes")
    write_tsv(flat_edges(edges, nodes).orderBy("predicate", "subject_label", "subject_id", "object_id"), f"{path}/edges")


def training_triples(edges: DataFrame) -> DataFrame:
    """Distinct head, relation, tail."""
    return edges.select(F.col("subject_id").alias("head"), F.col("predicate").alias("relation"), F.col("object_id").alias("tail")).distinct()


def embedding_columns(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """entity_id, d0, d1, ... with six decimals."""
    return vectors.select(F.col(id_col).alias("entity_id"), *[F.round(F.get(vector_col, i).cast("double"), 6).alias(f"d{i}") for i in range(dims)])


def replace_graph(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """Replaces a stored graph and counts it back; edges lie by predicate, so a filter on it prunes files.

    The new graph is written and counted beside the old one and takes its place by renaming, so a
    failure before that leaves the old one, and a graph may be made from the one that it replaces.
    ValueError, and no change, if the counts read aren't those written.
    """
    spark = nodes.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    at = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    files = at[new].getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        wanted = nodes.count(), edges.count()
        nodes.write.parquet(f"{new}/nodes")
        edges.write.partitionBy("predicate").parquet(f"{new}/edges")
        found = spark.read.schema(nodes.schema).parquet(f"{new}/nodes").count(), spark.read.schema(edges.schema).parquet(f"{new}/edges").count()
        if found != wanted:
            raise ValueError(f"wrote {wanted} nodes and edges, found {found}")
        if files.exists(at[path]):
            files.rename(at[path], at[old])
        files.rename(at[new], at[path])
        files.delete(at[old], True)
    finally:
        files.delete(at[new], True)
    return found


def append_missing(new: DataFrame, path: str, key: str) -> int:
    """Appends to a JSON-lines store the rows whose key it doesn't have yet; returns how many."""
    spark = new.sparkSession
    try:
        done = spark.read.schema(new.select(key).schema).json(path)
        new = new.join(done.distinct(), key, "left_anti")
    except Exception as e:  # the store isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.cache()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def statistics(stats: DataFrame) -> dict:
    """The rows of a graph's ``stats`` as one nested dictionary."""
    out: dict = {"nodes_by_type": {}, "edges_by_predicate": {}, "edges_by_source": {}}
    for r in stats.collect():  # a row per type, predicate and source
        if r["kind"] in ("nodes", "edges"):
            out[f"total_{r['kind']}"] = r["n"]
        else:
            out[{"type": "nodes_by_type", "predicate": "edges_by_predicate", "source": "edges_by_source"}[r["kind"]]][r["key"]] = r["n"]
    return out


def write_release(stats: DataFrame, folder: str, version: str, licence: str = "CC BY 4.0") -> str:
    """statistics.json, a descriptor, the licence's name, and all files of the folder in an archive."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    found = statistics(stats)
    (at / "statistics.json").write_text(json.dumps(found, indent=2, sort_keys=True))
    lines = "\n".join(f"- {k}: {v:,}" for k, v in sorted(found["nodes_by_type"].items()))
    (at / "DESCRIPTOR.md").write_text(f"# Data descriptor\n\nVersion: {version}\n\n{found.get('total_nodes', 0):,} nodes, {found.get('total_edges', 0):,} edges\n\n{lines}\n")
    (at / "LICENSE.txt").write_text(licence + "\n")
    archive = f"{folder.rstrip('/')}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(at.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(at))
    return archive
