"""Command line: a dry run computes the whole plan and its counts and writes nothing."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.text import split_list
from .operators import assemble, evaluate, ingest, qa, repair, resolve
from .operators.graph import PropertyGraph
from .operators.relational import first_wins
from .sources import extraction, sinks, tables

_EDGE = "subject_id string, predicate string, object_id string, confidence double, evidence_count bigint, sources string"
_GOLD = "annot_id string, pmid string, triple_id string, subject_name string, subject_type string, predicate string, object_name string, object_type string, evidence_span string, evidence_type string, notes string"


def _graph(spark: SparkSession, nodes: str, edges: str) -> PropertyGraph:
    e = tables.read_tsv(spark, edges, _EDGE, lines=False).withColumn("sources", split_list(F.col("sources")))
    return PropertyGraph(tables.read_nodes(spark, nodes), e)


def _show(df: DataFrame) -> None:
    for r in df.limit(50).collect():  # small tables of counts
        print("\t".join(f"{k}={v}" for k, v in r.asDict().items()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="provloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("report", "fix-schema", "correct", "load", "export"):
        p = sub.add_parser(name)
        p.add_argument("--nodes", required=True)
        p.add_argument("--edges", required=True)
        p.add_argument("--out")
        if name in ("fix-schema", "load"):
            way = p.add_mutually_exclusive_group()
            way.add_argument("--dry-run", action="store_true", default=True)
            way.add_argument("--apply", "--yes", dest="dry_run", action="store_false")
        if name == "correct":
            p.add_argument("--decisions")
    p = sub.add_parser("load-literature")
    for name in ("--nodes", "--edges", "--rows"):
        p.add_argument(name, required=True)
    p.add_argument("--out")
    way = p.add_mutually_exclusive_group()
    way.add_argument("--dry-run", action="store_true", default=True)
    way.add_argument("--load", dest="dry_run", action="store_false")
    p = sub.add_parser("batch")
    p.add_argument("step", choices=("submit", "status", "process", "retry", "rows"))
    p.add_argument("--client", required=True, help="module:name of what makes the service's client")
    p.add_argument("--folder", required=True)
    p.add_argument("--requests", help="JSON lines of pmid, prompt and input_tokens")
    p.add_argument("--cost-cap", type=float)
    p.add_argument("--out")
    p = sub.add_parser("evaluate")
    p.add_argument("--gold", required=True)
    p.add_argument("--found", required=True)
    return top


def _load_literature(spark: SparkSession, g: PropertyGraph, args: argparse.Namespace) -> None:
    """Extracted rows resolved against the graph; reports what they add, and adds it only with --load."""
    raw = tables.with_order(tables.read_tsv(spark, args.rows, _GOLD + ", confidence double").where("predicate not in ('NONE', 'ERROR')"))
    names = lambda r: raw.select(F.col(f"{r}_name").alias("name"), F.col(f"{r}_type").alias("type"))
    found = resolve.resolve_entities(names("subject").unionAll(names("object")), g.nodes.withColumn("ord", F.col("id")))
    side = lambda r: found.select(F.col("name").alias(f"{r}_name"), F.col("claimed_type").alias(f"{r}_type"), F.col("id").alias(f"{r}_id"), F.col("type").alias(f"_{r}_type"))
    rows = raw.join(side("subject"), ["subject_name", "subject_type"]).join(side("object"), ["object_name", "object_type"])
    rows = qa.conforms_to_pair(rows.withColumns({"subject_type": F.col("_subject_type"), "object_type": F.col("_object_type")}).drop("_subject_type", "_object_type"), schema.pair_schema(spark))
    print("## rows")
    _show(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("dropped")))
    new = found.where("is_new").select("id", "label", "type").distinct()
    good = rows.where("valid").select("subject_id", F.col("predicate"), "object_id", "confidence", F.lit("LLM").alias("source"), "evidence_type", F.col("pmid").alias("publication_id"), "evidence_span", "subject_type", "object_type", "ord")
    new = assemble.referenced(new, good)
    print("## new nodes by type")
    _show(ingest.new_nodes_by_type(new.withColumn("is_new", F.lit(True))).orderBy("type"))
    print("## edges by relation")
    _show(good.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).orderBy("predicate"))
    if not args.dry_run:
        added = assemble.aggregate_evidence(good).select("subject_id", "predicate", "object_id", "confidence", F.col("evidence_count").cast("long").alias("evidence_count"), "sources")
        edges, _ = assemble.upsert_edges(g.edges, added, g.nodes.select("id").unionAll(new.select("id")))
        nodes, _ = assemble.load_literature(g.nodes, good, first_wins(new, ["id"], ["label", "type"]), good.limit(0))
        print("nodes, edges:", *sinks.replace_graph(nodes, edges, args.out))


def _batch(spark: SparkSession, args: argparse.Namespace) -> None:
    module, _, name = args.client.partition(":")
    job = extraction.Extraction(spark, args.folder, getattr(importlib.import_module(module), name)())
    if args.step in ("submit", "retry"):
        requests = spark.read.schema(extraction.REQUEST).json(args.requests)
        print("submitted:", job.submit(requests, args.cost_cap) if args.step == "submit" else job.retry(requests))
    elif args.step == "status":
        _show(job.status())
    elif args.step == "process":
        print("results:", job.process())
    else:
        sinks.write_tsv(job.rows(schema.pair_schema(spark)).orderBy("pmid", "triple_id"), args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("provloom").getOrCreate()
    if args.command == "evaluate":
        read = lambda p: tables.read_tsv(spark, p, _GOLD).withColumn("ord", F.monotonically_increasing_id())
        for name, df in evaluate.evaluate(read(args.gold), read(args.found)).items():
            print(f"## {name}")
            _show(df)
        return
    if args.command == "batch":
        _batch(spark, args)
        return
    g = _graph(spark, args.nodes, args.edges)
    if args.command == "load-literature":
        _load_literature(spark, g, args)
        return
    rules = schema.predicate_schema(spark)
    if args.command == "report":
        text = qa.report(g, g.edges, rules)
        print(text)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
    elif args.command == "fix-schema":
        nodes, judged = repair.retype_then_drop(g.nodes, g.edges, rules)
        _show(judged.groupBy("action").agg(F.count(F.lit(1)).alias("n")))
        if not args.dry_run:
            sinks.replace_graph(nodes, judged.where("action = 'keep'").select(g.edges.columns), args.out)
    elif args.command == "correct":
        if args.decisions:
            nodes, judged = repair.apply_decisions(g.nodes, tables.read_tsv(spark, args.decisions, "id string, decision string"), schema.ENTITY_TYPES)
            _show(judged.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
        else:
            nodes = repair.first_phase(g.nodes)
            review = repair.triage(g.nodes, g.degrees())
            _show(review.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
            if args.out:
                sinks.write_tsv(repair.review_order(review).select("id", "label", F.col("type").alias("current_type"), "bucket", F.coalesce(F.col("degree").cast("string"), F.lit("n/a")).alias("degree"), "suggested_decision", F.lit("").alias("decision")), f"{args.out}/review")
        if args.out:
            sinks.write_tsv(nodes, f"{args.out}/nodes")
    elif args.command == "load":
        found = qa.load_gate(g.nodes, g.edges, list(schema.ENTITY_TYPES), [p for p, _, _ in schema.PREDICATES])
        _show(found)
        if not args.dry_run:
            qa.check_gate(found)
            print("nodes, edges:", *sinks.replace_graph(g.nodes, g.edges, args.out))
    else:
        sinks.write_snapshot(g.nodes, g.edges, args.out)
        sinks.write_tsv(sinks.training_triples(g.edges).orderBy("head", "relation", "tail"), f"{args.out}/triples", header=False)


if __name__ == "__main__":
    main()
