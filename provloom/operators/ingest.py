"""Rules that turn source rows into assertions; rows that a rule turns away keep their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import food_name, is_binomial, mint_cluster_id, most_specific_taxon
from .relational import first_wins

# Classes of a carbohydrate list and what they stand for; the object of low content.
CARBOHYDRATES = (
    ("lactose", "CHEBI:17716", "lactose"),
    ("fructose", "CHEBI:28645", "D-fructose"),
    ("sorbitol", "CHEBI:30911", "sorbitol"),
    ("mannitol", "CHEBI:16899", "D-mannitol"),
    ("fructans", "CHEBI:24482", "fructan"),
    ("galacto-oligosaccharide", "CHEBI:24151", "oligosaccharide"),
)
LOW_CONTENT = ("FODMAP:low_FODMAP", "low FODMAP food")
# Diseases of a microbe-disease list, and outcomes as predicates.
DISEASES = (
    ("Crohn's Disease", "DOID:8778", "Crohn's disease"),
    ("Ulcerative Colitis", "DOID:8577", "ulcerative colitis"),
    ("Inflammatory Bowel Disease", "DOID:0050589", "inflammatory bowel disease"),
    ("Inactive Crohn's Disease", "DOID:8778", "Crohn's disease (inactive)"),
)
OUTCOMES = (("Reduced", "decreased_in"), ("Elevated", "increased_in"))


def significant(df: DataFrame, fdr: str = "FDR", heterogeneity: str = "Het_Pval", alpha: float = 0.05) -> DataFrame:
    """Rows with a false discovery rate below and a heterogeneity p-value above ``alpha``, both numbers."""
    return df.where((scores.number(F.col(fdr)) < alpha) & (scores.number(F.col(heterogeneity)) > alpha))


def routed(df: DataFrame, **reasons: Column) -> DataFrame:
    """A column ``skip``: the first reason that holds, or null.  Counters are a groupBy on it."""
    out = None
    for name, test in reasons.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn("skip", out)


def skip_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("skip", F.lit("used")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


def whitelisted(df: DataFrame, diseases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Findings (disease_name, qualitative_outcome) on target diseases, mapped; others are left out, unknown
    outcomes are kept with skip = unknown_outcome."""
    j = df.join(diseases, "disease_name").join(outcomes, "qualitative_outcome", "left")
    return routed(j, unknown_outcome=F.col("predicate").isNull())


def food_content(df: DataFrame, foods: DataFrame, compounds: DataFrame) -> DataFrame:
    """Food-compound contents as assertions, or with a reason to skip.

    ``df``: source_id, source_type, food_id, standard_content, orig_content, citation, citation_type;
    ``foods``: food_id, subject_id, subject_label; ``compounds``: source_id, object_id, object_label,
    allowed.  Other source types are filtered, unmapped compounds are left out, unmapped foods and
    measured zeros are skipped; negative values count as presence only.
    """
    j = df.where("source_type = 'Compound'").join(compounds, "source_id").join(foods, "food_id", "left")
    standard, original = scores.number(F.col("standard_content")), scores.number(F.col("orig_content"))
    j = routed(j, no_food=F.col("subject_id").isNull(), no_content=scores.below_detection(standard, original))
    measured = scores.has_concentration(standard, original)
    return j.withColumn("confidence", scores.confidence_of_content(F.col("allowed"), measured)).withColumn("notes", scores.citation(F.col("citation_type"), F.col("citation"), ~measured))


def allow_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key, read as an integer, is in a list (id)."""
    return df.withColumn("_id", F.col(key).try_cast("long")).join(ids.select(F.col("id").cast("long").alias("_id")).distinct(), "_id", "left_semi").drop("_id")


def without_binomials(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label doesn't read like a species name."""
    return df.where(~is_binomial(F.col(label)))


def carbohydrate_content(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Foods (food_name, fodmap_class, content_level, notes) by level: low to one fixed object, high by class.

    Unknown classes are skipped with a reason, other levels left out; a note '-' is null.
    """
    rows = df.where("content_level in ('low', 'high')").join(classes, "fodmap_class", "left")
    low = F.col("content_level") == "low"
    rows = routed(rows, unknown_class=~low & F.col("object_id").isNull())
    return (
        rows.withColumn("predicate", F.when(low, "is_low_fodmap_food").otherwise("has_high_fodmap_content_of"))
        .withColumn("object_id", F.when(low, LOW_CONTENT[0]).otherwise(F.col("object_id")))
        .withColumn("object_label", F.when(low, LOW_CONTENT[1]).otherwise(F.col("object_label")))
        .withColumn("notes", F.when(F.col("notes") != "-", F.col("notes")))
    )


def diet_findings(df: DataFrame, food_map: DataFrame) -> DataFrame:
    """Cohort findings (Taxa, Food, beta, FDR, Het_Pval, ord) as assertions of foods on microbes; the first of each wins.

    ``food_map``: food, label; a label '-' or '' doesn't count.
    """
    m = food_map.where("label is not null and trim(label) not in ('', '-')").select(F.lower(F.trim("food")).alias("_k"), F.trim("label").alias("_label"))
    j = significant(df).withColumn("_t", most_specific_taxon(F.col("Taxa"))).where("_t is not null").withColumn("_k", F.lower(F.trim("Food"))).join(m, "_k", "left")
    beta = scores.number(F.col("beta"))
    rows = j.select(
        F.coalesce("_label", food_name(F.col("Food"))).alias("subject_label"),
        F.concat(scores.direction(beta), F.lit("_abundance_of")).alias("predicate"),
        F.col("_t.name").alias("object_label"),
        F.col("_t.rank").alias("object_rank"),
        scores.confidence_from_fdr(scores.number(F.col("FDR"))).alias("confidence"),
        "ord",
    )
    return first_wins(rows, ["subject_label", "predicate", "object_label"], ["ord"])


def cluster_nodes(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.select(mint_cluster_id(F.col(column), prefix).alias("id"), F.left(column, F.lit(80)).alias("label")).distinct()


def pathway_compounds(links: DataFrame, to_chebi: DataFrame, names: DataFrame) -> DataFrame:
    """(pathway_id, compound_id, ord, priority) with object id and name; the cause of a skip is a missing id, then a missing name."""
    j = links.join(to_chebi, "compound_id", "left").join(names, "compound_id", "left")
    j = routed(j, no_id=F.col("chebi_id").isNull(), no_name=F.col("name").isNull())
    return j.withColumn("confidence", scores.confidence_of_pathway(F.col("priority")))


def smallest_ids(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest integer of each key; values that aren't integers don't count."""
    return pairs.groupBy(key).agg(F.min(F.col(value).try_cast("long")).alias(value)).where(F.col(value).isNotNull())


def collected_synonyms(synonyms: DataFrame, source: str = "CHEBI") -> DataFrame:
    """Synonyms of each compound from one source, ignoring its case, in file order."""
    kept = synonyms.where(F.upper("synonym_source") == source)
    return kept.groupBy("compound_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "synonym"))), lambda s: s["synonym"]).alias("synonyms"))


def consistent_groups(rows: DataFrame, source: DataFrame, group: str = "annot_id", key: str = "pmid") -> DataFrame:
    """All rows of the groups of which any row has the key of its source row."""
    s = source.select(group, F.col(key).alias("_key"))
    good = rows.join(s, group).where(F.col(key) == F.col("_key")).select(group).distinct()
    return rows.join(good, group, "left_semi")


def source_status(rows: DataFrame, source: DataFrame, group: str = "annot_id", key: str = "pmid") -> DataFrame:
    """Each group with status unchanged, rebuilt (its source row has another key) or missing."""
    j = rows.select(group, key).distinct().join(source.select(group, F.col(key).alias("_key")), group, "left")
    return j.withColumn("status", F.when(F.col("_key").isNull(), "missing").when(F.col("_key") == F.col(key), "unchanged").otherwise("rebuilt")).drop("_key")


def triple_numbers(rows: DataFrame, groups: DataFrame, group: str, order: str) -> DataFrame:
    """T1, T2, ... within each group; T0 for a group without rows."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    numbered = rows.withColumn("triple_id", F.concat(F.lit("T"), n.cast("string")))
    return groups.select(group).distinct().join(numbered, group, "left").withColumn("triple_id", F.coalesce("triple_id", F.lit("T0")))


def annotation_ids(df: DataFrame, order: list) -> DataFrame:
    """A001, A002, ... in order."""
    from .relational import numbered

    return numbered(df, "_n", order).withColumn("annot_id", F.format_string("A%03d", F.col("_n").cast("int"))).drop("_n")


def truncated(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to so many characters, arrays to so many elements."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    return df.select(*[(F.slice(c, 1, limits[c]) if c in arrays else F.left(c, F.lit(limits[c]))).alias(c) if c in limits else F.col(c) for c in df.columns])


def resolution_report(rows: DataFrame) -> DataFrame:
    """lookups, matched, new, dropped and surviving rows of (is_new, valid)."""
    return rows.agg(F.count(F.lit(1)).alias("lookups"), F.count_if(~F.col("is_new")).alias("matched"), F.count_if(F.col("is_new")).alias("new"), F.count_if(~F.col("valid")).alias("dropped"), F.count_if(F.col("valid")).alias("surviving"))


def new_nodes_by_type(rows: DataFrame) -> DataFrame:
    """(type, n): new entities (id, type, is_new) by type, each id once."""
    return rows.where("is_new").groupBy("type").agg(F.count_distinct("id").alias("n"))


def in_classes(rows: DataFrame, superclass: str, classes: tuple[str, ...], key: str, ids: DataFrame) -> DataFrame:
    """Distinct rows whose superclass is a listed one, or whose key is in a list of ids (id), whatever its class."""
    allowed = ids.select(F.col("id").alias("_id")).distinct().withColumn("_allowed", F.lit(True))
    j = rows.join(allowed, F.col(key) == F.col("_id"), "left")
    return j.where(F.col(superclass).isin(*classes) | F.col("_allowed")).drop("_id", "_allowed").distinct()


def source_coverage(rows: DataFrame, marks: DataFrame, key: str, mark: str, part: str) -> DataFrame:
    """(covered, total, pct): distinct keys of which some mark holds a part, ignoring case, of all distinct keys."""
    hit = marks.where(F.contains(F.upper(mark), F.lit(part.upper()))).select(key).distinct().withColumn("_hit", F.lit(True))
    flagged = rows.select(key).distinct().join(hit, key, "left")
    return flagged.agg(F.count("_hit").alias("covered"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.try_divide(100.0 * F.count("_hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("pct"))


def match_coverage(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """(covered, total, pct): distinct names (name) with an exact hit (query, id)."""
    hit = resolved.where("id is not null").select(F.col("query").alias("name")).distinct().withColumn("_hit", F.lit(True))
    flagged = names.select("name").distinct().join(hit, "name", "left")
    return flagged.agg(F.count("_hit").alias("covered"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.try_divide(100.0 * F.count("_hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("pct"))


def batch_status(requests: DataFrame) -> DataFrame:
    """Requests by status, and the percentage that has ended."""
    ended = F.col("status").isin("succeeded", "errored", "canceled", "expired")
    return requests.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processing", "succeeded", "errored", "canceled", "expired")], F.round(100.0 * F.count_if(ended) / F.count(F.lit(1)), 6).alias("pct_done"))


def overlap(streams: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids of each stream, of all together, and how many are in several."""
    tagged = None
    for name, df in streams.items():
        part = df.select(F.col(key).alias("id"), F.lit(name).alias("stream")).distinct()
        tagged = part if tagged is None else tagged.unionAll(part)
    per = tagged.groupBy("id").agg(F.count(F.lit(1)).alias("k"), *[F.max((F.col("stream") == n).cast("int")).alias(n) for n in streams])
    return per.agg(*[F.sum(n).cast("long").alias(n) for n in streams], F.count(F.lit(1)).alias("n_union"), (F.sum("k") - F.count(F.lit(1))).cast("long").alias("overlap"))
