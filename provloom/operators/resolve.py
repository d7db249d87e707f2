"""Entity resolution: ontology and taxonomy cascades, manual mappings, synonym index, decisions.

Exact tiers are equi-joins on normalised terms.  The loose tiers use an inverted index: an entry whose
text holds the query, or all of its words, has the query's rarest piece too, so only the entries
with that piece are compared.  No query is compared with all entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import name_variants, normalize_name, ontology_form, tokens
from .paths import Rounds, written
from .relational import first_wins

#: Tiers of an ontology search, best first.
TIERS = ("exact_label", "exact_synonym", "label_starts_with", "tokenized_label", "substring_label", "substring_synonym")
#: Kinds of taxon names, best first.
NAME_CLASSES = ("scientific name", "synonym", "equivalent name", "genbank synonym", "common name", "blast name")


def _none() -> Column:
    return F.array().cast("array<string>")


def terms(entries: DataFrame) -> DataFrame:
    """(term, tier, ord, id, label): every exact name of ontology entries (id, label, exact, other, ord)."""
    named = F.concat(F.array(F.struct(ontology_form(F.col("label")).alias("term"), F.lit(1).alias("tier"))), F.transform(F.coalesce("exact", _none()), lambda s: F.struct(ontology_form(s).alias("term"), F.lit(2).alias("tier"))))
    return entries.select(F.explode(named).alias("_t"), "ord", "id", "label").select("_t.term", "_t.tier", "ord", "id", "label").where("term <> ''")


def resolve_exact(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, id, label, match_type) by label, else by exact synonym, first in ontology order; nulls if none.

    ``queries`` has a column ``query``; each distinct one is looked up once.
    """
    q = queries.select("query").distinct().withColumn("term", ontology_form(F.col("query")))
    best = first_wins(q.join(terms(entries), "term"), ["query"], ["tier", "ord"])
    return q.select("query").join(best.select("query", "id", "label", F.when(F.col("tier") == 1, TIERS[0]).otherwise(TIERS[1]).alias("match_type")), "query", "left")


def _rarest_joined(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Queries and texts that have the query's rarest piece; both with an array ``_pieces`` of distinct strings.

    The index holds only pieces that a query has; how often each occurs picks one for each query.
    """
    asked = queries.withColumn("_piece", F.explode("_pieces")).drop("_pieces")
    index = texts.withColumn("_piece", F.explode("_pieces")).drop("_pieces").join(asked.select("_piece").distinct(), "_piece", "left_semi")
    often = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    one = asked.join(often, "_piece", "left").groupBy(*[c for c in asked.columns if c != "_piece"]).agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    return one.join(index, "_piece").drop("_piece")


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct runs of so many characters."""
    runs = F.transform(sizes, lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(_none()))
    return F.array_distinct(F.flatten(runs))


def holding(queries: DataFrame, texts: DataFrame, query: str, text: str) -> DataFrame:
    """Rows of both where the text holds the query, by the query's rarest run of three characters (or all of a shorter one)."""
    q = queries.where(F.length(query) > 0).withColumn("_pieces", _grams(F.col(query), F.array(F.least(F.lit(3), F.length(query)))))
    t = texts.withColumn("_pieces", _grams(F.col(text), F.array(F.lit(1), F.lit(2), F.lit(3))))
    return _rarest_joined(q, t).where(F.contains(F.col(text), F.col(query)))


def search_ontology(queries: DataFrame, entries: DataFrame, max_results: int = 5) -> DataFrame:
    """(query, rank, id, label, match_type): the best ``max_results`` entries for each query.

    An entry counts in its best tier: label equal, query an exact synonym, label starts with the
    query and a space, all words of the query in the label, query inside the label, query inside a
    synonym.  Ties are in ontology order.  A query of no characters, which every label holds, has no
    hits.  Candidates come from joins on terms and on rarest pieces.
    """
    q = queries.select("query").distinct().withColumn("_q", ontology_form(F.col("query"))).where("_q <> ''")
    e = entries.select("ord", "id", "label", ontology_form(F.col("label")).alias("_l"))
    named = terms(entries)
    exact = q.join(named, F.col("_q") == F.col("term")).select("query", "ord", "id", "label", "tier")
    worded = _rarest_joined(q.withColumn("_pieces", F.array_distinct(tokens(F.col("_q")))), e.withColumn("_pieces", F.array_distinct(tokens(F.col("_l")))))
    worded = worded.where(F.size(F.array_except(tokens(F.col("_q")), tokens(F.col("_l")))) == 0).select("query", "ord", "id", "label", F.lit(4).alias("tier"))
    inside = holding(q, e.where("_l <> ''"), "_q", "_l")
    inside = inside.select("query", "ord", "id", "label", F.when(F.startswith("_l", F.concat("_q", F.lit(" "))), 3).otherwise(5).alias("tier"))
    synonyms = entries.select("ord", "id", "label", F.explode(F.array_distinct(F.transform(F.concat(F.coalesce("exact", _none()), F.coalesce("other", _none())), ontology_form))).alias("_s"))
    by_synonym = holding(q, synonyms, "_q", "_s").select("query", "ord", "id", "label", F.lit(6).alias("tier"))
    hits = exact.unionAll(worded).unionAll(inside).unionAll(by_synonym).groupBy("query", "ord", "id", "label").agg(F.min("tier").alias("tier"))
    # Both substring tiers rank together, in ontology order.
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.least("tier", F.lit(5)), "ord"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= max_results).select("query", "rank", "id", "label", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).alias("match_type"))


def resolve_with_manual(queries: DataFrame, entries: DataFrame, manual: DataFrame) -> DataFrame:
    """(query, id, label, match_type): exact hit, else manual mapping (name, id, label), else best loose hit, else no_match."""
    exact = resolve_exact(queries, entries)
    key = F.lower(F.trim("query"))
    by_hand = manual.select(F.lower(F.trim("name")).alias("_k"), F.col("id").alias("_mid"), F.col("label").alias("_ml")).dropDuplicates(["_k"])
    found = exact.withColumn("_k", key).join(by_hand, "_k", "left").drop("_k")
    open_ = found.where("id is null and _mid is null").select("query")
    loose = search_ontology(open_, entries, 1).select("query", F.col("id").alias("_lid"), F.col("label").alias("_ll"), F.col("match_type").alias("_lt"))
    return found.join(loose, "query", "left").select(
        "query",
        F.coalesce("id", "_mid", "_lid").alias("id"),
        F.when(F.col("id").isNotNull(), F.col("label")).when(F.col("_mid").isNotNull(), F.col("_ml")).otherwise(F.col("_ll")).alias("label"),
        F.when(F.col("id").isNotNull(), F.col("match_type")).when(F.col("_mid").isNotNull(), F.lit("manual_mapping")).otherwise(F.coalesce("_lt", F.lit("no_match"))).alias("match_type"),
    )


def synonym_index(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """(variant, id, label, type): nodes by both numbers of their normalised names; the first wins."""
    v = nodes.select(F.explode(name_variants(normalize_name(F.col("label")))).alias("variant"), "id", "label", "type", F.col(order).alias("_o"))
    return first_wins(v, ["variant"], ["_o", "id"]).drop("_o")


def resolve_entities(mentions: DataFrame, nodes: DataFrame, order: str = "ord") -> DataFrame:
    """(name, type) -> id, label and type of the node of that name, else a minted literature id.

    A node's own type overrides the claimed one.  Names are looked up as they are, then in the other number.
    """
    index = synonym_index(nodes, order)
    m = mentions.select("name", "type").distinct().withColumn("_n", normalize_name(F.col("name")))
    other = F.get(name_variants(F.col("_n")), 1)
    pick = lambda p: index.select(F.col("variant").alias(f"_{p}"), F.struct("id", "label", "type").alias(f"_{p}_hit"))
    j = m.withColumn("_b", other).withColumnRenamed("_n", "_a").join(pick("a"), "_a", "left").join(pick("b"), "_b", "left")
    hit = F.coalesce("_a_hit", "_b_hit")
    minted = F.concat(F.lit("LLM:"), F.left(F.replace(F.col("_a"), F.lit(" "), F.lit("_")), F.lit(80)))
    return j.select("name", F.col("type").alias("claimed_type"), F.coalesce(hit["id"], minted).alias("id"), F.coalesce(hit["label"], F.col("name")).alias("label"), F.coalesce(hit["type"], F.col("type")).alias("type"), hit.isNull().alias("is_new"))


def canonical_taxon_names(names: DataFrame) -> DataFrame:
    """(tax_id, name): the first name of the best class, from (tax_id, name, name_class, ord)."""
    priority = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in NAME_CLASSES]), F.col("name_class")), F.lit(0))
    best = names.withColumn("_p", F.when(priority == 0, len(NAME_CLASSES) + 1).otherwise(priority))
    return first_wins(best.select("tax_id", "name", "_p", "ord"), ["tax_id"], ["_p", "ord"]).select("tax_id", "name")


def search_taxa(queries: DataFrame, names: DataFrame, ranks: DataFrame, max_results: int = 5) -> DataFrame:
    """(query, rank_no, tax_id, name, rank, match_type) for names of taxa.

    Exact by any name: scientific before synonyms before others, each taxon by the first class it has
    the name in.  Queries without an exact hit are looked for inside scientific names, in file order.
    """
    q = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query")))
    n = names.select("tax_id", F.lower("name").alias("_n"), "name_class", "ord")
    exact = first_wins(q.join(n, F.col("_q") == F.col("_n")).select("query", "tax_id", "name_class", "ord"), ["query", "tax_id"], ["ord"])
    tier = F.when(F.col("name_class") == "scientific name", 1).when(F.col("name_class").isin("synonym", "equivalent name", "genbank synonym"), 2).otherwise(3)
    exact = exact.select("query", "tax_id", tier.alias("tier"), "ord")
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    inside = holding(rest, n.where("name_class = 'scientific name'"), "_q", "_n").groupBy("query", "tax_id").agg(F.min("ord").alias("ord")).select("query", "tax_id", F.lit(4).alias("tier"), "ord")
    no = F.row_number().over(Window.partitionBy("query").orderBy("tier", "ord", "tax_id"))
    best = exact.unionAll(inside).withColumn("rank_no", no).where(F.col("rank_no") <= max_results)
    kinds = F.array(F.lit("exact_scientific"), F.lit("exact_synonym"), F.lit("exact_anyname"), F.lit("substring"))
    named = best.join(canonical_taxon_names(names), "tax_id", "left").join(ranks.select("tax_id", "rank"), "tax_id", "left")
    return named.select("query", "rank_no", "tax_id", "name", F.coalesce("rank", F.lit("no rank")).alias("rank"), F.element_at(kinds, F.col("tier")).alias("match_type"))


def lineage(taxa: DataFrame, nodes: DataFrame, max_depth: int = 40) -> DataFrame:
    """(tax_id, depth, ancestor) up to the root of a parent map (tax_id, parent_id); one join per level, each written once."""
    up = nodes.select(F.col("tax_id").alias("ancestor"), "parent_id").where("ancestor <> parent_id")
    with Rounds(taxa.sparkSession) as write:
        level = write(taxa.select("tax_id", F.lit(0).alias("depth"), F.col("tax_id").alias("ancestor")), "lineage")
        found = level
        for depth in range(1, max_depth + 1):
            level = write(level.join(up, "ancestor").select("tax_id", F.lit(depth).alias("depth"), F.col("parent_id").alias("ancestor")), "lineage")
            if level.isEmpty():
                break
            found = found.unionAll(level)
        return written(found, "lineage-found")


def resolve_microbes(rows: DataFrame, names: DataFrame, ranks: DataFrame) -> DataFrame:
    """(organism, taxon_id) -> (id, label): a given taxon id passes with the source's own name, else the best taxon of that name; rows without either are left out."""
    hits = search_taxa(rows.where("taxon_id is null").select(F.col("organism").alias("query")), names, ranks, 1)
    j = rows.where("trim(organism) <> ''").join(hits.select(F.col("query").alias("organism"), F.col("tax_id").alias("_t"), F.col("name").alias("_l")), "organism", "left")
    given = F.col("taxon_id").isNotNull()
    return j.withColumn("id", F.concat(F.lit("NCBITaxon:"), F.coalesce(F.col("taxon_id").cast("string"), F.col("_t").cast("string")))).withColumn("label", F.when(given, F.col("organism")).otherwise(F.col("_l"))).where("id is not null").drop("_t", "_l")


def resolve_compounds(compounds: DataFrame, synonyms: DataFrame, entries: DataFrame, manual: DataFrame) -> DataFrame:
    """(compound_id, id, label, match_source): by primary name (exact or manual), else by the first of its
    synonyms (compound_id, synonym, ord) that has an exact hit, else no_match."""
    exact = resolve_exact(compounds.select(F.col("name").alias("query")).unionAll(synonyms.select("synonym")), entries).where("id is not null")
    names = compounds.where("trim(name) <> ''").select("compound_id", F.trim("name").alias("query"))
    primary = names.join(exact, "query").select("compound_id", "id", "label", F.lit("primary_name").alias("match_source"), F.lit(1).alias("_p"), F.lit(0).cast("long").alias("_o"))
    by_hand = names.withColumn("_k", F.lower("query")).join(manual.select(F.lower(F.trim("name")).alias("_k"), "id", "label"), "_k").select("compound_id", "id", "label", F.lit("manual"), F.lit(2), F.lit(0).cast("long"))
    by_synonym = synonyms.select("compound_id", F.col("synonym").alias("query"), F.col("ord").cast("long").alias("_o")).join(exact, "query").select("compound_id", "id", "label", F.lit("chebi_synonym"), F.lit(3), "_o")
    best = first_wins(primary.unionAll(by_hand).unionAll(by_synonym), ["compound_id"], ["_p", "_o", "id"]).drop("_p", "_o")
    return compounds.select("compound_id").join(best, "compound_id", "left").withColumn("match_source", F.coalesce("match_source", F.lit("no_match")))


def decide_pairs(pairs: DataFrame, resolved: DataFrame, fuzzy_ok: tuple[str, ...] = ("Microbe",)) -> DataFrame:
    """Candidate pairs (entity_type, label_a, label_b) with both resolutions (label, id, exact) and a decision."""
    side = lambda s: resolved.select(F.col("label").alias(f"label_{s}"), F.col("id").alias(f"canon_{s}"), F.col("exact").alias(f"_exact_{s}"))
    j = pairs.join(side("a"), "label_a", "left").join(side("b"), "label_b", "left")
    d = scores.decide(F.col("canon_a"), F.col("_exact_a"), F.col("canon_b"), F.col("_exact_b"), ~F.col("entity_type").isin(*fuzzy_ok))
    return j.withColumn("decision", d).drop("_exact_a", "_exact_b")


def verify_manual(manual: DataFrame, entries: DataFrame) -> DataFrame:
    """Manual mappings with status OK, MISMATCH (another label) or NOT_FOUND (no such id)."""
    j = manual.join(entries.select("id", F.col("label").alias("_l")), "id", "left")
    same = F.lower("label") == F.lower("_l")
    return j.withColumn("status", F.when(F.col("_l").isNull(), "NOT_FOUND").when(same, "OK").otherwise("MISMATCH")).drop("_l")


def name_lookup(names: DataFrame, compounds: DataFrame, most: int = 3) -> DataFrame:
    """Compounds of equal name, ignoring case, ``most`` for each at most (a report), smallest ids first."""
    j = names.join(compounds.withColumn("_k", F.lower("name")).drop("name"), F.lower(names["name"]) == F.col("_k"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(names["name"]).orderBy("compound_id"))).where(F.col("rank") <= most).drop("_k")
