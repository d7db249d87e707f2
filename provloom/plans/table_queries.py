"""Text, ingestion, resolution, evaluation, sampling and vector queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import evaluate, ingest, relational, resolve, sample, vectors
from ..sources import remote, sinks
from .registry import query, table

# ---- names -----------------------------------------------------------------


def _normal_sql(c: str) -> str:
    low = f"regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g')"
    for g, name in text.GREEK.items():
        low = f"replace({low}, '{g}', '{name}')"
    plain = f"trim(regexp_replace(regexp_replace(replace({low}, '_', ' '), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    bare = f"regexp_replace({plain}, '^(?:(?:the|a|an)(?: |$))+', '')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.DISEASES.items())
    return f"CASE WHEN {c} IS NULL OR {c} = '-' THEN '' ELSE (SELECT CASE x {cases} ELSE x END FROM (SELECT {bare} AS x)) END"


@query(f"SELECT doc_id, md5({_normal_sql('text')}) AS name_md5 FROM documents")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_name(F.col("text"))).alias("name_md5"))


_SPLIT = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_MATCH = """{0} <> '' AND {1} <> '' AND ({0} = {1} OR {2} = {3} OR (length({0}) > 4 AND contains({1}, {0})) OR (length({1}) > 4 AND contains({0}, {1}))
OR (length({2}) > 4 AND contains({3}, {2})) OR (length({3}) > 4 AND contains({2}, {3}))
OR len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' ')))) >= 0.6)"""


def _sing(c: str) -> str:
    return f"(CASE WHEN ends_with({c}, 's') AND length({c}) > 3 THEN left({c}, length({c}) - 1) ELSE {c} END)"


@query(f"""WITH g AS (SELECT DISTINCT p_brand, p_name AS a FROM part), f AS (SELECT DISTINCT p_brand, lower(p_type) || ' ' || p_name || 's' AS b FROM part)
SELECT g.p_brand, a, b FROM g JOIN f ON g.p_brand = f.p_brand WHERE {_MATCH.format("a", "b", _sing("a"), _sing("b"))}""")
def name_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of each brand are compared, so the work doesn't grow with the parts of a brand."""
    p = table(spark, d, "part")
    g = p.select("p_brand", F.col("p_name").alias("a")).distinct()
    f = p.select("p_brand", F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit("s")).alias("b")).distinct()
    return g.join(f, "p_brand").where(text.names_match(text.normalize_name(F.col("a")), text.normalize_name(F.col("b"))))


@query(f"SELECT p_partkey, p_name AS name, {_sing('p_name')} AS singular, CASE WHEN ends_with(p_name, 's') AND length(p_name) > 3 THEN {_sing('p_name')} ELSE p_name || 's' END AS other, 'LLM:' || left(replace(p_name, ' ', '_'), 80) AS minted FROM part")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalize_name(F.col("p_name"))
    v = text.name_variants(n)
    return table(spark, d, "part").select("p_partkey", n.alias("name"), text.singular(n).alias("singular"), F.get(v, 1).alias("other"), text.mint_literature_id(n).alias("minted"))


# Labels as the rules see them: a part's name with capitals, digits and endings put to it.
_LABEL = "CASE p_partkey % 8 WHEN 0 THEN 'Lactobacillus ' || p_name WHEN 1 THEN upper(left(p_name, 2)) || p_size || ' strain' WHEN 2 THEN p_name || ' sp. mix' WHEN 3 THEN 'β-' || p_name WHEN 4 THEN p_name || ' glucose' WHEN 5 THEN 'Bacillus fermented ' || p_name || ' drink' WHEN 6 THEN p_name || ' diet' ELSE p_name || ' 2,3-acid' END"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(_LABEL).alias("label"), F.when(F.col("p_size") % 3 == 0, "Microbe").otherwise("Food").alias("type"))


_FLAG_SQL = f"""WITH l AS (SELECT p_partkey, {_LABEL} AS label, CASE WHEN p_size % 3 = 0 THEN 'Microbe' ELSE 'Food' END AS type FROM part),
t AS (SELECT *, lower(label) AS low, {_SPLIT.format("label")} AS toks FROM l),
r AS (SELECT *, list_contains([{', '.join(f"'{g}'" for g in text.GENERA)}], regexp_replace(lower(toks[1]), '[^a-z]', '', 'g')) AS genus,
  len(list_filter(toks, lambda x: length(x) >= 4 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 1)) > 0 AS strain,
  regexp_matches(low, '\\bsp\\.?\\b|\\bspp\\.?\\b') OR contains(low, 'consortium') AS sp, contains(label, 'β') AS greek,
  regexp_matches(low, '{"|".join(text.COMPOUND_WORDS)}') AS word, regexp_matches(label, '\\d[,-]\\d') AS iupac,
  regexp_replace(lower(toks[-1]), '[^a-z]', '', 'g') AS last FROM t),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN genus THEN 'genus' END, CASE WHEN strain THEN 'strain_code' END, CASE WHEN sp THEN 'consortium/sp.' END], lambda x: x IS NOT NULL), '|') AS microbe,
  array_to_string(list_filter([CASE WHEN greek THEN 'greek_letter' END, CASE WHEN word THEN 'compound_keyword' END, CASE WHEN iupac THEN 'iupac_pattern' END,
    CASE WHEN length(last) >= 5 AND (ends_with(last, 'ose') OR ends_with(last, 'ol') OR ends_with(last, 'ide') OR ends_with(last, 'ate')) THEN 'chemical_suffix' END], lambda x: x IS NOT NULL), '|') AS compound FROM r)"""


@query(f"{_FLAG_SQL} SELECT p_partkey, label, microbe, compound FROM f")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    l = _labelled(spark, d)
    return l.select("p_partkey", "label", F.array_join(text.microbe_flags(F.col("label")), "|").alias("microbe"), F.array_join(text.compound_flags(F.col("label")), "|").alias("compound"))


@query(f"""{_FLAG_SQL} SELECT coalesce(CASE WHEN microbe <> '' AND type <> 'Microbe' THEN CASE WHEN genus AND len(toks) <= 5 AND len(list_intersect(string_split(low, ' '), [{', '.join(f"'{w}'" for w in text.PRODUCTS)}])) = 0 THEN 'high_confidence_microbe' ELSE 'medium_microbe' END
WHEN regexp_matches(low, '\\bdiet\\b') AND type = 'Food' THEN 'dietary_pattern' WHEN compound <> '' AND type = 'Food' THEN 'compound_candidate' END, 'none') AS bucket, count(*) AS n FROM f GROUP BY 1""")
def triage_buckets(spark: SparkSession, d: str) -> DataFrame:
    l = _labelled(spark, d).withColumn("m", text.microbe_flags(F.col("label"))).withColumn("c", text.compound_flags(F.col("label")))
    bucket = text.triage_bucket(F.col("label"), F.col("type"), F.col("m"), F.col("c"))
    return l.groupBy(F.coalesce(bucket, F.lit("none")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, label, NOT regexp_matches(label, '^(?:Common|Wheat|Raw) ') AND regexp_matches(label, '^[A-Z][a-z]*\\s+[a-z][a-z-]*(\\s|$)') AS binomial FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(left(p_name, 1)) || p_name[2:] WHEN 1 THEN 'Common ' || p_name WHEN 2 THEN p_name ELSE 'Wheat2 ' || p_name END AS label FROM part)")
def binomial_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    capital = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", F.lit(2), F.length("p_name")))
    l = table(spark, d, "part").select("p_partkey", F.when(k == 0, capital).when(k == 1, F.concat(F.lit("Common "), "p_name")).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("Wheat2 "), "p_name")).alias("label"))
    return l.withColumn("binomial", text.is_binomial(F.col("label")))


_MESH = "CASE lang WHEN 'fr' THEN ['Diet', 'Gastrointestinal Microbiome', 'Crohn Disease'] WHEN 'de' THEN ['Crohn Disease'] WHEN 'es' THEN ['Inflammatory Bowel Diseases', 'Diet'] ELSE [] END"


@query(f"""WITH a AS (SELECT lang, source, lower(source) || ' ' || lower(text) || CASE WHEN n_chars % 3 = 0 THEN ' indole' WHEN n_chars % 3 = 1 THEN ' roseburia' ELSE '' END AS t, {_MESH} AS mesh, n_chars > 5000 AS review FROM documents),
b AS (SELECT *, list_contains(mesh, 'Gastrointestinal Microbiome') OR contains(t, 'microbiom') OR contains(t, 'microbiota') AS mb, len(mesh) > 0 OR contains(t, 'crohn') OR contains(t, 'ulcerative colitis') AS ibd,
  list_contains(mesh, 'Diet') OR contains(t, 'diet') OR contains(t, 'nutrition') OR contains(t, 'food') AS diet,
  {' OR '.join(f"contains(t, '{w}')" for w in text.BIOACTIVE_WORDS)} AS bio, {' OR '.join(f"contains(t, '{w}')" for w in text.MICROBE_WORDS)} AS mic FROM a)
SELECT lang, CASE WHEN review THEN 'reviews' WHEN NOT (mb OR bio OR mic) AND ibd THEN 'off_scope' WHEN diet AND mb AND ibd THEN 'diet_microbiome_ibd' WHEN mic AND ibd THEN 'microbe_ibd' WHEN bio AND ibd THEN 'bioactive_ibd' ELSE 'general' END AS stratum, count(*) AS n FROM b GROUP BY ALL""")
def stratum_classify(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    terms = lambda *t: F.array(*[F.lit(x) for x in t])
    mesh = F.when(lang == "fr", terms("Diet", "Gastrointestinal Microbiome", "Crohn Disease")).when(lang == "de", terms("Crohn Disease")).when(lang == "es", terms("Inflammatory Bowel Diseases", "Diet")).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.col("n_chars") % 3 == 0, " indole").when(F.col("n_chars") % 3 == 1, " roseburia").otherwise("")
    kinds = F.when(F.col("n_chars") > 5000, terms("Review")).otherwise(terms("Journal Article"))
    return table(spark, d, "documents").select("lang", text.stratum(F.col("source"), F.concat("text", tail), mesh, kinds).alias("stratum")).groupBy("lang", "stratum").agg(F.count(F.lit(1)).alias("n"))


_TAXA = "'k__Bacteria.p__' || p_type || CASE p_partkey % 4 WHEN 0 THEN '.g__' || replace(p_name, ' ', '_') || '.s__unclassified' WHEN 1 THEN '.s__' || replace(p_name, ' ', '_') WHEN 2 THEN '.g__NA' ELSE '.f__.o__' || p_brand END"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand END AS name, CASE p_partkey % 4 WHEN 0 THEN 'genus' WHEN 1 THEN 'species' WHEN 2 THEN 'phylum' ELSE 'order' END AS rank FROM part")
def taxon_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", text.most_specific_taxon(F.expr(_TAXA)).alias("t"))
    return p.select("p_partkey", F.col("t.name").alias("name"), F.col("t.rank").alias("rank"))


@query("SELECT p_partkey, regexp_replace(CASE WHEN p_size % 2 = 0 THEN 'lf ' ELSE '' END || p_name, '\\blf\\b', 'low-fat') AS food, 'CLUSTER:' || replace(replace(p_name || '/' || p_type, ' ', '_'), '/', '_') AS cluster FROM part")
def food_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("group_"), F.when(F.col("p_size") % 2 == 0, "lf_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, d, "part").select("p_partkey", text.food_name(raw).alias("food"), text.mint_cluster_id(F.concat("p_name", F.lit("/"), "p_type"), "CLUSTER:").alias("cluster"))


# ---- scores and filters -----------------------------------------------------


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, CASE WHEN f < 1e-10 THEN 0.95 WHEN f < 1e-5 THEN 0.92 WHEN f < 1e-3 THEN 0.88 WHEN f < 0.01 THEN 0.85 WHEN f < 0.05 THEN 0.80 ELSE 0.5 END AS by_fdr,
round(CASE WHEN l_returnflag = 'A' THEN 0.88 ELSE 0.85 END - CASE WHEN l_linestatus = 'O' THEN 0.05 ELSE 0 END, 2) AS by_method, CASE WHEN l_returnflag = 'A' THEN 0.92 ELSE 0.88 END AS by_priority,
CASE WHEN l_tax > 0.03 THEN 'increases' ELSE 'decreases' END AS effect, count(*) AS n FROM (SELECT *, l_discount / 2 AS f FROM lineitem) GROUP BY ALL""")
def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.groupBy(
        "l_returnflag",
        scores.confidence_from_fdr(F.col("l_discount") / 2).cast("decimal(3,2)").alias("by_fdr"),
        scores.confidence_of_finding(F.when(F.col("l_returnflag") == "A", "1.5"), F.when(F.col("l_linestatus") == "O", "qPCR").otherwise("16S qPCR")).cast("decimal(3,2)").alias("by_method"),
        scores.confidence_of_pathway(F.when(F.col("l_returnflag") == "A", "high")).cast("decimal(3,2)").alias("by_priority"),
        scores.direction(F.col("l_tax") - 0.03).alias("effect"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount < 0.05 AND l_tax > 0.05 AND l_returnflag <> 'N' GROUP BY ALL")
def significance_filter(spark: SparkSession, d: str) -> DataFrame:
    fdr = F.when(F.col("l_returnflag") == "N", F.lit("NS")).otherwise(F.col("l_discount").cast("string"))
    i = table(spark, d, "lineitem").select("l_returnflag", fdr.alias("FDR"), F.col("l_tax").cast("string").alias("Het_Pval"))
    return ingest.significant(i).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'DOID:1' WHEN 'view' THEN 'DOID:2' END AS object_id, CASE WHEN user_id % 3 = 2 THEN 'unknown_outcome' ELSE 'used' END AS skip, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def whitelist_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("disease_name"), (F.col("user_id") % 3).cast("string").alias("qualitative_outcome"))
    diseases = spark.createDataFrame([("click", "DOID:1"), ("view", "DOID:2")], "disease_name string, object_id string")
    outcomes = spark.createDataFrame([("0", "decreased_in"), ("1", "increased_in")], "qualitative_outcome string, predicate string")
    return ingest.whitelisted(e, diseases, outcomes).groupBy("object_id", F.coalesce("skip", F.lit("used")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


_CONTENT = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS source_id, l_suppkey AS food_id, CASE WHEN l_discount = 0.03 THEN NULL ELSE l_tax - 0.02 END AS std, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount - 0.03 END AS orig, l_returnflag FROM lineitem WHERE l_linestatus = 'O'),
j AS (SELECT r.*, s.s_name, p.p_size < 10 AS allowed FROM r JOIN part p ON p.p_partkey = source_id AND p.p_size < 40 LEFT JOIN supplier s ON s.s_suppkey = food_id AND s.s_acctbal > 0),
k AS (SELECT *, CASE WHEN s_name IS NULL THEN 'no_food' WHEN std = 0 OR (std IS NULL AND orig = 0) THEN 'no_content' ELSE 'used' END AS skip, coalesce(std > 0, false) OR coalesce(orig > 0, false) AS measured FROM j)"""


@query(f"{_CONTENT} SELECT skip, CAST(0.80 + CASE WHEN allowed THEN 0.05 ELSE 0 END + CASE WHEN measured THEN 0.05 ELSE -0.10 END AS DECIMAL(3,2)) AS confidence, l_returnflag || ': x' || CASE WHEN measured THEN '' ELSE ' | presence_only' END AS notes, count(*) AS n FROM k GROUP BY ALL")
def food_content(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "Compound").otherwise("Nutrient").alias("source_type"),
        F.col("l_partkey").alias("source_id"),
        F.col("l_suppkey").alias("food_id"),
        F.when(F.col("l_discount") != 0.03, F.col("l_tax") - 0.02).alias("standard_content"),
        F.when(F.col("l_linenumber") != 2, F.col("l_discount") - 0.03).alias("orig_content"),
        F.lit("x").alias("citation"),
        F.col("l_returnflag").alias("citation_type"),
    )
    foods = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("food_id"), F.col("s_name").alias("subject_id"))
    compounds = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("source_id"), (F.col("p_size") < 10).alias("allowed"))
    done = ingest.food_content(i, foods, compounds)
    return done.groupBy(F.coalesce("skip", F.lit("used")).alias("skip"), F.col("confidence").cast("decimal(3,2)").alias("confidence"), "notes").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY p_brand")
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 8, 13, 21, 34)], "id int")
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("size"))
    return ingest.allow_listed(p, ids, "size").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def sentinel_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderpriority") == "1-URGENT", "NONE").when(F.col("o_orderpriority") == "5-LOW", "ERROR").otherwise("X").alias("predicate"))
    return evaluate.real_triples(o, ("NONE", "", "ERROR")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT coalesce(CASE WHEN 1 - l_discount * 20 < 0 THEN 'confidence' WHEN l_linestatus = 'O' THEN 'subject_type' WHEN l_returnflag = 'A' THEN 'object_type' END, 'valid') AS reason FROM lineitem) GROUP BY reason")
def row_validator(spark: SparkSession, d: str) -> DataFrame:
    from ..schema import reject_reason

    i = table(spark, d, "lineitem").select((1 - F.col("l_discount") * 20).alias("confidence"), F.when(F.col("l_linestatus") == "O", "Planet").otherwise("Food").alias("subject_type"), F.when(F.col("l_returnflag") != "A", "Bioactive").alias("object_type"))
    return i.groupBy(F.coalesce(reject_reason(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'is_low_fodmap_food' ELSE 'has_high_fodmap_content_of' END AS predicate, CASE WHEN p_size % 2 = 0 THEN 'FODMAP:low_FODMAP' WHEN p_type = 'ECONOMY' THEN 'CHEBI:1' WHEN p_type = 'SMALL' THEN 'CHEBI:2' END AS object_id,
CASE WHEN p_size % 2 = 1 AND p_type NOT IN ('ECONOMY', 'SMALL') THEN 'unknown_class' ELSE 'used' END AS skip, CASE WHEN p_brand <> 'Brand#2' THEN p_brand END AS notes, count(*) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY ALL""")
def content_routing(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("p_size") % 5 == 0, "medium").when(F.col("p_size") % 2 == 0, "low").otherwise("high")
    p = table(spark, d, "part").select(F.col("p_name").alias("food_name"), F.col("p_type").alias("fodmap_class"), level.alias("content_level"), F.when(F.col("p_brand") == "Brand#2", "-").otherwise(F.col("p_brand")).alias("notes"))
    classes = spark.createDataFrame([("ECONOMY", "CHEBI:1", "economy"), ("SMALL", "CHEBI:2", "small")], "fodmap_class string, object_id string, object_label string")
    return ingest.carbohydrate_content(p, classes).groupBy("predicate", "object_id", F.coalesce("skip", F.lit("used")).alias("skip"), "notes").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, left(text, 80) AS text, left(source, 3) AS source FROM documents")
def truncations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.truncated(table(spark, d, "documents").select("doc_id", "text", "source"), {"text": 80, "source": 3})


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE length(text) % 7 = conv_id % 7)")
def group_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 7).cast("long").alias("pmid"))
    source = c.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 7).alias("pmid"))
    return ingest.consistent_groups(c, source, "conv_id").select("conv_id", "turn")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = d.n_chars % 2 THEN 'unchanged' ELSE 'rebuilt' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY status")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("annot_id"), (F.col("n_chars") % 2).cast("int").alias("pmid"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("annot_id"), F.col("quality").alias("pmid"))
    return ingest.source_status(docs, labels).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- resolution --------------------------------------------------------------

_ONT = "ont AS (SELECT 'part:' || min(p_partkey) AS id, p_name AS label, min(p_partkey) AS ord, [max(lower(p_brand)) || ' ' || p_name] AS exact, [min(p_type)] AS other FROM part GROUP BY p_name)"


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("ord"), F.array(F.concat(F.max(F.lower("p_brand")), F.lit(" "), F.first("p_name"))).alias("exact"), F.array(F.min("p_type")).alias("other"))
    return p.withColumn("id", F.concat(F.lit("part:"), F.col("ord").cast("string")))


@query(f"""WITH {_ONT}, q AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN p_brand || ' ' || p_name ELSE '(' || p_name || ') x' END AS query FROM part),
n AS (SELECT query, regexp_replace(lower(query), '[()\\[\\]]', '', 'g') AS term FROM q), t AS (SELECT label AS term, 1 AS tier, ord, id, label FROM ont UNION ALL SELECT exact[1], 2, ord, id, label FROM ont),
b AS (SELECT n.query, arg_min(t.id, (t.tier, t.ord)) AS id, arg_min(t.label, (t.tier, t.ord)) AS label, min(t.tier) AS tier FROM n JOIN t ON t.term = n.term GROUP BY n.query)
SELECT q.query, b.id, b.label, CASE b.tier WHEN 1 THEN 'exact_label' WHEN 2 THEN 'exact_synonym' END AS match_type FROM q LEFT JOIN b ON b.query = q.query""")
def cascade_exact(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 3
    q = table(spark, d, "part").select(F.when(m == 0, F.upper("p_name")).when(m == 1, F.concat("p_brand", F.lit(" "), "p_name")).otherwise(F.concat(F.lit("("), "p_name", F.lit(") x"))).alias("query"))
    return resolve.resolve_exact(q, _ontology(spark, d))


_TIER = """CASE WHEN label = term THEN 1 WHEN exact[1] = term THEN 2 WHEN starts_with(label, term || ' ') THEN 3 WHEN len(list_filter(string_split(term, ' '), lambda x: NOT list_contains(string_split(label, ' '), x))) = 0 THEN 4 WHEN contains(label, term) THEN 5 WHEN contains(exact[1], term) OR contains(lower(other[1]), term) THEN 6 END"""
_QUERIES = ("red ring", "ring small", "small", "ring", "brand#2", "econ", "zzz")
_QV = ", ".join(f"('{q}')" for q in _QUERIES)
_NAMES6 = "['exact_label', 'exact_synonym', 'label_starts_with', 'tokenized_label', 'substring_label', 'substring_synonym']"


@query(f"""WITH {_ONT}, q AS (SELECT * FROM (VALUES {_QV}) t(query)), h AS (SELECT query, id, label, ord, (SELECT {_TIER} FROM (SELECT query AS term)) AS tier FROM q, ont),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY least(tier, 5), ord) AS rank FROM h WHERE tier IS NOT NULL) SELECT query, rank, id, label, {_NAMES6}[tier] AS match_type FROM r WHERE rank <= 5""")
def cascade_search(spark: SparkSession, d: str) -> DataFrame:
    return resolve.search_ontology(spark.createDataFrame([(q,) for q in _QUERIES], "query string"), _ontology(spark, d))


@query(f"""WITH {_ONT}, q AS (SELECT * FROM (VALUES {_QV}) t(query)), h AS (SELECT query, id, label, ord, (SELECT {_TIER} FROM (SELECT query AS term)) AS tier FROM q, ont),
b AS (SELECT query, arg_min(id, (least(tier, 5), ord)) AS id, arg_min(label, (least(tier, 5), ord)) AS label, arg_min(tier, (least(tier, 5), ord)) AS tier FROM h WHERE tier IS NOT NULL GROUP BY query)
SELECT q.query, CASE WHEN b.tier <= 2 THEN b.id WHEN q.query IN ('small', 'zzz') THEN 'manual:1' ELSE b.id END AS id, CASE WHEN b.tier <= 2 THEN b.label WHEN q.query IN ('small', 'zzz') THEN 'by hand' ELSE b.label END AS label,
CASE WHEN b.tier <= 2 THEN {_NAMES6}[b.tier] WHEN q.query IN ('small', 'zzz') THEN 'manual_mapping' ELSE coalesce({_NAMES6}[b.tier], 'no_match') END AS match_type FROM q LEFT JOIN b ON b.query = q.query""")
def manual_fallback(spark: SparkSession, d: str) -> DataFrame:
    manual = spark.createDataFrame([("Small ", "manual:1", "by hand"), ("ZZZ", "manual:1", "by hand")], "name string, id string, label string")
    return resolve.resolve_with_manual(spark.createDataFrame([(q,) for q in _QUERIES], "query string"), _ontology(spark, d), manual)


@query(f"""WITH nd AS (SELECT 'part:' || min(p_partkey) AS id, p_name AS label, min(p_type) AS type FROM part WHERE p_size < 30 GROUP BY p_name, p_brand), v AS (SELECT label AS variant, id, label, type FROM nd UNION ALL SELECT label || 's', id, label, type FROM nd),
i AS (SELECT variant, arg_min(id, id) AS id, arg_min(label, id) AS label, arg_min(type, id) AS type FROM v GROUP BY variant),
m AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'The ' || p_name || 's' ELSE p_name || ' new_' || p_type END AS name FROM part), n AS (SELECT name, CASE WHEN starts_with(name, 'The ') THEN lower(name)[5:] ELSE replace(lower(name), '_', ' ') END AS nm FROM m)
SELECT n.name, 'Claimed' AS claimed_type, coalesce(i.id, 'LLM:' || replace(nm, ' ', '_')) AS id, coalesce(i.label, n.name) AS label, coalesce(i.type, 'Claimed') AS type, i.id IS NULL AS is_new FROM n LEFT JOIN i ON i.variant = nm""")
def synonym_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    nodes = p.where("p_size < 30").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("type")).select(F.concat(F.lit("part:"), F.col("k").cast("string")).alias("id"), F.col("p_name").alias("label"), "type").withColumn("ord", F.col("id"))
    mention = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("The "), "p_name", F.lit("s"))).otherwise(F.concat("p_name", F.lit(" new_"), "p_type"))
    return resolve.resolve_entities(p.select(mention.alias("name"), F.lit("Claimed").alias("type")), nodes)


_TAX = "names AS (SELECT p_size AS tax_id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'scientific name' WHEN 1 THEN 'synonym' WHEN 2 THEN 'common name' ELSE 'blast name' END AS name_class, p_partkey AS ord FROM part)"
_TQ = ("red ring", "small ring", "old", "green bolt")


@query(f"""WITH {_TAX}, canon AS (SELECT tax_id, arg_min(name, (p, ord)) AS name FROM (SELECT *, CASE name_class WHEN 'scientific name' THEN 1 WHEN 'synonym' THEN 2 WHEN 'common name' THEN 5 ELSE 6 END AS p FROM names) GROUP BY tax_id),
q AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _TQ)}) t(query)), e AS (SELECT query, tax_id, arg_min(name_class, ord) AS nc, min(ord) AS ord FROM q JOIN names ON name = query GROUP BY ALL),
x AS (SELECT query, tax_id, CASE nc WHEN 'scientific name' THEN 1 WHEN 'synonym' THEN 2 ELSE 3 END AS tier, ord FROM e UNION ALL SELECT query, tax_id, 4, min(ord) FROM q JOIN names ON contains(name, query) AND name_class = 'scientific name' WHERE query NOT IN (SELECT query FROM e) GROUP BY query, tax_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, ord, tax_id) AS rank_no FROM x)
SELECT r.query, r.rank_no, r.tax_id, c.name, 'no rank' AS rank, ['exact_scientific', 'exact_synonym', 'exact_anyname', 'substring'][r.tier] AS match_type FROM r JOIN canon c ON c.tax_id = r.tax_id WHERE rank_no <= 5""")
def taxon_search(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "scientific name").when(k == 1, "synonym").when(k == 2, "common name").otherwise("blast name")
    names = table(spark, d, "part").select(F.col("p_size").alias("tax_id"), F.col("p_name").alias("name"), kind.alias("name_class"), F.col("p_partkey").alias("ord"))
    ranks = spark.createDataFrame([], "tax_id int, rank string")
    return resolve.search_taxa(spark.createDataFrame([(q,) for q in _TQ], "query string"), names, ranks)


@query("SELECT p_name AS compound, min(p_size) AS size FROM part WHERE p_size IS NOT NULL AND p_type <> 'PROMO' GROUP BY p_name")
def min_id_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("compound"), F.when(F.col("p_type") == "PROMO", "x").otherwise(F.col("p_size").cast("string")).alias("size"))
    found = ingest.smallest_ids(p, "compound", "size")
    return found.select("compound", F.col("size").cast("int").alias("size"))


@query("""WITH r AS (SELECT p_name AS label, CASE WHEN min(p_size) > 1 THEN NULL ELSE min(p_brand) END AS id, min(p_partkey) % 2 = 0 AS exact FROM part GROUP BY p_name),
p AS (SELECT DISTINCT CASE WHEN a.p_size % 2 = 0 THEN 'Microbe' ELSE 'Food' END AS entity_type, a.p_name AS label_a, b.label AS label_b FROM part a JOIN (SELECT p_brand, min(p_name) AS label FROM part GROUP BY p_brand) b ON a.p_brand = b.p_brand)
SELECT p.entity_type, p.label_a, p.label_b, a.id AS canon_a, b.id AS canon_b, CASE WHEN a.id IS NULL OR b.id IS NULL OR (p.entity_type <> 'Microbe' AND NOT (a.exact AND b.exact)) THEN 'MANUAL' WHEN a.id = b.id THEN 'MERGE' ELSE 'KEEP' END AS decision
FROM p LEFT JOIN r a ON a.label = p.label_a LEFT JOIN r b ON b.label = p.label_b""")
def decide_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    resolved = p.groupBy(F.col("p_name").alias("label")).agg(F.when(F.min("p_size") <= 1, F.min("p_brand")).alias("id"), (F.min("p_partkey") % 2 == 0).alias("exact"))
    first = p.groupBy("p_brand").agg(F.min("p_name").alias("label_b"))
    pairs = p.join(first, "p_brand").select(F.when(F.col("p_size") % 2 == 0, "Microbe").otherwise("Food").alias("entity_type"), F.col("p_name").alias("label_a"), "label_b").distinct()
    return resolve.decide_pairs(pairs, resolved)


@query("WITH m AS (SELECT DISTINCT 'part:' || (p_size * 40) AS id, p_brand AS label FROM part) SELECT m.id, m.label, CASE WHEN p.p_partkey IS NULL THEN 'NOT_FOUND' WHEN lower(p.p_brand) = lower(m.label) THEN 'OK' ELSE 'MISMATCH' END AS status FROM m LEFT JOIN part p ON 'part:' || p.p_partkey = m.id")
def verify_manual(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    manual = p.select(F.concat(F.lit("part:"), (F.col("p_size") * 40).cast("string")).alias("id"), F.col("p_brand").alias("label")).distinct()
    return resolve.verify_manual(manual, p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lower("p_brand").alias("label")))


@query("SELECT name, p_partkey AS compound_id, rank FROM (SELECT q.name, p.p_partkey, row_number() OVER (PARTITION BY q.name ORDER BY p.p_partkey) AS rank FROM (SELECT DISTINCT upper(p_name) AS name FROM part) q JOIN part p ON lower(p.p_name) = lower(q.name)) WHERE rank <= 3")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return resolve.name_lookup(p.select(F.upper("p_name").alias("name")).distinct(), p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("compound_id")))


@query(f"""WITH {_ONT}, c AS (SELECT p_partkey AS compound_id, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'handmade' ELSE 'unknown ' || p_name END AS name, p_name AS syn, p_size FROM part)
SELECT c.compound_id, CASE p_size % 3 WHEN 1 THEN 'manual:9' ELSE o.id END AS id, CASE p_size % 3 WHEN 1 THEN 'by hand' ELSE o.label END AS label, CASE WHEN p_size % 3 = 0 THEN 'primary_name' WHEN p_size % 3 = 1 THEN 'manual' WHEN o.id IS NOT NULL THEN 'chebi_synonym' ELSE 'no_match' END AS match_source
FROM c LEFT JOIN ont o ON o.label = c.syn AND (c.p_size % 3 = 0 OR (c.p_size % 3 = 2 AND c.p_size < 30))""")
def compound_chain(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 3
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("compound_id"), F.when(m == 0, F.upper("p_name")).when(m == 1, F.lit("handmade")).otherwise(F.concat(F.lit("unknown "), "p_name")).alias("name"))
    syn = p.where("p_size < 30").select(F.col("p_partkey").alias("compound_id"), F.explode(F.array(F.struct(F.lit("nothing").alias("synonym"), F.lit(1).alias("ord")), F.struct(F.col("p_name").alias("synonym"), F.lit(2).alias("ord")))).alias("s")).select("compound_id", "s.synonym", "s.ord")
    manual = spark.createDataFrame([("Handmade", "manual:9", "by hand")], "name string, id string, label string")
    return resolve.resolve_compounds(c, syn, _ontology(spark, d), manual)


@query("""WITH names AS (SELECT p_size AS tax_id, p_name AS name, p_partkey AS ord FROM part), x AS (SELECT name, arg_min(tax_id, ord) AS t FROM names GROUP BY name), f AS (SELECT name, t FROM x UNION ALL SELECT q.p_name, arg_min(n.tax_id, (n.ord, n.tax_id)) FROM (SELECT DISTINCT p_name FROM part WHERE p_size % 2 = 1) q JOIN names n ON contains(n.name, q.p_name) WHERE q.p_name NOT IN (SELECT name FROM names) GROUP BY q.p_name), canon AS (SELECT tax_id, arg_min(name, ord) AS name FROM names GROUP BY tax_id)
SELECT p.p_partkey, 'NCBITaxon:' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, f.t) AS id, CASE WHEN p_size % 2 = 0 THEN p.p_name ELSE canon.name END AS label FROM part p LEFT JOIN f ON f.name = p.p_name LEFT JOIN canon ON canon.tax_id = f.t WHERE p_size % 2 = 0 OR f.t IS NOT NULL""")
def microbe_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    names = p.select(F.col("p_size").alias("tax_id"), F.col("p_name").alias("name"), F.lit("scientific name").alias("name_class"), F.col("p_partkey").alias("ord"))
    rows = p.select("p_partkey", F.col("p_name").alias("organism"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("taxon_id"))
    return resolve.resolve_microbes(rows, names, spark.createDataFrame([], "tax_id int, rank string")).select("p_partkey", "id", "label")


@query("SELECT n_name AS pathway_id, CASE WHEN s_acctbal < 0 THEN 'no_id' WHEN s_suppkey % 3 = 0 THEN 'no_name' ELSE 'used' END AS skip, CASE WHEN n_regionkey = 1 THEN 0.92 ELSE 0.88 END AS confidence, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def pathway_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    links = table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("pathway_id"), F.col("s_suppkey").alias("compound_id"), F.when(F.col("n_regionkey") == 1, "high").alias("priority"))
    ids = s.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("compound_id"), F.col("s_name").alias("chebi_id"))
    names = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("compound_id"), F.col("s_name").alias("name"))
    done = ingest.pathway_compounds(links, ids, names)
    return done.groupBy("pathway_id", F.coalesce("skip", F.lit("used")).alias("skip"), F.col("confidence").cast("decimal(3,2)").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates, windows, sets -----------------------------------------------


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS synonyms FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def collected_synonyms(spark: SparkSession, d: str) -> DataFrame:
    src = F.when(F.col("event_type").isin("click", "error"), "ChEBI").otherwise("other")
    e = table(spark, d, "events").select(F.col("user_id").alias("compound_id"), F.col("event_type").alias("synonym"), src.alias("synonym_source"), F.col("event_id").alias("ord"))
    return ingest.collected_synonyms(e).select(F.col("compound_id").alias("user_id"), F.array_join("synonyms", "|").alias("synonyms"))


@query("WITH w AS (SELECT DISTINCT lower(regexp_replace(string_split(p_name, ' ')[1], '[^a-zA-Z]', '', 'g')) AS genus FROM part) SELECT genus FROM w WHERE length(genus) >= 4 UNION SELECT * FROM (VALUES " + ", ".join(f"('{g}')" for g in text.GENERA) + ") t(genus)")
def genus_set(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.repair import known_genera

    return known_genera(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.lit("Microbe").alias("type")))


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'click') AS click, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS error, (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('click', 'error')) AS n_union,
(SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'click') + (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') - (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('click', 'error')) AS overlap""")
def stream_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ingest.overlap({k: e.where(F.col("event_type") == k) for k in ("click", "error")}, "user_id")


@query("SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_name, p_type LIMIT 15")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return relational.top(table(spark, d, "part"), ["p_name", "p_type"], 15)


@query("SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, round((sum(length(text)) * 3.0 + count(*) * 100 * 15.0) / 1e6 * 0.5, 6) AS cost FROM conversations GROUP BY role")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count(F.lit(1)).alias("n"))
    return g.select("role", "chars", F.round(scores.batch_cost(F.col("chars"), F.col("n") * 100, 3.0, 15.0, 0.5), 6).alias("cost"))


@query("SELECT count(*) FILTER (event_type = 'view') AS processing, count(*) FILTER (event_type = 'click') AS succeeded, count(*) FILTER (event_type = 'error') AS errored, count(*) FILTER (event_type = 'signup') AS canceled, count(*) FILTER (event_type = 'purchase') AS expired, round(100.0 * count(*) FILTER (event_type <> 'view') / count(*), 6) AS pct_done FROM events")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("view", "processing", "click", "succeeded", "error", "errored", "signup", "canceled", "purchase", "expired")])
    return ingest.batch_status(table(spark, d, "events").select(F.element_at(kinds, F.col("event_type")).alias("status")))


@query("SELECT count(*) AS lookups, count(*) FILTER (quality = 0) AS matched, count(*) FILTER (quality = 1) AS \"new\", count(*) FILTER (toxic = 1) AS dropped, count(*) FILTER (toxic = 0) AS surviving FROM labels")
def resolution_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.resolution_report(table(spark, d, "labels").select((F.col("quality") == 1).alias("is_new"), (F.col("toxic") == 0).alias("valid")))


@query("SELECT count(DISTINCT p.p_partkey) AS with_line, (SELECT count(*) FROM part) AS total, round(100.0 * count(DISTINCT p.p_partkey) / (SELECT count(*) FROM part), 6) AS pct FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)")
def coverage_preview(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    hit = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    flagged = p.join(hit.distinct().withColumn("_hit", F.lit(True)), "p_partkey", "left")
    return flagged.agg(F.count_if(F.col("_hit")).alias("with_line"), F.count(F.lit(1)).alias("total"), F.round(text.percent(F.count_if(F.col("_hit")), F.count(F.lit(1))), 6).alias("pct"))


@query("SELECT conv_id, turn, 'T' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS triple_id FROM conversations WHERE role = 'user' UNION ALL SELECT DISTINCT conv_id, CAST(NULL AS BIGINT), 'T0' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def window_numbering(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return ingest.triple_numbers(c.where("role = 'user'").select("conv_id", "turn"), c, "conv_id", "turn").select("conv_id", "turn", "triple_id")


@query("SELECT doc_id, 'A' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS annot_id FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars, doc_id) AS r FROM documents)")
def annotation_ids(spark: SparkSession, d: str) -> DataFrame:
    return ingest.annotation_ids(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars", "doc_id"]).select("doc_id", "annot_id")


@query("SELECT event_type, event_id, count(*) FILTER (value > 10) OVER (PARTITION BY event_type ORDER BY event_id) AS tally FROM events")
def running_tally(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", (F.col("value") > 10).alias("hit"))
    return relational.running_count(e, "tally", F.col("hit"), "event_type", "event_id").select("event_type", "event_id", "tally")


@query("WITH r AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey) SELECT * FROM r")
def first_last_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    a = relational.first_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return a.join(relational.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("SELECT c_custkey AS k, c_name AS label FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_override(spark: SparkSession, d: str) -> DataFrame:
    return relational.override(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("label")), ["k"])


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return relational.missing(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events) UNION ALL SELECT 'bag', count(*) FROM (SELECT o_custkey FROM orders UNION ALL SELECT user_id FROM events)
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id"))
    n = lambda op, df: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionAll(n("bag", a.unionAll(b))).unionAll(n("except", a.subtract(b))).unionAll(n("intersect", a.intersect(b)))


# ---- evaluation, samples, vectors ---------------------------------------------

_PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"""
_RULE = "d.n_chars > 800"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 800).alias("found"))


@query(f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND {_RULE}) AS tp, count(*) FILTER (quality <> 1 AND {_RULE}) AS fp, count(*) FILTER (quality = 1 AND NOT {_RULE}) AS fn FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT tp, fp, fn, {_PRF} FROM c")
def prf_overall(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return evaluate.score_by(j.where("gold"), j.where("found"), j.where("gold and found"), [])


@query(f"WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND {_RULE}) AS tp, count(*) FILTER (quality <> 1 AND {_RULE}) AS fp, count(*) FILTER (quality = 1 AND NOT {_RULE}) AS fn FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang) SELECT lang, tp, fp, fn, {_PRF} FROM c WHERE tp + fp + fn > 0")
def prf_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return evaluate.score_by(j.where("gold"), j.where("found"), j.where("gold and found"), ["lang"])


@query("""WITH g AS (SELECT user_id, bool_and(event_type IN ('view', 'click')) AS none FROM events WHERE event_id % 3 = 0 GROUP BY user_id), f AS (SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS k FROM events WHERE event_id % 3 = 1 GROUP BY user_id)
SELECT count(*) FILTER (coalesce(k, 0) = 0) AS ok, count(*) FILTER (coalesce(k, 0) > 0) AS violated, CAST(coalesce(sum(k), 0) AS BIGINT) AS bogus FROM g LEFT JOIN f ON f.user_id = g.user_id WHERE none""")
def refusal_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda r, quiet: e.where(F.col("event_id") % 3 == r).select("user_id", F.when(F.col("event_type").isin(*quiet), "NONE").otherwise("X").alias("predicate"))
    return evaluate.refusals(side(0, ("view", "click")), side(1, ("view", "click", "error")), "user_id")


@query("SELECT event_type AS predicate, count(*) AS n FROM events WHERE NOT (event_type IN ('view', 'click') AND user_id % 2 = 0) GROUP BY event_type")
def type_violations(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("view", "even", "x"), ("click", "even", "x")], "predicate string, subject_type string, object_type string")
    e = table(spark, d, "events").select(F.col("event_type").alias("predicate"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("subject_type"), F.lit("x").alias("object_type"))
    return evaluate.type_violations(e, pairs)


@query()
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of each brand, one-to-one in order; what is taken depends on what came before, which SQL can't say."""
    p = table(spark, d, "part")
    side = lambda name: p.select(F.col("p_brand").alias("annot_id"), F.lit("P").alias("predicate"), name.alias("subject_name"), F.col("p_name").alias("object_name")).distinct().withColumn("ord", F.xxhash64("subject_name", "object_name"))
    pairs = evaluate.candidate_pairs(side(F.col("p_name")), side(F.concat(F.lower("p_type"), F.lit(" "), "p_name")))
    return evaluate.greedy_match(pairs)


_MD5 = "md5(CAST({0} AS VARCHAR) || ':42')"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format('doc_id')}, doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 25 WHEN 'fr' THEN 20 WHEN 'de' THEN 100000 ELSE 0 END")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 25, "fr": 20, "de": 100000})


@query(f"SELECT doc_id, lang, CASE WHEN r <= greatest(1, CASE WHEN (n * 0.2) - floor(n * 0.2) = 0.5 THEN 2 * round(n * 0.2 / 2) ELSE round(n * 0.2) END) THEN 'test' ELSE 'dev' END AS split FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format('doc_id')}, doc_id) AS r FROM documents)")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_MD5.format('doc_id')}, doc_id LIMIT 50")
def random_fifty(spark: SparkSession, d: str) -> DataFrame:
    return sample.random_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("""WITH c AS (SELECT conv_id, max(role) || min(CAST(length(text) % 3 AS VARCHAR)) AS s, count(*) AS turns FROM conversations GROUP BY conv_id), p AS (SELECT *, list_position(['user0', 'user1', 'user2', 'system0'], s) AS pr FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY turns DESC, conv_id) AS r FROM p WHERE pr > 0 AND turns >= 2), k AS (SELECT conv_id, s, turns FROM b WHERE r = 1 ORDER BY pr LIMIT 5),
f AS (SELECT conv_id, s, turns FROM c WHERE conv_id NOT IN (SELECT conv_id FROM k) ORDER BY conv_id LIMIT 5) SELECT * FROM k UNION ALL SELECT * FROM (SELECT * FROM f ORDER BY conv_id LIMIT (SELECT 5 - count(*) FROM k))""")
def few_shot_pick(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.max("role"), F.min((F.length("text") % 3).cast("string"))).alias("s"), F.count(F.lit(1)).alias("turns"))
    return sample.few_shot(c, "s", "conv_id", "turns", ["user0", "user1", "user2", "system0"])


@query("SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) + 1e-12), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.Embeddings(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return e.most_similar(7, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query, v.vec_id AS id, q.label = v.label AS hit, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-12), 9) AS sim FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s), b AS (SELECT query, min(rank) AS rank FROM r WHERE hit GROUP BY query)
SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS hits_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS hits_at_3, round(avg(CAST(rank <= 10 AS INT)), 6) AS hits_at_10, round(avg(rank), 6) AS mean_rank FROM b""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Stated queries (every id divisible by 20) against all vectors: is one of the same label near the top."""
    e = table(spark, d, "embeddings")
    return vectors.rank_metrics(vectors.label_ranks(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label"))


@query("SELECT vec_id AS entity_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS d{i}" for i in range(64)) + " FROM embeddings")
def embedding_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.embedding_columns(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("SELECT vec_id, len(embedding) * 2 AS dims, " + " || ',' || ".join(f"CAST(CAST(embedding[{i % 64 + 1}] AS DECIMAL(18, 6)) AS VARCHAR)" for i in range(128)) + " AS components FROM embeddings")
def complex_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All components, real parts before imaginary ones (here the same again)."""
    both = vectors.from_complex(F.col("embedding"), F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.size(both).cast("long").alias("dims"), F.array_join(F.transform(both, lambda x: x.cast("decimal(18,6)").cast("string")), ",").alias("components"))


@query("SELECT model, mrr FROM (SELECT CAST(label AS VARCHAR) AS model, round(avg(1.0 / (1 + vec_id)), 9) AS mrr FROM embeddings GROUP BY label) ORDER BY mrr DESC, model LIMIT 1")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("model")).agg(F.round(F.avg(1.0 / (1 + F.col("vec_id"))), 9).alias("mrr"))
    return vectors.best_model(m)


def _sum_sql(term: str, n: int) -> str:
    """In order of the components, as the operators add them up."""
    return "CAST(0 AS DOUBLE) + " + " + ".join("(" + term.format(i=i + 1, j=i + 1 + n) + ")" for i in range(n))


_TRANSE = "(h[{i}] + h[{i}] * 0.5::DOUBLE - t[{i}])"
_TURNED = ("(h[{i}] * cos(h[{i}] * 0.5::DOUBLE) - h[{j}] * sin(h[{i}] * 0.5::DOUBLE) - t[{i}])", "(h[{i}] * sin(h[{i}] * 0.5::DOUBLE) + h[{j}] * cos(h[{i}] * 0.5::DOUBLE) - t[{j}])")


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS h, b.e AS t FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(-sqrt({_sum_sql(f"{_TRANSE} * {_TRANSE}", 64)}), 6) AS transe, round({_sum_sql("h[{i}] * (h[{i}] * 0.5::DOUBLE) * t[{i}]", 64)}, 6) AS distmult, round(-sqrt({_sum_sql(f"{_TURNED[0]} * {_TURNED[0]}", 32)} + {_sum_sql(f"{_TURNED[1]} * {_TURNED[1]}", 32)}), 6) AS rotate FROM p""")
def kge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the three link-prediction models between neighbouring ids."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("t")), "vec_id")
    r = F.transform("h", lambda x: x * 0.5)
    return j.select("vec_id", F.round(vectors.transe(F.col("h"), r, F.col("t")), 6).alias("transe"), F.round(vectors.distmult(F.col("h"), r, F.col("t")), 6).alias("distmult"), F.round(vectors.rotate(F.col("h"), F.slice(r, 1, 32), F.col("t")), 6).alias("rotate"))


@query("""WITH u AS (SELECT user_id, min(event_id) % 5 = 0 AS bad FROM events GROUP BY user_id), v AS (SELECT e.user_id, event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY event_type) AS r FROM events e JOIN u ON u.user_id = e.user_id WHERE NOT bad AND value > 10)
SELECT CAST(user_id AS VARCHAR) AS pmid, 'T' || r AS triple_id, 'CONTAINS' AS predicate, event_type AS object_name FROM v UNION ALL SELECT CAST(user_id AS VARCHAR), 'T0', 'NONE', '-' FROM u WHERE NOT bad AND user_id NOT IN (SELECT user_id FROM v) UNION ALL SELECT CAST(user_id AS VARCHAR), 'ERROR', 'ERROR', '-' FROM u WHERE bad""")
def extraction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows from answers in JSON: numbered triples, T0 for none, ERROR for failures."""
    from ..schema import pair_schema

    e = table(spark, d, "events")
    t = F.struct(F.lit("s").alias("subject_name"), F.when(F.col("value") > 10, "Food").otherwise("Microbe").alias("subject_type"), F.lit("CONTAINS").alias("predicate"), F.col("event_type").alias("object_name"), F.lit("Bioactive").alias("object_type"), F.lit("x").alias("evidence_span"), F.lit("y").alias("evidence_type"), F.lit(0.9).alias("confidence"), F.lit("").alias("notes"))
    results = e.groupBy(F.col("user_id").cast("string").alias("pmid")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(t)).alias("triples"))).alias("answer"), F.min("event_id").alias("m")).withColumn("status", F.when(F.col("m") % 5 == 0, "errored").otherwise("succeeded"))
    return remote.parse_extractions(results, pair_schema(spark)).select("pmid", "triple_id", "predicate", "object_name")
