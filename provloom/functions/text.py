"""Names, labels and taxa as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter names, words dropped at the start, aliases of diseases.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
LEADING = ("the", "a", "an")
DISEASES = {
    "uc": "ulcerative colitis",
    "cd": "crohn s disease",
    "ibd": "inflammatory bowel disease",
    "ibs": "irritable bowel syndrome",
    "crohn disease": "crohn s disease",
    "crohns disease": "crohn s disease",
}

_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, _EDGE, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; none for an empty string."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def clean(c: Column) -> Column:
    """A field without carriage returns and outer white space; '' for null."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("")))


def split_list(c: Column, sep: str = "|") -> Column:
    """The non-empty parts of a joined list."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"\\Q{sep}\\E"), lambda x: x != "")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_name(c: Column, aliases: dict[str, str] = DISEASES) -> Column:
    """The form in which names are compared; '' for null, '' and '-'.

    Lower case, Greek letters by name, underscores and punctuation but hyphens as spaces, leading
    articles dropped, disease abbreviations resolved.
    """
    spell = lambda low: F.when(low.rlike("[α-ω]"), reduce(lambda s, g: F.replace(s, F.lit(g), F.lit(GREEK[g])), GREEK, low)).otherwise(low)
    spelled = once(strip(F.lower(c)), spell)
    plain = squeeze(F.regexp_replace(F.replace(spelled, F.lit("_"), F.lit(" ")), r"(?U)[^\w\s-]", " "))
    bare = F.regexp_replace(plain, f"^(?:(?:{'|'.join(LEADING)})(?: |$))+", "")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.when(c.isNull() | (c == "-"), F.lit("")).otherwise(once(bare, lambda name: F.coalesce(F.element_at(known, name), name)))


def singular(name: Column) -> Column:
    return F.when(name.endswith("s") & (F.length(name) > 3), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def name_variants(name: Column) -> Column:
    """A normalised name and its other number: without a final s, or with one; none for ''."""
    other = F.when(name.endswith("s") & (F.length(name) > 3), singular(name)).otherwise(F.concat(name, F.lit("s")))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name, other))


def names_match(a: Column, b: Column) -> Column:
    """Whether two normalised names are the same thing.

    Equal, equal in the singular, one within the other (over 4 letters; as they are or in the
    singular), or 0.6 of all their words shared.  Empty names match nothing.
    """
    sa, sb = singular(a), singular(b)
    within = lambda x, y: (F.length(x) > 4) & F.contains(y, x)
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    overlap = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return (a != "") & (b != "") & ((a == b) | (sa == sb) | within(a, b) | within(b, a) | within(sa, sb) | within(sb, sa) | (overlap >= 0.6))


def ontology_form(c: Column) -> Column:
    """Lower case, without brackets and quotes, white space collapsed; '' for null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"[()\[\]'\"]", ""), r"(?U)\s+", " "), F.lit(""))


def loose_form(c: Column) -> Column:
    """Lower case, all punctuation as spaces."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def first_token(c: Column) -> Column:
    """The ASCII letters of the first word, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(F.get(tokens(c), 0), F.lit("")), "[^a-zA-Z]", ""))


def has_strain_code(c: Column) -> Column:
    """A word of 4 or more characters with two capitals and a digit."""
    bare = F.transform(tokens(c), lambda t: F.regexp_replace(t, r"^[()\[\],.;:]+|[()\[\],.;:]+$", ""))
    count = lambda t, kind: F.length(F.regexp_replace(t, f"[^{kind}]", ""))
    return F.exists(bare, lambda t: (F.length(t) >= 4) & (count(t, r"\p{Lu}") >= 2) & (count(t, r"\p{Nd}") >= 1))


# Genera, words of products, words and endings of compounds.
GENERA = (
    "lactobacillus", "bifidobacterium", "bacteroides", "escherichia", "clostridium", "clostridioides", "faecalibacterium", "akkermansia",
    "roseburia", "prevotella", "streptococcus", "enterococcus", "ruminococcus", "eubacterium", "blautia", "lactococcus", "saccharomyces",
    "fusobacterium", "klebsiella", "proteus", "salmonella", "shigella", "helicobacter", "campylobacter", "veillonella", "parabacteroides",
    "alistipes", "coprococcus", "dorea", "collinsella", "odoribacter", "bilophila", "desulfovibrio", "pediococcus", "leuconostoc", "weissella",
    "enterobacter", "citrobacter", "pseudomonas", "staphylococcus", "bacillus", "anaerostipes", "butyrivibrio", "megamonas", "megasphaera",
    "sutterella", "oscillospira", "christensenella", "subdoligranulum", "intestinimonas", "holdemania", "turicibacter", "lachnospira",
    "phascolarctobacterium", "anaerobutyricum", "agathobacter",
)
PRODUCTS = (
    "milk", "extract", "juice", "powder", "oil", "supplement", "fermented", "synbiotic", "yogurt", "yoghurt", "cheese", "product", "drink", "broth",
    "diet", "kefir", "tea", "soup", "bread", "flour", "paste", "sauce",
)
COMPOUND_WORDS = (
    "acid", "polyphenol", "flavonoid", "polysaccharide", "peptide", "glycoside", "saponin", "alkaloid", "terpene", "sterol", "catechin",
    "carotenoid", "anthocyanin", "metabolite",
)
COMPOUND_ENDINGS = ("ose", "ol", "ide", "ate")
_GREEK_CLASS = "[αβγδεζηθικλμνξοπρστυφχψω]"


def _flags(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def microbe_flags(label: Column, genus: Column | None = None) -> Column:
    """Which signs of a microbe a label shows; ``genus``: whether its first word is a known genus."""
    low = F.lower(label)
    return _flags(
        ("genus", genus if genus is not None else first_token(label).isin(*GENERA)),
        ("strain_code", has_strain_code(label)),
        ("consortium/sp.", F.contains(low, F.lit("consortium")) | low.rlike(r"(?U)\bsp\.?\b|\bspp\.?\b")),
    )


def compound_flags(label: Column) -> Column:
    """Which signs of a chemical compound a label shows."""
    low = F.lower(label)
    last = F.regexp_replace(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), tokens(low)), -1), F.lit("")), "[^a-z]", "")
    ending = reduce(lambda x, y: x | y, [last.endswith(e) for e in COMPOUND_ENDINGS])
    return _flags(
        ("greek_letter", label.rlike(_GREEK_CLASS)),
        ("compound_keyword", low.rlike("|".join(COMPOUND_WORDS))),
        ("iupac_pattern", label.rlike(r"(?i)\d[,\-]\d|\(\s*[rs]\s*\)\s*-")),
        ("chemical_suffix", (F.length(last) >= 5) & ending),
    )


def triage_bucket(label: Column, type_: Column, microbe: Column, compound: Column) -> Column:
    """Where a literature node goes for review, from its label, type and flags; null if nowhere."""
    words = tokens(F.lower(label))
    product = F.exists(words, lambda w: w.isin(*PRODUCTS))
    sure = F.array_contains(microbe, "genus") & (F.size(words) <= 5) & ~product
    return (
        F.when((F.size(microbe) > 0) & (type_ != "Microbe"), F.when(sure, F.lit("high_confidence_microbe")).otherwise(F.lit("medium_microbe")))
        .when(label.rlike(r"(?iU)\bdiet\b|\bdietary pattern\b") & (type_ == "Food"), F.lit("dietary_pattern"))
        .when((F.size(compound) > 0) & (type_ == "Food"), F.lit("compound_candidate"))
    )


# Words that place an abstract in a stratum.
BIOACTIVE_WORDS = ("butyrate", "short-chain fatty acid", "scfa", "tryptophan", "bile acid", "indole", "polyphenol", "omega-3", "fiber")
MICROBE_WORDS = ("faecalibacterium", "akkermansia", "roseburia", "bacteroides", "lactobacillus", "bifidobacterium")
STRATA = ("diet_microbiome_ibd", "microbe_ibd", "bioactive_ibd", "off_scope", "general", "reviews")


def stratum(title: Column, abstract: Column, mesh: Column, publication_types: Column) -> Column:
    """One of six strata of an abstract, by its subject headings, publication types and words."""
    empty = F.array().cast("array<string>")
    text = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(abstract, F.lit(""))))
    mesh, kinds = F.coalesce(mesh, empty), F.coalesce(publication_types, empty)
    any_word = lambda words: reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])
    any_term = lambda terms: F.arrays_overlap(mesh, F.array(*[F.lit(t) for t in terms]))
    microbiome = any_term(["Gastrointestinal Microbiome"]) | any_word(["microbiom", "microbiota"])
    ibd = any_term(["Inflammatory Bowel Diseases", "Crohn Disease", "Colitis, Ulcerative"]) | any_word(["crohn", "ulcerative colitis"])
    diet = any_term(["Diet"]) | any_word(["diet", "nutrition", "food"])
    bioactive, microbe = any_word(BIOACTIVE_WORDS), any_word(MICROBE_WORDS)
    return (
        F.when(F.arrays_overlap(kinds, F.array(F.lit("Review"), F.lit("Systematic Review"))), F.lit("reviews"))
        .when(~(microbiome | bioactive | microbe) & ibd, F.lit("off_scope"))
        .when(diet & microbiome & ibd, F.lit("diet_microbiome_ibd"))
        .when(microbe & ibd, F.lit("microbe_ibd"))
        .when(bioactive & ibd, F.lit("bioactive_ibd"))
        .otherwise(F.lit("general"))
    )


# Prefixes of ranks in a lineage, from the most specific.
RANKS = (("s__", "species"), ("g__", "genus"), ("f__", "family"), ("o__", "order"), ("c__", "class"), ("p__", "phylum"), ("k__", "kingdom"))


def most_specific_taxon(lineage: Column) -> Column:
    """(name, rank) of the most specific rank of a dotted lineage that has a name; null if none has."""
    parts = F.split(lineage, r"\.")

    def at(prefix: str, rank: str) -> Column:
        names = F.transform(F.filter(parts, lambda p: p.startswith(prefix)), lambda p: strip(F.substring(p, F.lit(len(prefix) + 1), F.length(p))))
        named = F.filter(names, lambda n: (n != "") & ~F.contains(F.lower(n), F.lit("unclassified")) & (n != "NA"))
        first = F.get(named, 0)
        return F.when(first.isNotNull(), F.struct(F.replace(first, F.lit("_"), F.lit(" ")).alias("name"), F.lit(rank).alias("rank")))

    return F.coalesce(*[at(p, r) for p, r in RANKS])


def food_name(c: Column) -> Column:
    """A food's column name as words: no group_ prefix, underscores as spaces, lf as low-fat."""
    bare = F.regexp_replace(strip(c), "^group_", "")
    return F.regexp_replace(F.regexp_replace(strip(F.replace(bare, F.lit("_"), F.lit(" "))), r"(?U)\blf\b", "low-fat"), r"(?U)\s+", " ")


# First words of foods that look like a species name.
NOT_GENERA = ("common", "wheat", "food", "rice", "corn", "white", "whole", "ground", "fresh", "raw")


def is_binomial(c: Column) -> Column:
    """Whether a label reads like a species name: a capitalised word of letters, then a lower-case one."""
    shape = c.rlike(r"(?U)^\s*\p{Lu}\p{L}*\s+\p{Ll}[\p{L}-]*(\s|$)")
    return F.coalesce(shape & ~F.lower(F.get(tokens(c), 0)).isin(*NOT_GENERA), F.lit(False))


def mint_cluster_id(c: Column, prefix: str, limit: int = 80) -> Column:
    return F.concat(F.lit(prefix), F.left(F.translate(c, " /", "__"), F.lit(limit)))


def mint_literature_id(normalized: Column, limit: int = 80) -> Column:
    return F.concat(F.lit("LLM:"), F.left(F.replace(normalized, F.lit(" "), F.lit("_")), F.lit(limit)))


def rehomed_predicate(old: Column, new: str = "produces") -> Column:
    """The new predicate in the case of the old one."""
    return F.when(old == F.upper(old), F.lit(new.upper())).otherwise(F.lit(new))
