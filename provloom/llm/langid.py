"""Language identification by interpolated Kneser-Ney character models (operator 2).

One model per language over the letters of words; n-grams stand as hashes in sorted arrays, with the
interpolated probability in every language beside each hash, and the back-off weight beside each
context.  The language of lowest cross-entropy per character is chosen.  Cross-entropies of labelled
texts that the models haven't seen, in their own and in the other languages, calibrate from where on a
text is rejected as none of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, arrow_schema, mix64, slices, with_text

ORDER = 5
#: Bounds of the labelled sample that the models are fitted on: documents of each language, and
#: characters of each language (a document that doesn't fit any more is left out).
TRAIN_DOCS, TRAIN_CHARS = 200, 1_000_000
#: Languages that are learned at most, those with the most documents.
LANGUAGES = 500
#: A text is rejected if its cross-entropy is above the limit of its language, so far on the way from what
#: texts of the language have to what texts of the others have, by more than so many standard deviations.
#: (Half way, one of 20,000 documents in a learned language was rejected, for a long secret in it.)
REJECT_SHARE, REJECT_AT = 0.75, 8.0
#: Words whose scores a worker remembers; the table is emptied beyond that, which changes no result.
REMEMBERED, LONGEST_REMEMBERED = 150_000, 32

_words = regex.compile(r"\p{L}+").findall
_START, _END = 1, 2


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def _grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, hashes of the n-gram and of its context at every predicted character; starts of the words."""
    pad = chr(_START) * (ORDER - 1)
    raw = "".join([pad + w + chr(_END) for w in words])
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    at = np.cumsum(sizes) - sizes
    predicted = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        predicted[at + k] = False
    where = np.flatnonzero(predicted)
    grams, contexts, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        contexts.append(h[where - 1])  # the n-1 characters before
        older = np.zeros(len(codes), np.uint64)
        older[n - 1 :] = codes[: len(codes) - n + 1]
        h = mix64(h ^ mix64(older + np.uint64(n << 32)))
        grams.append(h[where])
    return grams, contexts, np.cumsum(sizes - ORDER + 1) - (sizes - ORDER + 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in a sorted hash array, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModels:
    languages: list[str]
    floor: float = 1e-4
    keys: list[np.ndarray] = field(default_factory=list)
    probability: list[np.ndarray] = field(default_factory=list)  # of each order: keys x languages
    contexts: list[np.ndarray] = field(default_factory=list)
    back_off: list[np.ndarray] = field(default_factory=list)
    #: Of each language: the limit of the cross-entropy, its variance per character and its variance per text.
    calibration: list[tuple[float, float, float]] = field(default_factory=list)

    def score(self, words: list[str]) -> np.ndarray:
        """Sums of -ln p of each word in each language."""
        grams, contexts, starts = _grams(words)
        p = np.full((len(grams[0]), len(self.languages)), self.floor)
        for n in range(ORDER):
            at, there = _find(self.keys[n], grams[n])
            c_at, c_there = _find(self.contexts[n], contexts[n])
            gone = ~there & c_there
            p[gone] *= self.back_off[n][c_at[gone]]
            p[there] = self.probability[n][at[there]]
        return np.add.reduceat(-np.log(p), starts, axis=0)


def fit(samples: dict[str, list[str]]) -> LanguageModels:
    """Models of the languages from bounded lists of texts; each fifth text calibrates."""
    names = sorted(samples)
    model = LanguageModels(names)
    parts = {l: ([t for i, t in enumerate(x) if i % 5 != 4 or len(x) < 10], [t for i, t in enumerate(x) if i % 5 == 4 or len(x) < 10]) for l, x in samples.items()}
    seen = []  # of each language and order: distinct n-grams, counts, contexts and suffixes
    for l in names:
        counts: dict[str, int] = {}
        for t in parts[l][0]:
            for w in words_of(t):
                counts[w] = counts.get(w, 0) + 1
        words = list(counts)
        if not words:
            seen.append([(np.empty(0, np.uint64),) * 4] * ORDER)
            continue
        grams, contexts, starts = _grams(words)
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(words)), np.diff(np.append(starts, len(grams[0]))))
        orders, kept = [], None
        for n in range(ORDER - 1, -1, -1):
            hashes, first, group = np.unique(grams[n], return_index=True, return_inverse=True)
            if kept is None:
                number = np.bincount(group, weights=times).astype(np.int64)  # raw counts at the highest order
            else:
                number = np.bincount(np.searchsorted(hashes, kept), minlength=len(hashes))  # kinds of characters before
            kept = grams[n - 1][first] if n else None
            orders.append((hashes, number, contexts[n][first], grams[n - 1][first] if n else np.zeros(len(first), np.uint64)))
        seen.append(orders[::-1])
    model.floor = 1.0 / (1 + sum(len(s[0][0]) for s in seen) or 1)
    for n in range(ORDER):
        keys, first = np.unique(np.concatenate([s[n][0] for s in seen]), return_index=True)
        context_of = np.concatenate([s[n][2] for s in seen])[first]
        suffix_of = np.concatenate([s[n][3] for s in seen])[first]
        contexts = np.unique(context_of)
        p, lam = np.zeros((len(keys), len(names))), np.ones((len(contexts), len(names)))
        lower = np.full((len(keys), len(names)), model.floor) if n == 0 else model.probability[n - 1][np.searchsorted(model.keys[n - 1], suffix_of)]
        for j, s in enumerate(seen):
            hashes, number, ctx, _ = s[n]
            if not len(hashes):
                p[:, j] = lower[:, j]
                continue
            ones, twos = int((number == 1).sum()), int((number == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(contexts, ctx)
            total, kinds = np.bincount(at, weights=number, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            lam[total > 0, j] = discount * kinds[total > 0] / total[total > 0]
            mine = np.zeros(len(keys))
            mine[np.searchsorted(keys, hashes)] = np.maximum(number - discount, 0)
            c = np.searchsorted(contexts, context_of)
            p[:, j] = mine / np.maximum(total[c], 1) + lam[c, j] * lower[:, j]
        model.keys.append(keys)
        model.probability.append(np.maximum(p, 1e-12).astype(np.float32))
        model.contexts.append(contexts)
        model.back_off.append(lam.astype(np.float32))
    rates: list[list[np.ndarray]] = [[] for _ in names]  # of each language's calibrating texts: the rate in every language
    spread: list[list[float]] = [[] for _ in names]
    sizes: list[list[int]] = [[] for _ in names]
    for j, l in enumerate(names):
        for t in parts[l][1]:
            words = words_of(t)
            if words:
                nll, size = model.score(words), np.array([len(w) + 1 for w in words])
                rates[j].append(nll.sum(axis=0) / size.sum())
                sizes[j].append(int(size.sum()))
                spread[j].append(((nll[:, j] - rates[j][-1][j] * size) ** 2).sum() / size.sum())
    for j in range(len(names)):
        if not rates[j]:
            model.calibration.append((float("inf"), float("inf"), float("inf")))
            continue
        own = np.array([r[j] for r in rates[j]])
        foreign = [r[j] for k, x in enumerate(rates) if k != j for r in x]
        mean, per_char = float(own.mean()), float(np.mean(spread[j]))
        per_text = float(max(1e-4, np.mean((own - mean) ** 2 - per_char / np.array(sizes[j]))))
        model.calibration.append((mean + REJECT_SHARE * (float(np.mean(foreign)) - mean) if foreign else 2 * mean, per_char, per_text))
    return model


class Identifier:
    """Scores texts with remembered words."""

    def __init__(self, model: LanguageModels):
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)), np.float32)
        self.sizes = np.empty(0, np.float32)
        self.stay, self.passing = 0, []  # rows of the table that stay; words whose rows don't

    def learn(self, words: set[str]) -> None:
        """Scores words not seen yet, which then stand in the table; long ones only until the next call."""
        if len(self.place) > REMEMBERED:
            self.place, self.stay = {}, 0
        for w in self.passing:
            self.place.pop(w, None)
        self.scores, self.sizes = self.scores[: self.stay], self.sizes[: self.stay]
        new = [w for w in words if w not in self.place]
        self.passing = [w for w in new if len(w) > LONGEST_REMEMBERED]
        new = [w for w in new if len(w) <= LONGEST_REMEMBERED] + self.passing
        if new:
            self.place.update(zip(new, range(self.stay, self.stay + len(new))))
            self.stay += len(new) - len(self.passing)
            self.scores = np.concatenate((self.scores, self.model.score(new).astype(np.float32)))
            self.sizes = np.concatenate((self.sizes, np.array([len(w) + 1 for w in new], np.float32)))

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy per character and whether the text is rejected."""
        split = [words_of(t) for t in texts]
        if not self.model.languages:
            return [("und", 0.0, None, True)] * len(texts)
        self.learn(set().union(*split))
        out = []
        for words in split:
            if not words:
                out.append(("und", 0.0, None, True))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            n = self.sizes[at].sum(dtype=np.float64)
            rate = self.scores[at].sum(axis=0, dtype=np.float64) / n
            best = int(np.argmin(rate))  # ties: the first language by name
            limit, per_char, per_text = self.model.calibration[best]
            rejected = bool(rate[best] - limit > REJECT_AT * np.sqrt(per_char / n + per_text))
            out.append((self.model.languages[best], float(1 / np.exp(-(rate - rate[best]) * min(n, 50.0)).sum()), float(rate[best]), rejected))
        return out


def train(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> LanguageModels:
    """Fits the models on a bounded sample: the ``max_docs`` documents of each language whose ids have
    the smallest hashes, as long as their texts have ``max_chars`` characters together, of at most
    ``LANGUAGES`` languages.

    Rows without language, text or id aren't used, nor is a text longer than ``max_chars``; of rows that
    share an id and a language only the smallest text is.  The first pass reads ids and languages only
    and finds the hash below which a language has about enough ids, so what comes to the driver is
    bounded, however often an id is repeated.
    """
    known = labelled.where(labelled[id_col].isNotNull() & labelled[lang_col].isNotNull() & labelled[text_col].isNotNull())
    rank = F.shiftrightunsigned(F.xxhash64(known[id_col].cast("string")), 1)
    rows = known.select(known[lang_col].alias("lang"), rank.alias("h"), known[text_col].alias("text"))
    counts = {r["lang"]: r["ids"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("ids")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return LanguageModels([])
    margin = 1.3 * max_docs + 50
    below = F.element_at(F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(2**63 - 1, int(2**63 * (margin / n))))]), F.col("lang"))
    found = rows.where((F.col("h") <= below) & (F.char_length("text") <= max_chars)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    chars: dict[str, int] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        mine = samples.setdefault(r["lang"], [])
        if len(mine) < max_docs and chars.get(r["lang"], 0) + len(r["text"]) <= max_chars:
            mine.append(r["text"])
            chars[r["lang"]] = chars.get(r["lang"], 0) + len(r["text"])
    return fit(samples)


def identify_language(df: DataFrame, model: LanguageModels, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected to ``keep``.

    Narrow, no shuffle; the models are bounded by their training sample and go to the tasks once.
    Null texts and texts without a letter are ``und``, with score 0, and rejected; so is every text
    if there were no labelled rows.  Whole texts are scored.  Ties go to the first language by
    name.  Repeated rows give repeated results, an empty table gives none, other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    source, text_at = with_text(df, keep, text_col)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    out, n_keep = arrow_schema(schema), len(keep)

    def run(batches):
        import pyarrow as pa

        identifier = Identifier(held.value)
        for part in slices(batches, SLICE_ROWS):
            found = identifier.identify(part.column(text_at).to_pylist())
            columns = [part.column(i).cast(out.field(i).type) for i in range(n_keep)]
            columns += [pa.array([f[j] for f in found], type=out.field(n_keep + j).type) for j in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return source.mapInArrow(run, schema)
