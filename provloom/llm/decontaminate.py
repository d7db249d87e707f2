"""Benchmark decontamination with an FM-index per shard of training texts (operator 4).

Words of a shard that no benchmark item has can't be in a match, so stretches between them that are
too short for any phrase are left out; the FM-index is built over the rest.  Benchmark phrases are
searched backward, all of one length at a time, their occurrences are located by sampled suffix
positions, and overlapping ones are merged into removal spans.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, folded_words, scratch, slices, with_text
from .fmindex import FMIndex

WINDOW = 13
#: Texts of one FM-index, and the bytes of benchmark text that go to the tasks at one time: 2 MiB take
#: about 160 MB as phrases, in the driver and in a worker.  Larger benchmarks are searched in blocks,
#: one after the other.
SHARD_ROWS = 512
BLOCK_BYTES = 2 << 20


class Phrases:
    """The distinct windows of the items of a block: word numbers from 1, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in folded_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = [(n, np.array(p, np.int64), [found[x] for x in p]) for n, p in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str | None]]]:
    """For each text: its number of words, merged spans of hit words (end exclusive), items found."""
    number = phrases.number.get
    ids, lengths = [], []
    for text in texts:
        words = folded_words(text)
        ids.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
        lengths.append(len(words))
    out: list[tuple[int, list, set]] = [(n, [], set()) for n in lengths]
    if not phrases.shortest or not sum(lengths):
        return out
    # A separator after each text keeps matches within it.
    flat = np.concatenate([x for i in ids for x in (i, [0])])
    first = np.concatenate(([0], np.cumsum(np.array(lengths) + 1)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (flat > 0).astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1  # of each stretch in the indexed sequence
    sequence = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    inside = np.repeat(at - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    sequence[inside] = flat[np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
    index = FMIndex(sequence, len(phrases.number))
    for length, patterns, items in phrases.groups:
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        counts = (hi - lo)[hit]
        rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        which = np.repeat(hit, counts)
        place = index.locate(rows)
        stretch = np.searchsorted(at, place, side="right") - 1
        position = starts[stretch] + place - at[stretch]
        text_no = np.searchsorted(first, position, side="right") - 1
        for p, t, w in zip((position - first[text_no]).tolist(), text_no.tolist(), which.tolist()):
            out[t][1].append((p, p + length))
            out[t][2].update(items[w])
    return [(n, merge(spans), found) for n, spans, found in out]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = (T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType())))


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Occurrences of benchmark windows in each text.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer.
    Returns ``keep`` (by default ``id_col``) and n_words, n_hit (words inside any occurrence),
    spans (merged runs of hit words, end exclusive), items (ids as strings, sorted, of items with
    an occurring window; null ids aren't listed) and contaminated (n_hit > 0 and 20 * n_hit >=
    n_words), one row per input row.  The benchmark's size is measured first.  One that fits in
    ``block_bytes`` is searched in one narrow pass, without shuffle.  A larger one is searched block
    by block: each pass writes what it found before the next block is made, so driver and workers
    hold one block at a time; texts are written once, and only hits are joined (an item longer than
    a block is a block by itself).

    Null and empty texts have no words; items without words have no window.  Texts are searched
    whole.  Repeated rows and items count once each where they stand; an empty benchmark gives no
    hits and an empty table no rows.  Other columns are not read unless kept.
    """
    keep = keep or [id_col]
    wanted = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows, text_at = with_text(df, keep, text_col)

    def block(number: int) -> Phrases:
        some = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        return Phrases([(r["item"], r["text"]) for r in some], window)

    if blocks == 1:
        found = _pass(rows, text_at, block(0))[0]
    else:
        with scratch(df.sparkSession) as kept:
            rows = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "contamination-rows")
            hits = []
            for number in range(blocks):
                found, held = _pass(rows.select("_row", rows.columns[text_at]), 1, block(number))
                hits.append(cut(found.where(F.lit(number == 0) | (F.size("spans") > 0)).select("_row", "n_words", "spans", "items"), "contamination-hits"))
                held.destroy()
            every = functools.reduce(DataFrame.unionAll, hits).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
            found = kept(_merged(every), "contamination-found")
        found = rows.join(found, "_row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_words", n_hit.alias("n_hit"), "spans", "items").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _pass(df: DataFrame, text_at: int, phrases: Phrases) -> tuple[DataFrame, Broadcast]:
    """Adds n_words, spans and items of one block of the benchmark (a text that isn't kept goes); and what it broadcasts."""
    held = df.sparkSession.sparkContext.broadcast(phrases)
    same = [i for i, f in enumerate(df.schema) if f.name != "_t"]
    schema = T.StructType([*[df.schema[i] for i in same], *_FOUND])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SHARD_ROWS):
            found = search_shard(part.column(text_at).to_pylist(), held.value)
            spans = [[{"start": s, "end": e} for s, e in x] for _, x, _ in found]
            items = [sorted(i for i in x if i is not None) for _, _, x in found]
            columns = [part.column(i).cast(out.field(k).type) for k, i in enumerate(same)]
            columns += [pa.array(v, type=out.field(len(same) + j).type) for j, v in enumerate(([n for n, _, _ in found], spans, items))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema), held


def _merged(df: DataFrame) -> DataFrame:
    """Rows (_row, n_words, spans, items) of several blocks with spans merged and items once, in order."""
    out = arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = [[{"start": s, "end": e} for s, e in merge([(x["start"], x["end"]) for x in found])] for found in part.column(2).to_pylist()]
            items = [sorted(set(found)) for found in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, out.field(2).type), pa.array(items, out.field(3).type)], schema=out)

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
