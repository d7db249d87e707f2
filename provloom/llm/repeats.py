"""What operators on repeated passages share: winnowed anchors, their segments, and how they meet.

A text is a sequence of units (bytes or words).  Every window of ``window`` units has an anchor: the
gram of ``gram`` units in it with the smallest hash, the last one on ties.  Windows that are equal
have equal anchors at equal places, and the half of the window before the anchor or the half after it
is whole, so they meet by the anchor together with that half: a phrase that very many texts have in
different surroundings gathers none of them.  The windows of one anchor occurrence and half are
neighbours; what they cover is its segment.

Anchors travel packed, a block for each bucket and slice of texts, so Spark moves few, large rows.
Of equal segments that a task meets only the first goes to their bucket, the others are known to be
repeats; so a passage that a third of all texts have sends about one row a task.  In a bucket,
occurrences whose whole segments are equal are settled at once: all but the first are repeats.  Only
the first occurrences of anchors that have several different segments need a closer look, which the
operators bring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, PIECE, _Powers, arrow_schema, bounded_batches, cut, mix64, slices

SLICE = 512
#: Bytes of text whose anchors make up about one bucket.
BUCKET_BYTES = 4 << 20

#: Segments that a task remembers; the table is emptied beyond that, which changes no result.
REMEMBERED = 200_000

#: A packed anchor occurrence: hash of the anchor with its half, segment hash, document, hash of its
#: text, start and length of the segment, and the anchor's place in it.
ANCHOR = np.dtype([("h", "u8"), ("c", "u8"), ("doc", "i8"), ("ref", "i4"), ("start", "i4"), ("size", "i2"), ("at", "i2")])


class Hasher:
    """Hashes of any stretches of a sequence of units, from prefix sums."""

    def __init__(self, units: np.ndarray):
        self.up, self.down = _Powers.upto(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(((self.sums[end] - self.sums[start]) * self.down[start]) ^ (end - start).astype(np.uint64))


def segments(units: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor occurrences (h, c, start, size, at; start in the whole sequence) and the text of each.

    ``units``: hashes, or bytes, which stand for theirs; ``begins``: where the units of each text begin,
    and the end.  Long texts go through in pieces, which share no window.
    """
    if len(units) <= 2 * PIECE:
        return _segments(units, begins, window, gram)
    found, text = [], []
    for i, (s, e) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        for at in range(s, e - window + 1, PIECE):
            end = min(e, at + PIECE + window - 1)
            rows, _ = _segments(units[at:end], np.array([0, end - at]), window, gram)
            rows["start"] += at
            found.append(rows)
            text.append(np.full(len(rows), i))
    return np.concatenate([np.empty(0, ANCHOR), *found]), np.concatenate([np.empty(0, np.int64), *text])


def _segments(units: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(units) - window + 1
    if n <= 0:
        return np.empty(0, ANCHOR), np.empty(0, np.int64)
    hasher = Hasher(_BYTE[units] if units.dtype == np.uint8 else units)
    place = np.arange(len(units) - gram + 1)
    grams = mix64((hasher.sums[gram:] - hasher.sums[:-gram]) * hasher.down[: len(place)])
    low = np.uint64((1 << 24) - 1)
    # The place in the low bits, falling, makes the last of equal grams the smallest.
    packed = (grams & ~low) | (low - (place.astype(np.uint64) & low))
    width, least = 1, packed
    while width * 2 <= window - gram + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = window - gram + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:n]
    inside = np.arange(n) + window <= begins[text + 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [n])) - 1
    whole = inside[first]  # the windows of a run are all inside their text or end past it, but for the last run
    first, last = first[whole], np.minimum(last[whole], begins[text[first[whole]] + 1] - window)
    anchor = first + ((low - (least[first] & low) - first.astype(np.uint64)) & low).astype(np.int64)
    half, made = (window - gram) // 2, []
    for side, (s, e) in enumerate(((first, np.minimum(last, anchor - half)), (np.maximum(first, anchor - half + 1), last))):
        has = s <= e
        s, e, a = s[has], e[has], anchor[has]
        out = np.empty(len(s), ANCHOR)
        stretch = (a - half, a + gram) if side == 0 else (a, a + gram + half)
        out["h"] = mix64(hasher.of(*stretch) ^ np.uint64(side))
        out["at"] = a - s
        out["start"], out["size"] = s, e + window - s
        out["c"] = mix64(hasher.of(s, e + window) ^ (a - s).astype(np.uint64))
        made.append((out, text[s]))
    return np.concatenate([m for m, _ in made]), np.concatenate([t for _, t in made])


Units = Callable[[list], tuple[np.ndarray, np.ndarray]]


def buckets_for(df: DataFrame, text_col: str) -> int:
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(16, -(-size // BUCKET_BYTES))


def deal(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with a field ``h`` by bucket."""
    bucket = (mix64(rows["h"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(rows) else []
    for s, e in zip(edges, [*edges[1:], len(rows)]):
        yield int(bucket[s]), rows[s:e]


_BLOCK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.BinaryType())])


class Combiner:
    """Splits the anchors of a task into those that go to their bucket and those known to repeat an earlier one.

    A segment that a slice has several times is remembered with its first place; later ones are
    compared with it.  Places are in the order of documents, not of arrival, so nothing is taken for a
    repeat that isn't.
    """

    def __init__(self, within: bool):
        self.within = within
        self.seen: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.numbers = np.empty(0, np.uint64)

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = mix64(rows["h"] ^ mix64(rows["c"]))
        order = np.argsort(number, kind="stable")
        new = runs(number[order])
        count = np.diff(np.append(np.flatnonzero(new), len(rows)))
        often = np.zeros(len(rows), bool)
        often[order] = np.repeat(count > 1, count)
        if len(self.numbers):
            at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
            often |= self.numbers[at] == number
        some = rows[often]
        if not len(some):
            return rows, some
        some = some[np.lexsort((some["start"], some["ref"], some["doc"], some["c"], some["h"]))]
        new = runs(some["h"], some["c"])
        heads = np.flatnonzero(new)
        first = some[["doc", "ref", "start"]][heads]
        if len(self.seen) + len(heads) > REMEMBERED:
            self.seen = {}
        for i, (key, place) in enumerate(zip(some[["h", "c"]][heads].tolist(), first.tolist())):
            known = self.seen.get(key)
            if known is not None and known < place:
                first[i] = known
            else:
                self.seen[key] = place
        self.numbers = np.sort(mix64(np.array([k[0] for k in self.seen], np.uint64) ^ mix64(np.array([k[1] for k in self.seen], np.uint64))))
        first = first[np.cumsum(new) - 1]
        repeat = some["doc"] != first["doc"]
        if self.within:
            repeat |= (some["ref"] != first["ref"]) | (some["start"] != first["start"])
        return np.concatenate((rows[~often], some[~repeat])), some[repeat]


def anchor_blocks(docs: DataFrame, units: Units, window: int, gram: int, buckets: int, within: bool) -> DataFrame:
    """(bucket, block of packed anchors) of documents (doc, ref, text); buckets below 0 hold known repeats."""
    out = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(within)
        for part in slices(batches, SLICE):
            values, begins = units(part.column(2).to_pylist())
            found, text = segments(values, begins, window, gram)
            found["doc"] = part.column(0).to_numpy(zero_copy_only=False)[text]
            found["ref"] = part.column(1).to_numpy(zero_copy_only=False)[text]
            found["start"] -= begins[text].astype("i4")
            found, repeats = combiner.split(found)
            dealt = list(deal(found, buckets))
            if len(repeats):
                dealt.append((-1 - int(repeats["doc"][0]) % buckets, repeats))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int64()), pa.array([r.tobytes() for _, r in dealt], pa.binary())], schema=out)

    return docs.select("doc", "ref", "text").mapInArrow(run, _BLOCK)


def by_bucket(batches: Iterator[pa.RecordBatch], passing: bool = False) -> Iterator[list]:
    """The blocks of each bucket (tuples, if there are several to a row); rows of a bucket stand together.

    ``passing``: blocks of buckets below 0 come one by one, each in a list after None.
    """
    now, held = None, []
    for part in slices(batches, 256):
        for bucket, *block in zip(*(c.to_pylist() for c in part.columns)):
            if passing and bucket < 0:
                yield [None, block[0]]
                continue
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(block[0] if len(block) == 1 else tuple(block))
    if held:
        yield held


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


SPAN = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ref", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("closer", T.BooleanType())])


def settle(blocks: DataFrame, within: bool) -> DataFrame:
    """Segments that repeat an earlier equal one, and those that need a closer look (``closer``).

    ``within``: an earlier start in the same document counts as earlier; else only smaller documents do.
    """
    out = arrow_schema(SPAN)

    def made(rows: np.ndarray, closer: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])).cast(out.field(c).type) for c in ("doc", "ref", "start", "size", "at")] + [pa.array(np.ascontiguousarray(rows["h"]).view("i8")), pa.array(closer)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches, passing=True):
            if held[0] is None:
                rows = np.frombuffer(held[1], ANCHOR)
                yield made(rows, np.zeros(len(rows), bool))
                continue
            rows = np.frombuffer(b"".join(held), ANCHOR)
            rows = rows[np.argsort(rows["h"], kind="stable")]
            new = runs(rows["h"])
            counts = np.diff(np.append(np.flatnonzero(new), len(rows)))
            rows = rows[np.repeat(counts > 1, counts)]
            rows = rows[np.lexsort((rows["start"], rows["ref"], rows["doc"], rows["c"], rows["h"]))]
            if not len(rows):
                continue
            new_h, new_c = runs(rows["h"]), runs(rows["h"], rows["c"])
            first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
            repeat = rows["doc"] != rows["doc"][first]
            if within:  # a fully repeated row isn't later than itself
                repeat |= (rows["ref"] != rows["ref"][first]) | (rows["start"] != rows["start"][first])
            edges = np.flatnonzero(new_h)
            several = np.add.reduceat(new_c, edges) > 1
            if not within:
                several &= np.minimum.reduceat(rows["doc"], edges) != np.maximum.reduceat(rows["doc"], edges)
            closer = several[np.cumsum(new_h) - 1] & ~repeat
            keep = repeat | closer
            yield made(rows[keep], closer[keep])

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPAN)


def spans_of(settled: DataFrame, closer: bool) -> DataFrame:
    """(doc, ref, spans): the segments of each text; no more than the text has anchors."""
    fields = ["start", "size", "at", "h"] if closer else ["start", "size"]
    return settled.where("closer" if closer else "not closer").groupBy("doc", "ref").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def repeated(
    df: DataFrame, id_col: str, text_col: str, units: Units, window: int, gram: int, within: bool, look: Callable[[DataFrame, int], DataFrame], label: str
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, ref, text) and the stretches (doc, ref, spans) of theirs that repeat earlier ones.

    ``look(documents with spans, buckets)`` takes the closer look and returns (doc, ref, start, size).
    Rows with a null id take no part: they are neither earlier nor later than any.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc"), F.hash(df[text_col].cast("string")).alias("ref"), df[text_col].cast("string").alias("text"))
    buckets = buckets_for(docs, "text")
    known = docs.where("doc is not null")
    settled = cut(settle(anchor_blocks(known, units, window, gram, buckets, within), within), f"{label}-settled")
    closer = cut(look(known.join(spans_of(settled, True), ["doc", "ref"]), buckets), f"{label}-closer")
    both = settled.where("not closer").select("doc", "ref", "start", "size").unionByName(closer)
    return docs, both.groupBy("doc", "ref").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n units some spans (start, size) cover."""
    if not spans:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    s = np.array([x["start"] for x in spans])
    e = s + np.array([x["size"] for x in spans])
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0
