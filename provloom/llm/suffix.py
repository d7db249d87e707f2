"""Suffix-array dedup of repeated byte strings with a difference cover (operator 1).

Equal strings of 100 bytes have equal winnowed anchors, so the segments of text around anchors are
dealt out by anchor, and each bucket sorts the suffixes of its segments by itself: the triples at
two of every three places (a difference cover modulo 3) are sorted and named, the sequence of names
is sorted by recursion, the remaining suffixes are merged in, and neighbours in the order are
compared over 100 bytes.  Recursion ends where names stand for 100 bytes.

Segments that no other segment of their anchor differs from are settled before, by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, slices
from .repeats import SLICE, by_bucket, covered, deal, repeated, runs

LENGTH, GRAM = 100, 12

SEGMENT = np.dtype([("h", "u8"), ("doc", "i8"), ("ref", "i4"), ("start", "i4"), ("size", "i2")])


def _bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), np.uint8), begins


def _sorted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of small non-negative keys, first key first, and where rows differ from the one before."""
    width = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(width) <= 63:
        key = np.zeros(len(keys[0]), np.int64)
        for k, w in zip(keys, width):
            key = (key << w) | k
        order = np.argsort(key, kind="stable")
        return order, runs(key[order])
    order = np.lexsort(keys[::-1])
    return order, runs(*(k[order] for k in keys))


def suffix_order(t: np.ndarray, unit: int = 1, depth: int = LENGTH) -> np.ndarray:
    """Starts of the suffixes of ``t`` (numbers from 1) in the order of their first ``depth`` bytes.

    Each number stands for ``unit`` bytes.  Suffixes that agree that far stand together in any order.
    """
    n = len(t)
    s = np.concatenate((t, np.zeros(3, np.int64)))
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    if not len(sample):
        return zero
    order, new = _sorted(s[sample], s[sample + 1], s[sample + 2])
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if 3 * unit < depth and not new.all():
        # Names of the second half follow a 0, so no suffix of the first half runs into them.
        deeper = suffix_order(np.concatenate((name[: len(one)] + 1, [1], name[len(one) :] + 1)), 3 * unit, depth)
        deeper = deeper[deeper != len(one)]
        order = deeper - (deeper > len(one))
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    in_order = sample[order]
    first, _ = _sorted(s[zero], rank[zero + 1])
    zero = zero[first]
    bits = max(1, int(rank.max()).bit_length())
    # A remaining suffix is compared with the sampled ones of either kind by what makes both end in sampled ranks.
    less = np.searchsorted(np.sort((s[one] << bits) | rank[one + 1]), (s[zero] << bits) | rank[zero + 1])
    wide = max(1, int(s.max()).bit_length())
    if 2 * wide + bits <= 63:
        key = lambda i: (((s[i] << wide) | s[i + 1]) << bits) | rank[i + 2]
    else:  # pairs of numbers are named first
        pair_order, pair_new = _sorted(s[:-3], s[1:-2])
        pair = np.zeros(n + 3, np.int64)
        pair[pair_order] = np.cumsum(pair_new)
        key = lambda i: (pair[i] << bits) | rank[i + 2]
    less += np.searchsorted(np.sort(key(two)), key(zero))
    merged = np.argsort(np.concatenate((2 * less, 2 * np.arange(len(in_order)) + 1)), kind="stable")
    return np.concatenate((zero, in_order))[merged]


def later_copies(raw: np.ndarray, begins: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where strings of ``length`` bytes start that start earlier too; ``begins``: of the segments, and the end.

    Strings that leave their segment don't count.
    """
    n = len(raw)
    order = suffix_order(raw.astype(np.int64) + 1, depth=length)
    fits = np.zeros(n, bool)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begins[:-1], 1)
    np.add.at(inside, np.maximum(begins[1:] - length + 1, begins[:-1]), -1)
    fits = np.cumsum(inside[:-1]) > 0
    order = order[fits[order]]
    out = np.zeros(n, bool)
    if len(order) < 2:
        return out
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words[: n - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(order) - 1, bool)
    for o in [*range(0, length - 7, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = words[order[at] + o] == words[order[at + 1] + o]
    edges = np.flatnonzero(np.concatenate(([True], ~same)))
    first = np.repeat(np.minimum.reduceat(order, edges), np.diff(np.append(edges, len(order))))
    out[order[order != first]] = True
    return out


_BLOCK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("raw", T.BinaryType())])
_SPAN = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ref", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some stretches, one stretch after the other."""
    ahead = np.cumsum(sizes) - sizes
    return np.repeat(starts - ahead, sizes) + np.arange(sizes.sum())


def _look(docs: DataFrame, buckets: int) -> DataFrame:
    out, made = arrow_schema(_BLOCK), arrow_schema(_SPAN)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            raw, begins = _bytes(part.column("text").to_pylist())
            spans = part.column("spans").to_pylist()
            counts = [len(s) for s in spans]
            of = np.repeat(np.arange(len(spans)), counts)
            flat = [x for s in spans for x in s]
            rows = np.zeros(len(flat), SEGMENT)
            rows["doc"] = part.column("doc").to_numpy(zero_copy_only=False)[of]
            rows["ref"] = part.column("ref").to_numpy(zero_copy_only=False)[of]
            rows["start"], rows["size"] = [x["start"] for x in flat], [x["size"] for x in flat]
            rows["h"] = np.array([x["h"] for x in flat], np.int64).view(np.uint64)
            text_at = {}
            for i, (d, r) in enumerate(zip(part.column("doc").to_pylist(), part.column("ref").to_pylist())):
                text_at[d, r] = begins[i]
            dealt = list(deal(rows, buckets))
            pieces = [raw[_stretches(np.array([text_at[k] for k in zip(b["doc"].tolist(), b["ref"].tolist())]) + b["start"], b["size"].astype(np.int64))] for _, b in dealt]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int64()), pa.array([b.tobytes() for _, b in dealt], pa.binary()), pa.array([p.tobytes() for p in pieces], pa.binary())], schema=out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            rows = np.frombuffer(b"".join(b for b, _ in held), SEGMENT)
            raw = np.frombuffer(b"".join(r for _, r in held), np.uint8)
            sizes = rows["size"].astype(np.int64)
            at = np.cumsum(sizes) - sizes
            # In the order of documents, so that earlier means at a smaller place; a repeated row once.
            order = np.lexsort((rows["start"], rows["ref"], rows["doc"]))
            order = order[runs(rows["doc"][order], rows["ref"][order], rows["start"][order])]
            raw = raw[_stretches(at[order], sizes[order])]
            rows, sizes = rows[order], sizes[order]
            begins = np.concatenate(([0], np.cumsum(sizes)))
            later = later_copies(raw, begins).astype(np.int8)
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[:-1] = later
            edge[1:] -= later
            segment_of = lambda p: np.searchsorted(begins, p, side="right") - 1
            # The last LENGTH - 1 places of a segment start no string, so a run stays in its segment.
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            i = segment_of(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["doc"][i])), pa.array(np.ascontiguousarray(rows["ref"][i])), pa.array((rows["start"][i] + s - begins[i]).astype("i4")), pa.array((e - s + LENGTH - 1).astype("i4"))], schema=made)

    return docs.mapInArrow(send, _BLOCK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, _SPAN)


def dedup_suffixes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Takes out of each text the bytes of 100-byte strings that start earlier too.

    Earlier: in a document of a smaller id, or further ahead in the same text; overlaps count.
    ``id_col`` is of an integer type.  Returns it and n_bytes, n_removed, spans (maximal removed runs,
    as start and end in bytes) and kept (the bytes left; null for a null text), one row per input
    row.  Strings are judged on the input and never cross documents.

    Null and empty texts have no bytes.  Rows that share an id are ordered by a hash of their text;
    fully repeated rows count as one and get its result each.  A row with a null id keeps all.  Whole
    texts are read.  An empty table gives none; other columns are not read.
    """
    docs, spans = repeated(df, id_col, text_col, _bytes, LENGTH, GRAM, True, _look, "suffix")
    joined = docs.join(spans, ["doc", "ref"], "left")
    places = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", places), T.StructField("kept", T.BinaryType())])
    out = arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, text, found in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                gone = covered(found, len(raw)) if found else np.zeros(0, bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if edge else raw
                rows.append((doc, len(raw), int(gone.sum()), [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])], None if text is None else kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], out.field(i).type) for i in range(len(out))], schema=out)

    return joined.mapInArrow(apply, schema).withColumnRenamed("doc", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col(id_col).alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
