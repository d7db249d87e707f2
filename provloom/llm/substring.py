"""Substring dedup by seed and extend (operator 6).

Seeds are winnowed anchors of three words with the five before or after them.  Where documents share a seed, the match is extended word
by word to the left and to the right; a match that grows to the whole window length is a repeat, and
repeats that overlap or touch grow together to maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, slices, space_words, word_hashes
from .repeats import _BLOCK, SLICE, by_bucket, covered, deal, repeated

WINDOW, GRAM = 13, 3
_REACH = WINDOW - GRAM  # words that a match can need on one side

#: A seed with the words around it; 0 where its segment ends.
SEED = np.dtype([("h", "u8"), ("doc", "i8"), ("ref", "i4"), ("start", "i4"), ("size", "i2"), ("at", "i2"), ("left", "u8", (_REACH,)), ("right", "u8", (_REACH,))])


def _units(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, fold=False)


def extend(seeds: np.ndarray) -> list[tuple[int, int]]:
    """(seed, words to the left) of each window that a document of smaller number has too.

    Occurrences get a class for each length of extension to the left and to the right: equal classes
    are equal extensions.  A window is an extension to the left and one to the right.
    """
    n = len(seeds)
    classes = {"left": [], "right": []}
    for side, held in classes.items():
        now = np.unique(seeds["h"], return_inverse=True)[1]
        held.append(now)
        for k in range(_REACH):
            pair = np.empty(n, [("a", "i8"), ("b", "u8")])
            pair["a"], pair["b"] = now, seeds[side][:, k]
            order = np.lexsort((pair["b"], pair["a"]))
            number = np.cumsum(np.concatenate(([0], (pair["a"][order][1:] != pair["a"][order][:-1]) | (pair["b"][order][1:] != pair["b"][order][:-1]))))
            now = np.empty(n, np.int64)
            now[order] = number
            held.append(now)
    found = []
    for to_left in range(_REACH + 1):
        # The window begins ``to_left`` words before the seed and has to lie in the segment.
        start = seeds["at"].astype(np.int64) - to_left
        has = np.flatnonzero((start >= 0) & (start + WINDOW <= seeds["size"]))
        if len(has) < 2:
            continue
        key = classes["left"][to_left][has] * (n + 1) + classes["right"][_REACH - to_left][has]
        order = np.lexsort((seeds["doc"][has], key))
        key, has = key[order], has[order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        found += [(i, to_left) for i in has[seeds["doc"][has] != seeds["doc"][has][first]].tolist()]
    return found


def _look(docs: DataFrame, buckets: int) -> DataFrame:
    out = arrow_schema(_BLOCK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            texts, spans = part.column("text").to_pylist(), part.column("spans").to_pylist()
            words, begins = _units(texts)
            counts = [len(s) for s in spans]
            rows = np.zeros(sum(counts), SEED)
            of = np.repeat(np.arange(len(texts)), counts)
            rows["doc"] = part.column("doc").to_numpy(zero_copy_only=False)[of]
            rows["ref"] = part.column("ref").to_numpy(zero_copy_only=False)[of]
            flat = [x for s in spans for x in s]
            for c in ("start", "size", "at"):
                rows[c] = [x[c] for x in flat]
            rows["h"] = np.array([x["h"] for x in flat], np.int64).view(np.uint64)
            base = begins[of] + rows["start"] + rows["at"]
            for k in range(_REACH):
                left = rows["at"] > k
                rows["left"][left, k] = words[base[left] - k - 1]
                right = rows["at"] + GRAM + k < rows["size"]
                rows["right"][right, k] = words[base[right] + GRAM + k]
            dealt = list(deal(rows, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int64()), pa.array([r.tobytes() for _, r in dealt], pa.binary())], schema=out)

    spans = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ref", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
    made = arrow_schema(spans)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            seeds = np.frombuffer(b"".join(held), SEED)
            pairs = extend(seeds)
            i = np.array([p[0] for p in pairs], np.int64)
            start = seeds["start"][i] + seeds["at"][i] - np.array([p[1] for p in pairs], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(seeds["doc"][i])), pa.array(np.ascontiguousarray(seeds["ref"][i])), pa.array(start.astype("i4")), pa.array(np.full(len(i), WINDOW, "i4"))], schema=made)

    return docs.mapInArrow(send, _BLOCK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, spans)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Takes out of each text the words of 13-word windows that a document with a smaller id has too.

    ``id_col`` is of an integer type.  Returns it and n_words, n_removed, spans (maximal repeats:
    runs of removed words, as start and end in words) and kept (the words left, joined by one space;
    null for a null text), one row per input row.  Windows are judged on the input.

    Null and empty texts have no words.  Rows that share an id are one document to others and don't
    remove from each other; a row with a null id keeps all.  Whole texts are read.  An empty table
    gives none; other columns are not read.  Words are compared by 64-bit hashes.
    """
    docs, spans = repeated(df, id_col, text_col, _units, WINDOW, GRAM, False, _look, "substring")
    joined = docs.join(spans, ["doc", "ref"], "left")
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", runs), T.StructField("kept", T.StringType())])
    out = arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, text, found in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                words = space_words(text)
                gone = covered(found, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if edge else words)
                rows.append((doc, len(words), int(gone.sum()), [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])], None if text is None else kept.decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], out.field(i).type) for i in range(len(out))], schema=out)

    return joined.mapInArrow(apply, schema).withColumnRenamed("doc", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col(id_col).alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
