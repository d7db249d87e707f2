"""Near-duplicate embeddings by randomised-rotation binary codes (operator 10).

A vector of length 1 is rotated at random and each coordinate keeps its sign: its code.  Beside the
code stands a correction factor, the inner product of the vector with its quantised self.  The other
side of a comparison is rotated too and rounded to 4 bits a coordinate, so that its inner product
with a code is four counts of common bits; divided by the factor this estimates the inner product of
the two vectors without bias, and how far it can be off is known from the factor.  Codes and factors
are made once and stored.  Pairs whose upper bound is below the threshold are dismissed, all others
are computed exactly, in double precision.

Which vectors are compared at all: bits of further rotations make band keys (as many bits as the
table has, in powers of two); vectors that share one and whose codes differ in few enough bits are
neighbours; neighbours that hang together make a group, and pairs are judged within groups, by
pairs of blocks if a group is large (every link is counted, so every pair of a group is judged).
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, mix64, scratch
from .components import components
from .repeats import _BLOCK, by_bucket, runs

CODE_BITS = 128
#: Standard deviations of a confidence bound, and the chance that a pair at the threshold shares no band.
SIGMAS, MISS = 6.0, 1e-6
#: Vectors of a block of a group; larger groups are judged by pairs of blocks.  Groups that are not much
#: larger than a block are cut finer, into up to ``FINE`` blocks of ``FINE_ROWS`` or more, to spread them.
BLOCK_ROWS, FINE, FINE_ROWS = 2048, 8, 128
BUCKET_ROWS = 100_000
SEED = 20_011

ENTRY = np.dtype([("h", "u8"), ("node", "i8"), ("code", "u8", (CODE_BITS // 64,))])


def rotation(dims: int, size: int, number: int) -> np.ndarray:
    """``dims`` x ``size`` coordinates of a random rotation (of several, if more are asked for than there are)."""
    size_each = max(dims, min(size, CODE_BITS))
    parts, have, k = [], 0, 0
    while have < size:
        rng = np.random.default_rng([SEED, dims, number, k])
        q = np.linalg.qr(rng.standard_normal((size_each, size_each)))[0]
        parts.append(q[:dims])
        have += size_each
        k += 1
    return np.concatenate(parts, axis=1)[:, :size]


@functools.cache
def whole_rotation(dims: int, width: int) -> np.ndarray:
    """The first ``dims`` rows of a random rotation of ``width`` dimensions."""
    return np.linalg.qr(np.random.default_rng([SEED, dims, width]).standard_normal((width, width)))[0][:dims]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows are finite and not all 0."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1).view(np.uint64)


def width_for(dims: int) -> int:
    """Bits of the code of a vector of ``dims`` dimensions."""
    return 64 * -(-max(CODE_BITS, dims) // 64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words) and correction factors of unit vectors."""
    width = width_for(x.shape[1])
    turned = x @ whole_rotation(x.shape[1], width)
    return packed(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(width)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors at 4 bits a coordinate: bit planes (4 x rows x words), lowest value, step and sum of each."""
    turned = x @ whole_rotation(x.shape[1], width_for(x.shape[1]))
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return np.stack([packed(level >> k & 1) for k in range(4)]), low, step, low * turned.shape[1] + step * level.sum(axis=1)


def bound(factor: np.ndarray, width: int) -> np.ndarray:
    """How far off an estimate from a code with this factor is, at ``SIGMAS`` standard deviations, but for the rounding."""
    return SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(width - 1)


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 2))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-share))


def most_bits(threshold: float) -> int:
    """How many bits the codes of a pair at the threshold differ in at most."""
    p = math.acos(threshold) / math.pi
    return math.floor(CODE_BITS * p + SIGMAS * math.sqrt(CODE_BITS * p * (1 - p)))


def _describe(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key of the vector (null if it links with nothing) and its components as bytes."""
    schema = T.StructType([df.schema["id"], T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("vec", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(col)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(sizes)
            rows = []
            for s, e in zip((ends - sizes).tolist(), ends.tolist()):
                x = values[s:e]
                if e > s and np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # -0.0 is 0.0
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), raw))
                else:
                    rows.append((None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type)] + [pa.array([r[i] for r in rows], out.field(1 + i).type) for i in range(3)], schema=out)

    return df.select("id", "vec").mapInArrow(run, schema)


def _by_size(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each number of dimensions."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([raws[i] for i in at]), np.float64).reshape(len(at), -1)


def _coded(nodes: DataFrame) -> DataFrame:
    """Adds the code and the correction factor to rows (node, first, copies, vec)."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType())])
    out, at_vec = arrow_schema(schema), nodes.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes, factors = [b""] * part.num_rows, np.empty(part.num_rows)
                for rows, x in _by_size(part.column(at_vec).to_pylist()):
                    code, factors[rows] = encode(unit(x))
                    for i, c in zip(rows.tolist(), code):
                        codes[i] = c.tobytes()
                columns = [part.column(i).cast(out.field(i).type) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.binary()), pa.array(factors)], schema=out)

    return nodes.mapInArrow(run, schema)


def _entries(nodes: DataFrame, bits: int, bands: int, buckets: int) -> DataFrame:
    """(bucket, block) with an entry for each vector and band."""
    out = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, codes = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_pylist()
                made = []
                for rows, x in _by_size(part.column(1).to_pylist()):
                    x, dims = unit(x), x.shape[1]
                    code = np.frombuffer(b"".join([codes[i][: CODE_BITS // 8] for i in rows]), np.uint64).reshape(len(rows), -1)
                    signs = (x @ rotation(dims, bits * bands, 1) > 0).reshape(len(x), bands, bits)
                    h = np.zeros((len(x), bands), np.uint64)
                    for b in range(bits):
                        h = (h << np.uint64(1)) | signs[:, :, b]
                        if b % 32 == 31:
                            h = mix64(h)
                    h = mix64(h ^ mix64(np.arange(bands, dtype=np.uint64) + np.uint64(dims << 20)))
                    entry = np.empty(h.size, ENTRY)
                    entry["h"], entry["node"], entry["code"] = h.ravel(), np.repeat(keys[rows], bands), np.repeat(code, bands, axis=0)
                    made.append(entry)
                entries = np.concatenate(made)
                bucket = (mix64(entries["h"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                entries, bucket = entries[order], bucket[order]
                edges = np.flatnonzero(runs(bucket)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array([entries[s:e].tobytes() for s, e in zip(edges, [*edges[1:], len(entries)])], pa.binary())], schema=out)

    return nodes.select("node", "vec", "code").mapInArrow(run, _BLOCK)


def neighbours(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of codes that differ in ``most`` bits or fewer; of pairs that others already join, not all.

    Codes are first gathered around pivots; then all pairs across these clusters are looked at.
    """
    n = len(codes)
    found, cluster, rest = [], np.full(n, -1), np.arange(n)
    while len(rest):
        p = rest[0]
        near = np.bitwise_count(codes[rest] ^ codes[p]).sum(axis=1) <= most
        near[0] = True
        cluster[rest[near]] = p
        found += [(int(p), int(i)) for i in rest[near][1:]]
        rest = rest[~near]
        if len(found) == 0 and len(rest) > 64:
            break  # nothing to gather
    alone = cluster < 0
    cluster[alone] = np.flatnonzero(alone)
    if (cluster == cluster[0]).all():
        return found
    for at in range(0, n, 256):
        part = slice(at, at + 256)
        differ = sum(np.bitwise_count(codes[part, None, w] ^ codes[None, at:, w]) for w in range(codes.shape[1]))
        i, j = np.nonzero((differ <= most) & (cluster[part, None] != cluster[None, at:]))
        found += [(at + a, at + b) for a, b in zip(i.tolist(), j.tolist()) if a < b]
    return found


def neighbours_of_many(codes: np.ndarray, most: int) -> np.ndarray:
    """As ``neighbours``, for buckets of one size at once (buckets x rows x words): rows of (bucket, i, j).

    Of pairs that others already join, only those of different clusters so far are given.
    """
    n, size, _ = codes.shape
    cluster = np.broadcast_to(np.arange(size), (n, size)).copy()
    found = []
    for i in range(size - 1):
        for j in range(i + 1, size):
            near = np.bitwise_count(codes[:, i] ^ codes[:, j]).sum(axis=1) <= most
            at = np.flatnonzero(near & (cluster[:, i] != cluster[:, j]))
            if len(at):
                mine = cluster[at]
                cluster[at] = np.where(mine == mine[:, j : j + 1], mine[:, i : i + 1], mine)
                found.append(np.stack((at, np.full(len(at), i), np.full(len(at), j)), axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Buckets up to this size are compared many at once.
_SMALL = 24


def _neighbours(blocks: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            rows = np.frombuffer(b"".join(held), ENTRY)
            rows = rows[np.argsort(rows["h"], kind="stable")]
            edges = np.flatnonzero(runs(rows["h"]))
            sizes = np.diff(np.append(edges, len(rows)))
            a, b = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= _SMALL)]).tolist():
                begin = edges[sizes == size]
                found = neighbours_of_many(rows["code"][begin[:, None] + np.arange(size)], most)
                a.append(rows["node"][begin[found[:, 0]] + found[:, 1]])
                b.append(rows["node"][begin[found[:, 0]] + found[:, 2]])
            for s, n in zip(edges[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
                pairs = np.array(neighbours(np.ascontiguousarray(rows["code"][s : s + n]), most), np.int64).reshape(-1, 2)
                a.append(rows["node"][s + pairs[:, 0]])
                b.append(rows["node"][s + pairs[:, 1]])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _PAIR)


def judge(x: np.ndarray, y: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors with an inner product of ``threshold`` or more, computed exactly
    where the bound from the stored codes and factors of the rows of ``y`` doesn't rule it out."""
    bits, low, step, total = planes(x)
    width = 64 * code.shape[1]
    ones, off = np.bitwise_count(code).sum(axis=1), bound(factor, width)
    # Rounding is off by a twelfth of a squared step in each coordinate, on average.
    rounding = SIGMAS * step / math.sqrt(12)
    found = []
    for at in range(0, len(x), 128):
        part = slice(at, at + 128)
        common = np.zeros((len(x[part]), len(y)), np.int32)
        for k in range(4):
            for w in range(code.shape[1]):
                common += np.bitwise_count(bits[k, part, None, w] & code[None, :, w]).astype(np.int32) << k
        inner = 2 * (low[part, None] * ones + step[part, None] * common) - total[part, None]
        i, j = np.nonzero((inner / math.sqrt(width) + rounding[part, None]) / factor + off >= threshold)
        for k in range(0, len(i), 1 << 16):
            a, b = at + i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = (x[a] * y[b]).sum(axis=1) >= threshold
            found.append((a[ok], b[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_JUDGED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _judge(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b, null): links of a spanning forest of each task; (a, null, n): links of a node in a task, by copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = (), []

        def found() -> pa.RecordBatch:
            x = unit(np.frombuffer(b"".join([r[2] for r in rows]), np.float64).reshape(len(rows), -1))
            keys, copies = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
            code, factor = np.frombuffer(b"".join([r[4] for r in rows]), np.uint64).reshape(len(rows), -1), np.array([r[5] for r in rows])
            first = sum(r[0] == task[1] for r in rows) if task[1] != task[2] else 0
            if first:
                i, j = judge(x[:first], x[first:], code[first:], factor[first:], threshold)
                j = j + first
            elif task[1] == task[2]:
                i, j = judge(x, x, code, factor, threshold)
                i, j = i[i < j], j[i < j]
            else:
                i = j = np.empty(0, np.int64)
            counts = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            root = np.arange(len(rows))
            while True:  # the smallest row that links reach, and one link that led there
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some, linked = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(rows)))
            a = np.concatenate((keys[linked], keys[some]))
            b = pa.array(np.concatenate((keys[root[linked]], np.zeros(len(some), np.int64))), mask=np.repeat([False, True], [len(linked), len(some)]))
            n = pa.array(np.concatenate((np.zeros(len(linked), np.int64), counts[some].astype(np.int64))), mask=np.repeat([True, False], [len(linked), len(some)]))
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), b, n], names=["a", "b", "n"])

        for batch in batches:
            for group, px, py, block, key, raw, copies, code, factor in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, px, py) != task:
                    if rows:
                        yield found()
                    task, rows = (group, px, py), []
                rows.append((block, key, raw, copies, code, factor))
        if rows:
            yield found()

    return dealt.mapInArrow(run, _JUDGED)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Links between vectors whose cosine, in double precision, is ``threshold`` or more.

    Returns ``id_col``, n_links (other rows linked directly), component_id (the smallest id that
    links reach, itself included) and kept (the id is that one), one row per input row.  Equal
    vectors are one node with copies; copies are linked.  A pair at the threshold is missed with
    probability 1e-6, and closer ones less.

    Null and empty vectors, zero vectors, and vectors with null or non-finite components link with
    nothing, nor do vectors of different lengths.  Rows that repeat an id count as vectors of their
    own.  A null id is a component's id only if it has no other.  An empty table gives none; other
    columns are not read.
    """
    source = df.select(df[id_col].alias("id"), df[vector_col].alias("vec"))
    with scratch(df.sparkSession) as keep:
        base = keep(_describe(source, id_col, vector_col), "vectors-base")
        distinct = base.where("key is not null").groupBy("key", "key2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"))
        # Vectors are numbered, and known by their numbers, as two of them can agree in half of their key.
        nodes = cut(_coded(distinct.withColumn("node", F.monotonically_increasing_id())), "vectors-nodes")
        bits, bands = bands_for(nodes.count(), threshold)
        buckets = max(8, math.ceil(2**bits * bands / BUCKET_ROWS))
        groups = components(_neighbours(_entries(nodes, bits, bands, buckets), most_bits(threshold)))
        members = groups.join(nodes.select("node", "vec", "copies", "code", "factor"), "node")
        n = F.count(F.lit(1))
        parts = groups.groupBy("component").agg(F.greatest(F.ceil(n / BLOCK_ROWS), F.least(F.ceil(n / FINE_ROWS), F.lit(FINE))).cast("long").alias("parts"))
        dealt = (
            members.join(parts, "component")
            .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select(F.col("component").alias("group"), F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node", "vec", "copies", "code", "factor")
            .repartition("group", "x", "y")
            .sortWithinPartitions("group", "x", "y", "part", "node")
        )
        judged = cut(_judge(dealt, threshold), "vectors-judged")
        linked = components(judged.where("b is not null").select("a", "b"))
        counts = judged.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
        joined = nodes.select("node", "key", "key2", "first", "copies").join(linked, "node", "left").join(counts.withColumnRenamed("a", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
        of_key = keep(joined.join(smallest, "component").select("key", "key2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-components")
    component = F.coalesce("component_id", "id")
    return base.select("id", "key", "key2").join(of_key, ["key", "key2"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
