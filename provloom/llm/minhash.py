"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 8).

Sketch: in round i each shingle is hashed to one of ``SIZE`` bins with a value that starts with i; a
bin keeps its smallest value.  Rounds go on until all bins are full; from round ``SIZE`` on, round
SIZE + j sends every shingle to bin j, so 2 * SIZE rounds always fill them.  Two sets agree in a bin
with probability equal to their similarity, and the number of agreements is concentrated.

Sets that share a band of the sketch are candidates.  Verification is exact and in two steps.  First
every set of a band is compared with the band's smallest one, its centre: work that grows with the
number of sets, spread in chunks however many sets have one centre.  Mostly that links all sets of a
band.  Where candidates that hang together are in several parts still, these parts are compared by
pairs of blocks, but no part with itself: intersections of all pairs of a block pair come from an
inverted index of shingles, and only the links of a spanning forest leave the task.

Before that, groups of more than a block are narrowed by prefixes, which loses no link.  Shingles are
put in one order: those that only one part of a group has come first, then the rarer ones.  The first
common shingle of two linked sets is among the first n - ceil(threshold * n) + 1 shingles of either,
n being its size.  So a set whose prefix has no shingle of another part's prefix has no link to find,
and sets that no such shingle connects aren't compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded_batches, cut, mix64, rolling, scratch, slices, word_hashes
from .components import components

#: Words of a shingle; bins of a sketch; the chance that two sets at the threshold share no band.
SHINGLE, SIZE, MISS = 5, 125, 1e-6
#: Sets that are compared with one centre in one task.
CHUNK_SETS = 128
#: Sets and shingles of a block of what the centres didn't link; parts of a group are compared by pairs of blocks.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of all its words if it has fewer."""
    words, at = word_hashes(texts, fold=True)
    grams = rolling(words, width)
    sets = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= width:
            sets.append(np.unique(grams[s : e - width + 1]))
        else:
            sets.append(mix64(rolling(words[s:e], e - s) ^ np.uint64(e - s)) if e > s else np.empty(0, np.uint64))
    return sets


_RANK = np.uint64(48)


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """The sketch of each set that isn't empty, as 32-bit values; rows of empty sets have no meaning."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    full = np.iinfo(np.uint64).max
    bins = np.full(n * size, full, np.uint64)
    for i in range(2 * size):
        h = mix64(items ^ mix64(np.full(1, i + 1, np.uint64)))
        place = owner * size + ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64) if i < size else owner * size + (i - size)
        value = (np.uint64(i) << _RANK) | (mix64(h) >> np.uint64(16))
        np.minimum.at(bins, place, value)
        unfilled = (bins.reshape(n, size) == full).any(axis=1) & (sizes > 0)
        if not unfilled.any():
            break
        more = unfilled[owner]
        items, owner = items[more], owner[more]
    return (mix64(bins) >> np.uint64(32)).astype(np.uint32).reshape(n, size)


def rows_for(percent: int) -> int:
    """The most bins of a band with which a pair at the threshold is missed with probability ``MISS`` at most."""
    p = percent / 100
    return max((r for r in range(1, 17) if (1 - p**r) ** (SIZE // r) <= MISS), default=1)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    bands = SIZE // rows
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands))
    for r in range(rows):
        h = mix64(h ^ mix64(parts[:, :, r] + np.uint64(r << 40)))
    return h.view(np.int64)


def links(sets: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, where 100 * intersection >= percent * union.

    ``first``: if over 0, only pairs of one of the first so many and one of the others are looked at.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    shingles, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(where, kind="stable")
    holders = owner[order]  # who has a shingle, by shingle
    counts = np.bincount(where, minlength=len(shingles))
    begin = np.cumsum(counts) - counts
    at = np.cumsum(sizes) - sizes
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i in range(first or n):
        mine = where[at[i] : at[i] + sizes[i]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        c = counts[mine]
        spread = np.repeat(begin[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        shared = np.bincount(holders[spread], minlength=n)
        ok = 100 * shared >= percent * (sizes + sizes[i] - shared)
        ok[: first or i + 1] = False
        for j in np.flatnonzero(ok).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                found.append((i, j))
    return found


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, as two longs."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _describe(df: DataFrame, rows: int) -> DataFrame:
    """Of each row (columns of which the last is the text): the others, and size, key and band keys of the text's set."""
    n = len(df.columns) - 1
    schema = T.StructType([*df.schema.fields[:n], *_longs("n_shingles", "key", "key2"), T.StructField("bands", T.ArrayType(T.LongType()))])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(n).to_pylist())
            bands = band_keys(sketches(sets), rows).tolist()
            keys = [_key(s) if len(s) else (None, None) for s in sets]
            made = [[len(s) for s in sets], [k for k, _ in keys], [k for _, k in keys], [b if len(s) else [] for b, s in zip(bands, sets)]]
            yield pa.RecordBatch.from_arrays([part.column(i).cast(out.field(i).type) for i in range(n)] + [pa.array(m, out.field(n + i).type) for i, m in enumerate(made)], schema=out)

    return df.mapInArrow(run, schema)


def _sets(df: DataFrame) -> DataFrame:
    """(node, set) of rows (key, key2, node, text), neighbouring rows of a node once, whose text has the 128-bit key."""
    schema = T.StructType([*_longs("node"), T.StructField("set", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in slices(batches):
            rows = []
            for key, key2, node, text in zip(*(part.column(c).to_pylist() for c in ("key", "key2", "node", "text"))):
                if node != last:
                    found = shingle_sets([text])[0]
                    if _key(found) == (key, key2):  # ids can repeat with other texts
                        rows.append((node, found.tobytes()))
                        last = node
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], out.field(i).type) for i in range(2)], schema=out)

    return df.select("key", "key2", "node", "text").mapInArrow(run, schema)


def _dealt(sets: DataFrame, wanted: DataFrame, task: list[str], order: list[str]) -> DataFrame:
    """Sets with their tasks; rows of a task stand together in order.

    Merged at every size: a side that grows with the corpus isn't broadcast while it happens to be small.
    """
    return sets.join(wanted.hint("merge"), "node").repartition(*task).sortWithinPartitions(*task, *order)


_LINK = T.StructType(_longs("a", "b"))


def _star(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a centre and the members dealt to it; the centre's row comes first in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, hub, last = None, np.empty(0, np.uint64), None
        for part in slices(batches):
            a, b = [], []
            for center, chunk, node, raw in zip(*(part.column(c).to_pylist() for c in ("center", "chunk", "node", "set"))):
                mine = np.frombuffer(raw, np.uint64)
                if (center, chunk) != task:
                    task, hub = (center, chunk), mine
                elif node not in (center, last):  # a row that repeats comes in turn
                    shared = int((hub[np.minimum(np.searchsorted(hub, mine), len(hub) - 1)] == mine).sum())
                    if 100 * shared >= percent * (len(hub) + len(mine) - shared):
                        a.append(center)
                        b.append(node)
                last = node
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select("center", "chunk", "node", "set").mapInArrow(run, _LINK)


def _verify(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the forest of each task; rows of a task stand together, ordered by block and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sets, blocks = (), [], [], []

        def found() -> pa.RecordBatch:
            first = sum(b == task[1] for b in blocks) if task[1] != task[2] else 0
            some = len(sets) > 1 and (task[1] == task[2] or 0 < first < len(sets))
            pairs = links(sets, first, percent) if some else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in range(2)], names=["a", "b"])

        for part in slices(batches):
            for group, x, y, block, node, raw in zip(*(part.column(c).to_pylist() for c in ("group", "x", "y", "block", "node", "set"))):
                if (group, x, y) != task:
                    if task:
                        yield found()
                    task, nodes, sets, blocks = (group, x, y), [], [], []
                if not nodes or nodes[-1] != node:  # a row that repeats comes in turn
                    nodes.append(node)
                    blocks.append(block)
                    sets.append(np.frombuffer(raw, np.uint64))
        if task:
            yield found()

    return dealt.select("group", "x", "y", "block", "node", "set").mapInArrow(run, _LINK)


def _set_rows(dealt: DataFrame) -> DataFrame:
    """(group, root, node, n_shingles, set as an array) of rows that stand together by node, each node once."""
    schema = T.StructType([*_longs("group", "root", "node", "n_shingles"), T.StructField("shingles", T.ArrayType(T.LongType()))])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in slices(batches):
            nodes, new = part.column(2).to_pylist(), []
            for i, node in enumerate(nodes):
                if node != last:  # a row that repeats comes in turn
                    new.append(i)
                    last = node
            part = part.take(pa.array(new, pa.int64()))
            sets = [np.frombuffer(raw, np.int64) for raw in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(i).cast(out.field(i).type) for i in range(4)] + [pa.array(sets, out.field(4).type)], schema=out)

    return dealt.select("group", "root", "node", "n_shingles", "set").mapInArrow(run, schema)


def _narrowed(members: DataFrame, shipped: DataFrame, percent: int) -> DataFrame:
    """``members`` in smaller groups: those that prefixes connect, of groups that fill more than a block.

    Sets that can't have a link to another part are left out.  What is exchanged grows with the
    shingles of these groups, not with pairs.
    """
    size = members.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    large = cut(size.where((F.col("lo") < F.col("hi")) & ((F.col("n") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES))).select("group"), "minhash-large")
    if large.isEmpty():
        return members
    sets = cut(_set_rows(_dealt(shipped, members.join(large, "group"), ["node"], [])), "minhash-large-sets")
    rows = sets.select("group", "root", "node", "n_shingles", F.explode("shingles").alias("shingle"))
    several = rows.groupBy("group", "shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("holders")).where("lo < hi").select("group", "shingle", "holders")
    ranked = rows.join(several.hint("merge"), ["group", "shingle"])
    of_node = Window.partitionBy("node")
    ranked = ranked.withColumn("place", F.row_number().over(of_node.orderBy("holders", "shingle")) + F.col("n_shingles") - F.count(F.lit(1)).over(of_node))
    inside = F.col("place") <= F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1
    chunks = F.ceil(F.col("holders") / CHUNK_SETS).cast("long")
    prefix = cut(ranked.where(inside).select("group", "shingle", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), "node", "root", "holders"), "minhash-prefixes")
    shared = prefix.groupBy("group", "shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("a"), F.min("holders").alias("holders")).where("lo < hi")
    # A shingle that very many sets have is met in chunks of them.
    shared = shared.select("group", "shingle", "a", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    near = components(prefix.join(shared.hint("merge"), ["group", "shingle", "chunk"]).select("a", F.col("node").alias("b")).distinct())
    narrow = members.join(near, "node").select("node", F.col("component").alias("group"), "root", "n_shingles")
    return cut(members.join(large, "group", "left_anti").select("node", "group", "root", "n_shingles").unionAll(narrow), "minhash-narrowed")


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (group, x, y) and which sets go to them (node, group, x, y, block), for what centres didn't link.

    ``members``: (node, group, root, n_shingles).  A part of a group (sets of one root) has blocks of
    its own if it fills one, small parts share blocks; two blocks of one part aren't compared.
    """

    def fill(n: str, shingles: str) -> Column:
        return F.greatest(F.col(n) / BLOCK_SETS, F.col(shingles) / BLOCK_SHINGLES)

    parts = members.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    several = parts.groupBy("group").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("group")
    parts = cut(parts.join(several, "group").withColumn("owner", F.when(fill("n", "s") >= 1, F.col("root"))), "minhash-parts")
    owners = parts.groupBy("group", "owner").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("group", "owner", F.ceil(fill("n", "s")).cast("long").alias("salts"))
    in_order = Window.partitionBy("group").orderBy("owner", "salt")
    blocks = cut(owners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("block", F.row_number().over(in_order)), "minhash-blocks")
    x, y = (blocks.select("group", F.col("owner").alias(f"owner_{c}"), F.col("block").alias(c)) for c in "xy")
    tasks = x.join(y, "group").where("x <= y and (owner_x <> owner_y or owner_x is null or owner_y is null)").select("group", "x", "y")
    placed = members.join(parts.select("group", "root", "owner"), ["group", "root"]).alias("m")
    same = (F.col("m.group") == F.col("b.group")) & F.col("m.owner").eqNullSafe(F.col("b.owner")) & (F.pmod(F.xxhash64("m.node"), F.col("b.salts")) == F.col("b.salt"))
    placed = placed.join(blocks.alias("b"), same).select("m.node", "m.group", "b.block")
    goes = tasks.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    return tasks, placed.join(goes, ["group", "block"])


def text_digest(text: Column) -> Column:
    """Stands for a text where rows are told apart by it; a null text's is empty."""
    return F.coalesce(F.md5(text.cast("string")), F.lit(""))


def _components(docs: DataFrame, percent: int, first: Column, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What the rows (id, ref, ..., text) are described by; and of each set its keys, ``first`` over its rows and its component.

    Sets are numbered, and known by their numbers, as two of them can agree in half of their key.
    """
    base = keep(_describe(docs, rows_for(percent)), "minhash-base")
    sets = base.where("key is not null").groupBy("key", "key2").agg(first.alias("first"), F.min("ref").alias("ref"), F.min("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    # A bucket hangs together through its smallest node, whatever its size.
    buckets = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("band", "center")
    pairs = cut(bands.join(buckets, "band").where("node <> center").select("center", "node").distinct(), "minhash-pairs")
    groups = components(pairs.select(F.col("center").alias("a"), F.col("node").alias("b")))
    known = groups.select("node").join(nodes.select("node", "key", "key2", "ref"), "node")
    shipped = cut(_sets(docs.select("ref", "text").join(known.hint("merge"), "ref")), "minhash-shipped")

    chunks = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).cast("long").alias("chunks"))
    hubs = chunks.select(F.col("center").alias("node"), "center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("place"))
    around = pairs.join(chunks, "center").select("node", "center", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), F.lit(1).alias("place"))
    linked = cut(_star(_dealt(shipped, hubs.unionByName(around), ["center", "chunk"], ["place", "node"]), percent), "minhash-star")

    roots = components(linked).select("node", F.col("component").alias("root"))
    members = groups.withColumnRenamed("component", "group").join(roots, "node", "left").join(nodes.select("node", "n_shingles"), "node").select("node", "group", F.coalesce("root", "node").alias("root"), "n_shingles")
    tasks, wanted = _blocks(_narrowed(cut(members, "minhash-members"), shipped, percent))
    if not tasks.isEmpty():
        linked = linked.unionAll(cut(_verify(_dealt(shipped, wanted, ["group", "x", "y"], ["block", "node"]), percent), "minhash-links"))
        roots = components(linked).select("node", F.col("component").alias("root"))
    return base, nodes.join(roots, "node", "left").select("key", "key2", "first", F.coalesce("root", "node").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Groups of documents that are linked by 100 * intersection >= ``percent`` * union of their sets.

    Returns ``id_col``, n_shingles, component_id (the smallest id that links reach, itself included)
    and kept (the id is that smallest one), one row per input row.  Exact copies are one set, found
    by its key, and aren't compared.  Links are confirmed on whole sets (of 64-bit hashes of
    shingles); candidates share a band, which two sets at the threshold miss with probability
    ``MISS`` at most, and closer ones less.

    Null texts and texts without words have an empty set and stay alone.  Whole texts are used.
    Rows that repeat an id get their results each; a null id is a component's id only if it has no
    other.  An empty table gives none; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    text = df[text_col].cast("string")
    docs = df.select(df[id_col].alias("id"), F.coalesce(F.when(df[id_col].isNotNull(), F.xxhash64(df[id_col])), F.xxhash64(text)).alias("ref"), text.alias("text"))
    with scratch(df.sparkSession) as keep:
        base, joined = _components(docs, percent, F.min("id"), keep)
        smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
        of_key = keep(joined.join(smallest, "component").select("key", "key2", "component_id"), "minhash-components")
    out = base.select("id", "n_shingles", "key", "key2").join(of_key, ["key", "key2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates``, as id, digest (``text_digest``) and repeated.

    It is the row of the smallest id, a null one last, then of the smallest digest; so rows are told
    apart where an id is null or stands for several texts.  ``repeated``: other rows have the same id
    and text.  Rows with an empty set stay alone and are all here, not ``repeated``.
    """
    bounded_batches(df.sparkSession)
    text = df[text_col].cast("string")
    ref = F.coalesce(F.when(df[id_col].isNotNull(), F.xxhash64(df[id_col])), F.xxhash64(text))
    docs = df.select(df[id_col].alias("id"), ref.alias("ref"), text_digest(text).alias("digest"), text.alias("text"))
    with scratch(df.sparkSession) as keep:
        base, joined = _components(docs, percent, F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")), cut)
        chosen = joined.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.digest")
        counts = base.where("key is not null").groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("n"))
        # Merged at every size, as a side that grows with the corpus.
        found = chosen.join(counts.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
        rows = found.select("id", "digest", (F.col("n") > 1).alias("repeated")).unionByName(base.where("key is null").select("id", "digest", F.lit(False).alias("repeated")))
        return keep(rows, "minhash-kept")
