"""Entity embeddings: lookup, cosine top-k, scores of link-prediction models, rank metrics."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and values of a block at most (1 MB in double precision); rows of a block that are compared at one time.
BLOCK_ROWS, BLOCK_VALUES, AT_ONCE = 2048, 1 << 17, 256
#: Blocks of a partition at most: each task holds those of one partition.
PARTITION_BLOCKS = 64


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """With a small number in the divisor, so that zero vectors give 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))


def from_complex(real: Column, imaginary: Column) -> Column:
    return F.concat(real, imaginary)


class Embeddings:
    """Vectors (id, embedding), with an optional label for lookups."""

    def __init__(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", label_col: str | None = None):
        self.vectors, self.id, self.vector, self.label = vectors, id_col, vector_col, label_col

    def get_vector(self, entity) -> list[float]:
        """By id, else by label; KeyError if there is none."""
        hit = F.col(self.id).cast("string") == str(entity)
        order = F.when(hit, 0).otherwise(1)
        if self.label:
            hit = hit | (F.col(self.label) == str(entity))
        found = self.vectors.where(hit).orderBy(order, self.id).select(self.vector).limit(1).collect()
        if not found:
            raise KeyError(entity)
        return list(found[0][0])

    def most_similar(self, entity, k: int = 10) -> DataFrame:
        """(id, similarity) of the k nearest others by cosine; ties by id.  One vector goes to all rows; no shuffle of vectors."""
        q = F.array(*[F.lit(float(x)) for x in self.get_vector(entity)])
        others = self.vectors.where(F.col(self.id).cast("string") != str(entity))
        return others.select(F.col(self.id), cosine(F.col(self.vector), q).alias("similarity")).orderBy(F.desc("similarity"), self.id).limit(k)

    @property
    def num_entities(self) -> int:
        return self.vectors.count()

    @property
    def dimension(self) -> int:
        return self.vectors.select(F.size(self.vector)).first()[0]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, rank, similarity) for a stated set of queries against all vectors."""
    q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("_q"), norm(F.col(vector_col)).alias("_qn"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"), norm(F.col(vector_col)).alias("_vn"))
    pairs = q.join(v, F.col("query") != F.col("id")).select("query", "id", (dot(F.col("_q"), F.col("_v")) / (F.col("_qn") * F.col("_vn") + F.lit(1e-12))).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def transe(h: Column, r: Column, t: Column) -> Column:
    """Minus the length of h + r - t."""
    d = F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: x - y)
    return -norm(d)


def distmult(h: Column, r: Column, t: Column) -> Column:
    return dot(F.zip_with(h, r, lambda x, y: x.cast("double") * y), t)


def rotate(h: Column, phase: Column, t: Column) -> Column:
    """Minus the length of h rotated by phase, minus t; h and t are real parts, then imaginary parts."""
    n = F.size(phase)
    re, im = F.slice(h, 1, n), F.slice(h, n + 1, n)
    tre, tim = F.slice(t, 1, n), F.slice(t, n + 1, n)
    turned_re = F.zip_with(F.zip_with(re, phase, lambda x, p: x * F.cos(p)), F.zip_with(im, phase, lambda x, p: x * F.sin(p)), lambda x, y: x - y)
    turned_im = F.zip_with(F.zip_with(re, phase, lambda x, p: x * F.sin(p)), F.zip_with(im, phase, lambda x, p: x * F.cos(p)), lambda x, y: x + y)
    return -norm(F.concat(F.zip_with(turned_re, tre, lambda x, y: x - y), F.zip_with(turned_im, tim, lambda x, y: x - y)))


def ranks(scored: DataFrame, query: str, is_true: str, score: str = "score", tie: str = "id") -> DataFrame:
    """(query, rank) of the true candidate among a query's candidates; ties by ``tie``."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col(is_true)).groupBy(query).agg(F.min("rank").alias("rank"))


#: Scores in units of 1e-9: NaN stands before all numbers, null behind them, as in SQL.
_NAN, _NULL = 1 << 62, -(1 << 62)
_ROWS = "length int, plain boolean, id binary, label array<string>, score binary, best binary, data binary"


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the columns of a and b, in order of the components."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _units(x: np.ndarray) -> np.ndarray:
    """Rounded to nine places, half away from zero."""
    r = x * 1e9
    whole = np.trunc(r)
    return np.where(np.isnan(r), _NAN, whole + np.copysign(np.abs(r - whole) >= 0.5, r)).astype(np.int64)


class _Block:
    """Vectors of one length, a column each; length -1: without values. plain: all norms are finite."""

    def __init__(self, batch: pa.RecordBatch, n: int, side: str):
        of = lambda name: batch.column(f"{side}_{name}")[n]
        numbers = lambda name, kind: np.frombuffer(of(name).as_buffer(), kind)
        self.length, self.plain, self.id = of("length").as_py(), of("plain").as_py(), numbers("id", np.int64)
        self.score, self.best = numbers("score", np.int64), numbers("best", np.int64)
        self.data = numbers("data", np.float64).reshape(self.length, -1) if self.length > 0 else np.zeros((0, len(self.id)))
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_dots(self.data, self.data))
        self.labels: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(of("label").as_py()):
            if x is not None:
                self.labels[x].append(k)


def _exact(q: _Block, v: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded cosine of the pairs (i, j), summed up in order of the components."""
    if q.length != v.length or q.length < 0:
        return np.full(len(i), _NULL)
    step = max(1, 16 * BLOCK_VALUES // max(1, q.length))
    out = np.empty(len(i), np.int64)
    with np.errstate(all="ignore"):
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            out[a : a + step] = _units(_dots(q.data[:, x], v.data[:, y]) / (q.norm[x] * v.norm[y] + 1e-12))
    return out


def _near(q: _Block, v: _Block, rows: np.ndarray, cols: np.ndarray, own: float) -> tuple[np.ndarray, float]:
    """Cosines of all pairs by a matrix product, ``own`` for pairs of one id, and how far they can be from sums in order."""
    s = q.data[:, rows].T @ v.data[:, cols]
    by = np.multiply.outer(q.norm[rows], v.norm[cols])
    by += 1e-12
    s /= by
    same = np.flatnonzero(np.isin(v.id[cols], q.id[rows]))
    i, j = np.nonzero(q.id[rows, None] == v.id[cols[same]])
    s[i, same[j]] = own
    return s, 4 * (q.length + 8) * np.finfo(np.float64).eps


def _best(q: _Block, v: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the best vector of the same label, for queries that have one."""
    found = []
    for label in q.labels.keys() & v.labels.keys():
        mine, cols = np.array(q.labels[label]), np.array(v.labels[label])
        for rows in np.split(mine, range(AT_ONCE, len(mine), AT_ONCE)):
            if q.plain and v.plain and q.length == v.length:
                s, off = _near(q, v, rows, cols, -np.inf)
                i, j = np.nonzero((s >= s.max(axis=1, keepdims=True) - 1.001e-9 - 2 * off) & (s > -np.inf))
            else:
                i, j = np.nonzero(q.id[rows, None] != v.id[cols])
            i, j = rows[i], cols[j]
            score = _exact(q, v, i, j)
            order = np.lexsort((v.id[j], -score, i))
            first = order[np.diff(i[order], prepend=-1) > 0]
            found.append((q.id[i[first]], score[first], v.id[j[first]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _before(q: _Block, v: _Block) -> tuple[np.ndarray, np.ndarray]:
    """(query, number of vectors before its best one)."""
    n, cols = np.zeros(len(q.id), np.int64), np.arange(len(v.id))
    for rows in np.split(np.arange(len(q.id)), range(AT_ONCE, len(q.id), AT_ONCE)):
        if q.plain and v.plain and q.length == v.length:
            s, off = _near(q, v, rows, cols, np.nan)
            low, high = ((q.score[rows, None] + x) * 1e-9 + y for x, y in ((-0.5, -off), (0.5, off)))
            above = np.count_nonzero(s >= high, axis=1)
            n[rows] += above
            left = np.flatnonzero(np.count_nonzero(s >= low, axis=1) > above)
            i, j = np.nonzero((s[left] >= low[left]) & (s[left] < high[left]))
            i = left[i]
        else:
            i, j = np.nonzero(q.id[rows, None] != v.id)
        i = rows[i]
        score = _exact(q, v, i, j)
        i = i[(score > q.score[i]) | (score == q.score[i]) & (v.id[j] < q.best[i])]
        n += np.bincount(i, minlength=len(n))
    return q.id, n


def _blocks(rows: DataFrame, n: int, side: str) -> DataFrame:
    """n rows (id, label, score, best, vector) as blocks of equal length, dealt evenly."""
    blocks = -(-n // BLOCK_ROWS)
    held = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{side}_{x}" for x in _ROWS.split(", "))

    def block(length: int, plain: bool, parts: list[tuple]) -> pa.RecordBatch:
        ids, labels, scores, bests, data = zip(*parts, strict=True)
        numbers = [np.concatenate(x).tobytes() for x in (ids, scores, bests)]
        values = np.ascontiguousarray(np.concatenate(data).T).tobytes()
        cells = [length, plain, numbers[0], [y for x in labels for y in x], *numbers[1:], values]
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list[tuple]] = defaultdict(list)
        count: dict[tuple[int, bool], int] = defaultdict(int)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("vector")), -1).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length) if length > 0 else np.zeros((part.num_rows, 0))
                with np.errstate(all="ignore"):
                    plain = np.isfinite(_dots(values.T, values.T)) & (length >= 0)
                ids, scores, bests = (part.column(x).to_numpy(zero_copy_only=False) for x in ("id", "score", "best"))
                labels, most = np.array(part.column("label").to_pylist(), object), max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, length)))
                for kind in {*plain.tolist()}:
                    own, key = np.flatnonzero(plain == kind), (length, kind)
                    while len(own):
                        now, own = np.split(own, [most - count[key]])
                        waiting[key].append((ids[now], labels[now], scores[now], bests[now], values[now]))
                        count[key] += len(now)
                        if count[key] == most:
                            yield block(*key, waiting.pop(key))
                            count[key] = 0
        for key, parts in waiting.items():
            yield block(*key, parts)

    return rows.repartition(max(1, min(blocks, held), -(-blocks // PARTITION_BLOCKS))).mapInArrow(run, schema)


def _pairs(queries: DataFrame, vectors: DataFrame, judge: Callable[[_Block, _Block], tuple], schema: str) -> DataFrame:
    """What ``judge`` finds in each pair of a block of queries and one of vectors."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield pa.record_batch([pa.array(x, pa.int64()) for x in judge(_Block(batch, n, "q"), _Block(batch, n, "v"))], names=names)

    return queries.crossJoin(vectors).mapInArrow(run, schema)


def label_ranks(queries: DataFrame, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(query, rank) of the first vector of a query's own label among all others by cosine, rounded to nine places; ties by id.

    Ids are whole numbers.  Blocks of queries meet blocks of vectors; a matrix product settles all pairs but those
    so near to a limit that the order of summing up could matter, which are summed up in order.  The first pass goes
    over pairs of one label and finds the best, the second counts what stands before it.  NaN comes first, and last
    what has no cosine (no vector, no value of a component, another length).
    """
    # Values that are missing make the whole cosine null.
    vector = F.when(~F.exists(vector_col, lambda x: x.isNull()), F.col(vector_col).cast("array<double>")).alias("vector")
    none = F.lit(0).cast("long")
    q, v = (
        x.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), none.alias("score"), none.alias("best"), vector)
        for x in (queries, vectors)
    )
    n_q, all_v = q.count(), _blocks(v, v.count(), "v")
    hits = _pairs(_blocks(q, n_q, "q"), all_v, _best, "query long, score long, id long")
    best = hits.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("behind"), "id")).alias("at"))
    known = q.drop("score", "best").join(best.withColumnRenamed("query", "id"), "id").select("id", "label", (-F.col("at.behind")).alias("score"), F.col("at.id").alias("best"), "vector")
    before = _pairs(_blocks(known, n_q, "q"), all_v, _before, "query long, before long")
    return before.groupBy("query").agg((F.sum("before") + 1).alias("rank"))


def rank_metrics(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MRR, hits at 1, 3 and 10, and the mean rank."""
    hits = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hits_at_{k}")
    return ranked.groupBy(*(by or [])).agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), hits(1), hits(3), hits(10), F.round(F.avg("rank"), 6).alias("mean_rank"))


def best_model(metrics: DataFrame, model: str = "model") -> DataFrame:
    """The model of highest MRR; the first name on ties."""
    return metrics.orderBy(F.desc("mrr"), model).limit(1)
