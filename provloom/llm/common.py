"""Helpers that the operators share: tables, the shared folder, Arrow batches, hashing of words."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Texts of a batch that an operator holds as Python objects at one time.
SLICE_ROWS = 256
#: Bytes of such texts; a longer text stands alone.
SLICE_BYTES = 1 << 20
#: Rows of a batch between the JVM and a worker: texts can be long, and each side holds whole batches.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs on one machine is a temporary folder made and put there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="provloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables that the ``scratch`` around has to delete.
_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provloom/{label}-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables that ``cut`` writes inside, at the end, but for those written by the function given.

    That function is ``cut`` for what is to outlive the block; an outer block may delete it in turn.
    """
    mine: list[str] = []
    outer = _passing.get()
    held = _passing.set(mine)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _passing.set(outer)
        try:
            return cut(df, label)
        finally:
            _passing.reset(inner)

    try:
        yield keep
    finally:
        _passing.reset(held)
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches no larger than ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def hand_back() -> None:
    """Returns memory that a task has freed to the system, as workers live on for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows and about ``SLICE_BYTES`` of strings."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
        until, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(until, until[at] - size[at] + SLICE_BYTES, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    hand_back()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``keep`` as _k0, _k1, ... and the text, once; and the place of the text."""
    bounded_batches(df.sparkSession)
    kept = [df[c].alias(f"_k{i}") for i, c in enumerate(keep)]
    if text in keep and df.schema[text].dataType == T.StringType():
        return df.select(*kept), keep.index(text)
    return df.select(*kept, df[text].cast("string").alias("_t")), len(keep)


def map_texts(
    df: DataFrame, keep: list[str], text: str, added: T.StructType, make: Callable[[], Callable[[str | None], tuple]]
) -> DataFrame:
    """One output row per row of ``df``: the columns ``keep`` and what ``make()(text)`` returns.

    ``make`` runs once a task.  Only the named columns are read, so other columns, whatever they
    are called, don't matter.  Narrow: no shuffle, and memory is bounded by a slice of texts.
    """
    source, text_at = with_text(df, keep, text)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + list(added.fields))
    out = arrow_schema(schema)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches):
            rows = [each(t) for t in part.column(text_at).to_pylist()]
            columns = [part.column(i).cast(out.field(i).type) for i in range(n_keep)]
            columns += [pa.array([r[j] for r in rows], type=out.field(n_keep + j).type) for j in range(len(added))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return source.mapInArrow(run, schema)


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and gives the runs of digits, letters and characters from U+0080 on, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def space_words(text: str | None, fold: bool = False) -> list[bytes]:
    """The runs ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``fold`` lower-cases A-Z first.

    ``bytes.split`` cuts at exactly these six characters.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return (raw.translate(_FOLD) if fold else raw).split()


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix64(h ^ values[k : k + n])
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _BYTE[np.frombuffer(_FOLD, np.uint8)]
_R, _R_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made once and extended as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, r, np.uint64)))) for r in (np.uint64(_R), np.uint64(_R_INVERSE)))
        return cls.up, cls.down


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array, which are what stands between the six spaces."""
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    if len(word) and word[-1]:
        edge = np.concatenate((edge, [len(word)]))
    return edge[::2], edge[1::2]


#: Bytes of text, or units of a sequence, that arrays of several times their size are made for at one time.
PIECE = 1 << 21


def word_hashes(texts: list[str | None], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts (see ``space_words``), and where each text's begin.

    The hash of a word is a polynomial over its bytes, taken from prefix sums, then mixed.  Long texts
    go through in pieces that end between words.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    hashes, begins, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            spaces = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            end = end + int(spaces[0]) + 1 if len(spaces) else min(end + PIECE, len(raw))
        piece = raw[at:end]
        up, down = _Powers.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[piece] * up[: len(piece)], out=sums[1:])
        s, e = word_spans(piece)
        hashes.append(mix64((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64)))
        begins.append(s + at)
        at = end
    starts = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
