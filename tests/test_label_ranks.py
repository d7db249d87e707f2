"""rank_metrics and the operator behind it: odd vectors, ties, repeated ids, blocks."""

import duckdb
import numpy as np
import pytest

from provloom.operators import vectors
from provloom.plans import registry, table_queries  # noqa: F401  (registers the query)

SCHEMA = "vec_id long, embedding array<float>, label int"


def both(spark, rows, tmp_path):
    """The query's row and its SQL's."""
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return tuple(registry.QUERIES["rank_metrics"](spark, str(tmp_path)).first()), con.sql(registry.SQL["rank_metrics"]).fetchall()[0]


ODD = {
    "null vector": (2, None, 0),
    "NaN": (2, [float("nan"), 1.0, 0.0], 1),
    "infinite": (2, [float("inf"), 1.0, 0.0], 1),
    "zero": (2, [0.0, 0.0, 0.0], 0),
    "tiny": (2, [1e-7, 1e-7, 0.0], 0),
    "huge": (2, [3e38, 3e38, 1e38], 0),
    "null label": (2, [1.0, 0.0, 0.0], None),
    "null id": (None, [1.0, 0.0, 0.0], 0),
    "id of a query": (20, [1.0, 0.5, 0.0], 1),
    "repeated id": (7, [0.9, 0.1, 0.0], 0),
}


@pytest.mark.parametrize("kind", ODD)
def test_odd_rows_as_in_sql(spark, tmp_path, kind):
    rows = [(20, [1.0, 0.0, 0.0], 0), (-40, [0.0, 1.0, 0.0], 1), (7, [0.9, 0.1, 0.0], 0), (8, [0.1, 0.2, 1.0], 1), (9, [-1.0, 0.0, 0.2], 1), (60, [0.3, 0.3, 0.3], 2)]
    got, want = both(spark, [*rows, ODD[kind]], tmp_path)
    assert got == want


def test_odd_rows_together(spark, tmp_path):
    """NaN before all numbers, a missing cosine behind them, as the best and as the others; a query of each."""
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(size=4).round(1).tolist(), int(rng.integers(4))) for n in range(300)]
    for n, e in ((20, None), (41, None), (40, [float("nan")] * 4), (61, [1.0, float("nan"), 0.0, 0.0]), (60, [0.0] * 4), (81, [0.0] * 4), (80, [float("inf"), 0.0, 1.0, 1.0]), (101, [float("-inf"), 1.0, 1.0, 1.0])):
        rows[n] = (n, e, n // 20 % 4)
    got, want = both(spark, rows, tmp_path)
    assert got == want


def test_no_hit_gives_nulls(spark, tmp_path):
    got, want = both(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1)], tmp_path)
    assert got == want == (None,) * 5


def test_missing_components_and_other_lengths_stand_last(spark):
    """DuckDB refuses such lists; here they have no cosine."""
    rows = [(20, [1.0, 0.0], 0), (1, [1.0, None], 0), (2, [1.0, 0.0, 0.0], 0), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 1), (40, [1.0, None], 1)]
    v = spark.createDataFrame(rows, SCHEMA)
    got = vectors.label_ranks(v.where("vec_id % 20 = 0"), v, "vec_id").collect()
    assert sorted(map(tuple, got)) == [(20, 3), (40, 3)]  # 4, 3, then 1; all by id: 1, 2, 3


def test_blocks_meet_instead_of_rows(spark, tmp_path, monkeypatch):
    """Some thousand vectors with many ties against brute force; a row of the join is a pair of blocks."""
    rng, joined = np.random.default_rng(5), []
    v = np.vstack([rng.normal(size=(2500, 24)), np.tile(rng.normal(size=(50, 24)), (40, 1))]).astype(np.float32)
    labels = rng.integers(5, size=len(v))
    was = vectors._pairs
    monkeypatch.setattr(vectors, "_pairs", lambda q, w, *more: joined.append(q.crossJoin(w).count()) or was(q, w, *more))
    spark.createDataFrame([(n, e.tolist(), int(labels[n])) for n, e in enumerate(v)], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    e = registry.table(spark, str(tmp_path), "embeddings")
    got = {r.query: r.rank for r in vectors.label_ranks(e.where("vec_id % 20 = 0"), e, "vec_id").collect()}
    d, want, ids = v.astype(np.float64), {}, np.arange(len(v))
    norms = np.sqrt((d * d).sum(axis=1))
    for q in range(0, len(v), 20):
        order = np.lexsort((ids, -np.round(d @ d[q] / (norms * norms[q] + 1e-12), 9)))
        order = order[order != q]
        want[q] = int(np.flatnonzero(labels[order] == labels[q])[0]) + 1
    assert got == want and max(joined) <= 4
