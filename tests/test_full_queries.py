"""Searches over whole tables against brute force."""

from collections import Counter

import numpy as np
import pytest

from provloom.plans import graph_queries, registry, source_queries, table_queries  # noqa: F401
from provloom.plans import testgraph as tg


def test_hops_reach_five(spark, sf_dir):
    near = {}
    for a, b in tg.assertions(spark, sf_dir).select("subject_id", "object_id").distinct().collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, level = {"customer:0": 0}, ["customer:0"]
    for n in range(1, 6):
        level = sorted({b for a in level for b in near.get(a, ())} - set(hops))
        hops |= dict.fromkeys(level, n)
    want = Counter(hops.values())
    assert max(want) > 2
    assert {r.hops: r.n for r in registry.QUERIES["shortest_path_hops"](spark, sf_dir).collect()} == want


def test_names_of_all_brands(spark, sf_dir):
    parts = sorted((r.p_partkey, r.p_name, r.p_size) for r in registry.table(spark, sf_dir, "part").collect())
    kinds = {0: (1, 1), 1: (2, 2), 2: (3, 5), 3: (3, 6)}  # by p_partkey % 4: tier of an exact hit, order of canonical names
    canon = {}
    for k, name, size in sorted(parts, key=lambda x: (kinds[x[0] % 4][1], x[0])):
        canon.setdefault(size, name)
    want = []
    for q in table_queries._TQ:
        found = {}
        for k, name, size in parts:
            if name.lower() == q:
                found.setdefault(size, (kinds[k % 4][0], k, size))
        for k, name, size in () if found else [p for p in parts if p[0] % 4 == 0 and q in p[1].lower()]:
            found[size] = min(found.get(size, (4, k, size)), (4, k, size))
        kind = ["exact_scientific", "exact_synonym", "exact_anyname", "substring"]
        want += [(q, n, size, canon[size], "no rank", kind[tier - 1]) for n, (tier, _, size) in enumerate(sorted(found.values())[:5], 1)]
    got = sorted(map(tuple, registry.QUERIES["taxon_search"](spark, sf_dir).collect()))
    assert got == sorted(want)

    first, named = {}, {}
    for _, name, size in parts:
        first.setdefault(name.lower(), size)
        named.setdefault(size, name)
    want = [(k, f"NCBITaxon:{size}", name) if size % 2 == 0 else (k, f"NCBITaxon:{first[name.lower()]}", named[first[name.lower()]]) for k, name, size in parts]
    got = registry.QUERIES["microbe_chain"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == want


def test_rank_metrics_of_every_twentieth(spark, sf_dir):
    rows = registry.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    v, ids, labels = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows]), [r.label for r in rows]
    norms, ranks = np.sqrt((v * v).sum(axis=1)), []
    for i in np.flatnonzero(ids % 20 == 0):
        sims = np.round(v @ v[i] / (norms * norms[i] + 1e-12), 9)
        order = [j for j in np.lexsort((ids, -sims)) if j != i]
        ranks += [n for n, j in enumerate(order, 1) if labels[j] == labels[i]][:1]
    ranks = np.array(ranks)
    want = [(1 / ranks).mean(), *((ranks <= k).mean() for k in (1, 3, 10)), ranks.mean()]
    got = registry.QUERIES["rank_metrics"](spark, sf_dir).first()
    assert len(ranks) > (ids % 100 == 0).sum()
    assert list(got) == pytest.approx(want, abs=2e-6)
