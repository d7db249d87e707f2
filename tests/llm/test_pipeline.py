"""Stages of the pipeline, each on its own input, against brute force."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from provloom.llm import secrets
from provloom.llm.common import table

from .test_llm_operators import brute_groups, brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mix"]


def test_language_stage_drops_what_has_no_language(spark, documents, sf_dir):
    odd = spark.createDataFrame([(10**6, "123 456 %%", "en", "s", 10), (10**6 + 1, None, "en", "s", 0)], documents.schema)
    got = pipeline.identify_languages(spark, documents.unionByName(odd), sf_dir)
    assert got.columns == COLUMNS and ids(got) == ids(documents)


def test_near_duplicate_stage(spark, documents, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    twice = documents.unionByName(documents.where("doc_id < 3"))
    got = pipeline.drop_near_duplicates(spark, twice, sf_dir)
    assert got.columns == COLUMNS
    assert ids(got) == sorted(i for i, (_, root) in brute_groups(rows, 80).items() if root == i)


def test_contamination_stage(spark, documents, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = []
    for r in documents.collect():
        n, hit, _ = brute_hits(r.text, items) if len(r.text) < 8000 else (1, 0, [])
        if len(r.text) >= 8000 or not (hit and 20 * hit >= n):
            want.append(r.doc_id)
    assert ids(pipeline.drop_contaminated(spark, documents.where(F.length("text") < 8000), sf_dir)) == [i for i in sorted(want) if i in set(ids(documents.where(F.length("text") < 8000)))]


def test_secret_stage(spark, documents, sf_dir):
    got = pipeline.take_out_secrets(spark, documents, sf_dir)
    old = {r.doc_id: r.text for r in documents.collect()}
    assert got.columns == COLUMNS
    for r in got.collect():
        assert r.text == secrets.redact(old[r.doc_id], secrets.scan(old[r.doc_id])) and r.n_chars == len(r.text)
        assert not secrets.scan(r.text)


def test_mix_stage_and_run(spark, documents, sf_dir):
    got = pipeline.mix_to_weights(spark, documents, sf_dir)
    rows = got.collect()
    assert got.columns == [*COLUMNS, "size", "source_size", "target", "taken"] and all(r.taken > 0 for r in rows)
    targets = {r.source: r.target for r in rows}
    for s, t in targets.items():
        assert sum(r.taken for r in rows if r.source == s) == round(t)
    out = pipeline.run(spark, sf_dir)
    assert out.columns == got.columns and 0 < out.count() <= documents.count()


def test_nulls_and_empty_tables(spark, documents, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (1, "x", None, None, 1), (1, "x", None, None, 1)], documents.schema)
    for df in (odd, documents.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, df, sf_dir).count() <= df.count()


def test_near_duplicate_stage_keeps_rows_not_ids(spark, documents, sf_dir):
    say = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [
        (None, say("a")), (None, say("b")), (None, say("c") + " end"),  # null ids: texts of their own, and a copy of (7, c)
        (5, say("d")), (5, say("e")), (5, say("f")), (3, say("f") + " end"),  # one id, three texts; the last is a copy of (3, f)
        (7, say("c")), (9, say("g")), (9, say("g")), (8, say("h")), (8, say("h").upper()),  # repeated rows; one id, one set, two texts
        (None, say("k")), (None, say("k")), (1, ""), (None, None),
    ]
    want = [(None, say("a")), (None, say("b")), (5, say("d")), (5, say("e")), (3, say("f") + " end"), (7, say("c")), (9, say("g")), (None, say("k")), (1, ""), (None, None)]
    kept = set()
    for parts in (1, 5):
        made = [(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(made[:: 1 if parts == 1 else -1], documents.schema).repartition(parts)
        got = pipeline.drop_near_duplicates(spark, df, sf_dir)
        assert got.columns == COLUMNS
        found = sorted(map(tuple, got.collect()), key=repr)
        kept.add(tuple(found))
        pairs = [(i, t.lower() if i == 8 else t) for i, t, *_ in found]
        assert sorted(pairs, key=repr) == sorted([*want, (8, say("h"))], key=repr)
        assert {(i, s) for i, _, _, s, _ in found} >= {(9, "s8"), (None, "s12")}
    assert len(kept) == 1  # whatever the order of the rows


def test_language_stage_is_that_of_direct_models(spark, documents, sf_dir):
    """The stage's choice over a few languages and texts, by probabilities straight from their definition."""
    import random

    from provloom.llm import langid

    from .test_llm_operators import kneser_ney

    rng = random.Random(21)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 7))) for _ in range(n))
    rows = [(i, say("aabbcd" if i % 2 else "ddeeff", 25), "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    rows += [(100, say("ghijk", 40), None, "s", 1), (101, say("aabbcd", 8) + " " + say("xyz", 30), None, "s", 1), (102, say("abcdef", 30), None, "s", 1), (103, "12", None, "s", 1)]
    docs = spark.createDataFrame(rows, documents.schema)
    labelled = pipeline.held_out(docs).where("lang is not null and not held_out").collect()
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "shiftrightunsigned(xxhash64(cast(doc_id as string)), 1) as h").collect()}
    samples = {}
    for r in sorted(labelled, key=lambda r: order[r.doc_id]):
        samples.setdefault(r.lang, []).append(r.text)
    model = langid.fit(samples)
    direct = [kneser_ney([w for i, t in enumerate(samples[x]) if i % 5 != 4 or len(samples[x]) < 10 for w in langid.words_of(t)]) for x in model.languages]
    kept = []
    for i, text, *_ in rows:
        words = langid.words_of(text)
        n = sum(len(w) + 1 for w in words)
        rates = []
        for p in direct:
            padded = ["\x01" * (langid.ORDER - 1) + w + "\x02" for w in words]
            rates.append(-sum(math.log(p(s[k], s[:k], model.floor)) for s in padded for k in range(langid.ORDER - 1, len(s))) / n if n else 0)
        if n:
            limit, per_char, per_text = model.calibration[rates.index(min(rates))]
            if min(rates) - limit <= langid.REJECT_AT * math.sqrt(per_char / n + per_text):
                kept.append(i)
    assert {100, 103}.isdisjoint(kept) and set(range(40)) <= set(kept)
    assert ids(pipeline.identify_languages(spark, docs, sf_dir)) == kept
