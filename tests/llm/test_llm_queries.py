"""The opN queries against their SQL, or against brute force where SQL can't say it."""

import math
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provloom.llm import queries

TABLES = "documents embeddings benchmark".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_languages_held_out(spark, con, sf_dir):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op2_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_token_counts_are_the_library_s(spark, con, sf_dir):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op7_token_counts(spark, sf_dir).collect():
        n = len(lib.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def brute_base(text):
    """The three plain patterns, straight from their definitions."""
    spans = []
    key = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def test_secret_base_spans(spark):
    from provloom.llm.secrets import sha256_hex

    sf_dir = "/root/testdata/sf0.01"  # the smaller tables have none
    text = dict(duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    some = 0
    for r in queries.op9_secret_scans(spark, sf_dir).collect():
        base = brute_base(text[r.doc_id])
        assert r.base_sha256 == sha256_hex(",".join(base))
        assert set(base) <= set(r.spans.split(","))
        some += bool(base)
    assert some
