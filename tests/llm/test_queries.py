"""Registered queries against their SQL, or against the tokenizers library, at the smallest scale; the pipeline's stages."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from turnout.llm.queries import ORACLE, QUERIES, TOKENIZER

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def encoded(tables):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rows = tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    return {k: (e.ids, library.decode(e.ids, skip_special_tokens=False)) for (k, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, str(SF))
    result = tables.execute(ORACLE[name])
    order = sorted(df.columns)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == order
    place = [columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)


def test_token_queries_match_the_library(spark, encoded):
    ids = {k: np.array(v, "<u4").tobytes() for k, (v, _) in encoded.items()}
    nine = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_word_bpe"](spark, str(SF)).collect()}
    assert nine == {k: (len(v), hashlib.sha256(ids[k]).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, (v, t) in encoded.items()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, str(SF)).collect()} == {k: len(v) for k, (v, _) in encoded.items()}
    pieces = QUERIES["op6_packing"](spark, str(SF)).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    for r in pieces:
        own = (encoded[r.doc_id][0] + [1])[r.start:r.start + r.length]
        assert len(own) == r.length and r.length & r.length - 1 == 0 and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in pieces) == sum(len(v) + 1 for v, _ in encoded.values())


def test_url_query_covers_every_page(spark, tables):
    rows = QUERIES["op1_url_filter"](spark, str(SF)).collect()
    assert sorted(r.page_id for r in rows) == sorted(x for (x,) in tables.execute("SELECT page_id FROM pages").fetchall())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus():
    clean = lambda seed, n=80: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 5003}" for i in range(n))
    rows = [(i, clean(i)) for i in range(120)]
    rows += [(200, clean(3)), (201, clean(4) + " end"), (202, clean(5, 200)[:400] + " " + clean(900)), (203, clean(901, 100) + " " + " ".join(clean(6).split()[:60]))]
    rows += [(204, clean(902) + " token = abcdef0123"), (205, None), (206, ""), (207, "x " * 50), (None, clean(903)), (120, clean(904)), (120, clean(904))]
    return [(k, t, "en", "s", None if t is None else len(t), "e") for k, t in rows]


def test_pipeline_stages_take_effect(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    quality, near, passages, secret, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and not {205, 206, 207} & set(ids) and set(range(120)) <= set(ids) and None in ids
    single = near(spark, kept, "")
    ids = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and not {200, 201} & set(ids) and ids.count(120) == 1 and None in ids and set(range(120)) <= set(ids)
    cut = passages(spark, single, "")
    texts = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and texts[203].text == " ".join(corpus()[123][1].split()[:100]) and texts[6].text == corpus()[6][1]
    assert all(r.n_chars == len(r.text) for r in texts.values())
    clean = secret(spark, cut, "")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts[204].endswith(" [REDACTED]") and texts[7] == corpus()[7][1]
    assert packing(spark, clean, "").agg(F.countDistinct("doc_id")).first()[0] == len({k for k in texts if k is not None})


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        if "text" not in docs.columns:
            break


def test_pipeline_runs_over_the_table(spark):
    pieces = corpus_pipeline.run(spark, str(SF)).collect()
    assert pieces and all(r.length & r.length - 1 == 0 for r in pieces)
