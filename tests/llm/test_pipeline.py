"""The pipeline's stages one after the other, against plain versions."""

from __future__ import annotations

import corpus_pipeline
from lucidframe.llm import ngram_join

from .helpers import DOCS, edge_rows, table
from .test_free_style import check_packed, labelled
from .test_native import brute_spans
from .test_ngram_join import brute_components


def test_stages(spark):
    rows = labelled(spark)
    long = " ".join(f"house{i} water" for i in range(60))
    rows += [(500 + i, f"{long} variant{i}", "en", "s0", 0) for i in range(5)] + [(600, "the token = 'abcdefgh' here", "en", "s1", 27)] + edge_rows()
    docs = table(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "secret_scans", "mixing", "packing"]

    named = stages["language_id"](spark, docs, "")
    assert sorted({r[0] for r in rows if r[0] is not None} - {r.doc_id for r in named.collect()}) == [1, 2, 3, 6]
    kept_rows = [tuple(r) for r in named.collect()]
    single = stages["ngram_join"](spark, named, "")
    want = {c for _, _, c in brute_components(kept_rows) if c is not None}
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == want and 500 in want and 501 not in want
    masked = stages["secret_scans"](spark, single, "")
    assert masked.count() == single.count() and not any(brute_spans(r.text) for r in masked.collect())
    mixed = stages["mixing"](spark, masked, "")
    assert 0 < mixed.count() < masked.count() and mixed.columns == docs.columns
    check_packed([tuple(r) for r in mixed.collect()], stages["packing"](spark, mixed, "").collect())

def test_empty(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_other_columns_pass_through(spark):
    rows = [(i, f"the house number {i} near water", "en", "a", 30, i, "x", i) for i in range(30)] + [(50, "the token = 'abcdefgh' here", "en", "a", 30, 9, None, None)]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, tokens long, `a.b` string, component_id long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        assert {r["tokens"] for r in out.collect()} <= set(range(30))


def test_different_texts_of_one_id_all_stay(spark):
    rows = [(1, "a b c d e f g", "en", "x", 13), (1, "A b c  d e f g", "en", "y", 14), (1, "totally other words stand in this text", "en", "x", 30), (2, "a b c d e f g", "en", "x", 13), (3, "", "en", "x", 0), (3, "", "en", "x", 0)]
    kept = ngram_join.keep_one_per_group(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[1], rows[2], rows[4], rows[5]])
