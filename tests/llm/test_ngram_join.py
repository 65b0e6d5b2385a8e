"""N-gram links against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lucidframe.llm import ngram_join as nj
from lucidframe.llm.words import shingle_sets

from .helpers import DOCS, changed, edge_rows, prose, table


def plain_sets(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    return sets


def brute_components(rows):
    sets = plain_sets([r[1] for r in rows])
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is None or b[0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = root(a[0]), root(b[0])
                parent[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True)), key=repr)


def corpus():
    rng = random.Random(1)
    rows, passage = [], prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([6, 12, 30, 45, 60, 120, 300]), 5000)
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((100 + len(rows), changed(rng, base, rng.randrange(0, 1 + len(base.split()) // 18))))
    rows += [(1000 + i, prose(rng, rng.randrange(5, 60), 5000) + " " + passage + " " + prose(rng, 10, 5000)) for i in range(40)]
    hot = prose(rng, 140, 5000)
    rows += [(2000 + i, changed(rng, hot, rng.randrange(0, 8))) for i in range(80)]
    return rows


def test_sets_are_those_of_plain_python():
    texts = [r[1] for r in edge_rows()] + [r[1] for r in corpus()[:40]] + ["A b\x0bC\x0cd e\x1cf g", "Ä b c d E", " x"]
    found = dict(shingle_sets(pa.array(texts, pa.string())))
    for i, want in enumerate(plain_sets(texts)):
        assert len(found[i]) == len(want)


def test_links_of_all_kinds(spark):
    rows = corpus()
    assert sorted(map(tuple, nj.jaccard_components(table(spark, rows, DOCS)).collect()), key=repr) == brute_components(rows)


def test_edges(spark):
    rows = edge_rows()
    got = sorted(map(tuple, nj.jaccard_components(table(spark, rows)).collect()), key=repr)
    want = brute_components(rows)
    assert got == want
    kept = nj.keep_one_per_group(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 1, 2, 3, 4, 6, 8], key=repr)


def test_empty_and_clashing_columns(spark):
    assert nj.jaccard_components(table(spark, [])).count() == 0
    assert nj.keep_one_per_group(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f", "x", 9), (2, "a b c d e f", "y", 8)]
    docs = table(spark, rows, "doc_id long, text string, node string, component_id long")
    assert [tuple(r) for r in nj.keep_one_per_group(docs).collect()] == [rows[0]]


@pytest.mark.parametrize("size", [33, 42, 43, 57, 100, 700, 5000])
def test_similar_sets_share_an_own_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        apart = size // 3  # the union is 4/3 of what is shared
        cut = int(rng.integers(0, apart + 1))
        extra = rng.integers(0, 1 << 63, apart, dtype=np.uint64)
        x, y = np.unique(np.concatenate((shared, extra[:cut]))), np.unique(np.concatenate((shared, extra[cut:])))
        (own_x, next_x), (own_y, next_y) = nj.signatures(x), nj.signatures(y)
        found = np.intersect1d(own_x, np.concatenate((own_y, next_y))).size + np.intersect1d(own_y, next_x).size
        assert found, (len(x), len(y))
        assert np.bitwise_count((nj.sketch(x) ^ nj.sketch(y)).view(np.uint64)).sum() <= apart
