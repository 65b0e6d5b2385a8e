"""Conversation repair, hard negatives and MinHash near-dedup against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.llm import conversation_repair, hard_negatives, minhash, queries
from lucidframe.llm.words import shingle_sets

from .plain_repair import plain_report

TURNS = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, schema=TURNS, times=None, **kwargs):
    out = conversation_repair.repair_conversations(spark.createDataFrame(rows, schema), times=times, **kwargs)
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_repair.text_digests(out.pieces).collect()}
    return {r.conv_id: (*r[1:], digests[r.conv_id]) for r in out.reports.collect()}


def talk(rng, n, texts):
    return [(t, rng.choice(["user", "assistant", "system", "tool", ""]) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice(texts)) for t in range(n)]


@pytest.mark.parametrize("costs", [{}, {"insert": 1, "delete": 3}, {"insert": 1, "rerole": 1, "truncated": 0}, {"rerole": 2, "delete": 2, "insert": 2}])
def test_repair_equals_the_plain_version(spark, costs):
    rng = random.Random(str(costs))
    convs = {c: talk(rng, rng.choice([0, 1, 2, 3, 7, 12]), ["Yes.", "no", "", " \t", *(f"text {i}!" for i in range(30)), "wörter?"]) for c in range(60)}
    got = repaired(spark, [(c, *row) for c, rows in convs.items() for row in rows], costs=conversation_repair.EditCosts(**costs))
    assert got == {c: plain_report(rows, **costs) for c, rows in convs.items() if rows}


def test_a_conversation_over_many_partitions_is_one(spark):
    rng = random.Random(5)
    rows = talk(rng, 3000, ["Yes.", "no", "", *(f"text {i}{end}" for i in range(2000) for end in ".x")])
    short = {c: talk(rng, 3, ["Hm.", "so"]) for c in (1, 3)}
    got = repaired(spark, [(2, *row) for row in rows] + [(c, *row) for c in short for row in short[c]])
    assert got == {2: plain_report(rows)} | {c: plain_report(short[c]) for c in short}


def test_pieces_of_long_texts_are_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_CHARS", 100)
    rows = [(t, ("user", "assistant")[t % 2], f"{t} " + "long text " * 30 + ".") for t in range(40)]
    assert repaired(spark, [(1, *row) for row in rows])[1] == plain_report(rows)


def test_repair_of_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 9, "user", "Hi."), (2, 3, "user", None), (2, 3, "assistant", "a.")]
    got = repaired(spark, rows)
    assert got[None] == plain_report([(None, " ", " "), (1, "user", "Hi.")])
    assert got[1] == plain_report([(None, "user", "Hi."), (None, "user", "Hi."), (2, "assistant", "Yes."), (9, "user", "Hi.")])
    assert got[2] == plain_report([(3, "assistant", "a."), (3, "user", " ")])
    assert repaired(spark, []) == {}
    copies = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")]
    assert repaired(spark, copies)[1] == plain_report([row[1:] for row in copies])
    assert repaired(spark, [(1, 0, "user", "Hi.", 3)], TURNS + ", times int", F.col("times"))[1] == plain_report([(0, "user", "Hi.")] * 3)


def test_repair_leaves_clashing_columns_alone(spark):
    schema = TURNS + ", audit string, part int, kind string, digest string, seen boolean"
    assert repaired(spark, [(1, 0, "user", "Hi.", "x", 1, "row", "d", True), (1, 1, "assistant", "Yes.", "x", 1, "row", "d", True)], schema)[1][6] == "KK"


def test_ranked_paths_are_the_least_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 12
        arcs = [(v, label, w) for v in range(n - 1) for label in rng.permutation(4)[: rng.integers(1, 4)] for w in [int(rng.integers(v + 1, n))]]
        labels, pointers = conversation_repair.ranked_paths(*(np.array(x) for x in zip(*arcs, strict=True)), n)

        def words(v, arcs=arcs):
            ways = [chr(b"DIKR"[label]) + rest for a, label, w in arcs if a == v for rest in words(w)]
            return ways or [""]

        assert [a.decode() for a in conversation_repair.audits(labels, pointers, np.arange(n))] == [min(words(v)) for v in range(n)]


def plain_negatives(rows, anchor):
    """rows of (id, label, vector); the anchor's answers the plain way."""
    usable = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(usable):
        if not anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        others = sorted((-score(w), j, k) for k, (j, _, w) in enumerate(usable) if k != n and len(w) == len(v))
        for s, j, _ in [o for o in others if usable[o[2]][1] == label][:5]:
            fitting = [o for o in others if usable[o[2]][1] != label and 30 * -s <= 100 * -o[0] <= 90 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fitting[:10], 1)]
    return sorted(out)


def mined(spark, rows, schema="vec_id long, label int, embedding array<float>"):
    out = hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), anchors="id % 10 = 0")
    return sorted(tuple(r) for r in out.collect())


def test_negatives_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in np.float32(rng.normal(size=6) * 0.4 + 0.3)]) for i in range(300)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0) != []
    coarse = [(i, label, [round(x * 2) / 2 for x in v]) for i, label, v in rows]  # many ties
    assert mined(spark, coarse) == plain_negatives(coarse, lambda i: i % 10 == 0)
    hot = [(i, 0 if i % 3 else i % 5, v) for i, _, v in rows]
    assert mined(spark, hot) == plain_negatives(hot, lambda i: i % 10 == 0)


def test_negatives_of_nulls_and_repeats(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [(10, 1, v(1, 1)), (10, 1, v(1, 1)), (11, 1, v(1, 0)), (12, 2, v(1, 0)), (None, 2, v(1, 0)), (13, None, v(1, 0)), (14, 2, None), (15, 2, [1.0, None]), (16, 2, v(float("nan"), 1)), (17, 2, v(float("inf"), 1)), (20, 2, v(0.5, 0.5)), (18, 2, v(1, 0)), (19, 3, v(1)), (30, 1, []), (31, 2, []), (40, 5, v(0, 0)), (41, 5, v(0, 0)), (50, 6, v(-1, 0)), (51, 6, v(1, 0))]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0) != []
    assert mined(spark, []) == []
    extra = spark.createDataFrame([(0, 1, v(1, 1), 7, "x"), (1, 1, v(1, 1), 7, "x"), (2, 2, v(1, 0), 7, "x")], "vec_id long, label int, embedding array<float>, row int, vector string")
    assert [tuple(r) for r in hard_negatives.hard_negatives(extra).collect()] == [(0, 1, 1, 2, 131072, 65536)]


def test_packed_products_are_exact():
    rng = np.random.default_rng(2)
    for scale in (1, 200, 1 << 14, 1 << 20, 1 << 26, 1 << 40):
        a, b = np.floor(rng.normal(size=(5, 33)) * scale), np.floor(rng.normal(size=(17, 33)) * scale)
        exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert hard_negatives.packed_scores(a, b).tolist() == exact


def plain_components(docs):
    """Components over all pairs of 4-word shingle sets with similarity >= 0.8."""
    import pyarrow as pa

    sets = [set(f.tolist()) for _, f in shingle_sets(pa.array([t for _, t in docs], pa.string()), 4)] if docs else []
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(docs))


def near(spark, docs, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, schema)).collect())


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 4, 8, 60, 300]))]
        for _ in range(12):
            docs.append([word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base])
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(500, ""), (501, " \n"), (502, docs[0][0]), (503, "ONE two"), (504, "one TWO "), (505, None)]
    assert near(spark, docs) == plain_components(docs)


def test_near_duplicates_of_nulls_and_repeats(spark):
    text = "a b c d e f g h"
    assert near(spark, []) == []
    assert near(spark, [(1, text), (1, text), (1, "other words of this text here")]) == [(1, 3, 1, True), (1, 5, 1, True), (1, 5, 1, True)]
    got = minhash.near_duplicates(spark.createDataFrame([(None, text), (3, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (2, 2, True), (3, 2, False)]
    clash = [(1, text, 5, "x", 1), (2, text, 5, "x", 1)]
    assert near(spark, clash, "doc_id long, text string, node int, digest string, component_id int") == [(1, 5, 1, True), (2, 5, 1, False)]


def test_one_very_long_text(spark):
    rng = random.Random(6)
    words = [str(rng.random()) for _ in range(150_000)]
    got = near(spark, [(1, " ".join(words)), (2, " ".join(words[:-9_000])), (3, " ".join(words[:60_000]))])
    assert [r[2] for r in got] == [1, 1, 3]


def test_posterior_bounds():
    bounds = minhash.least_agreeing(1e-6, 0.8)
    assert bounds == sorted(bounds) and all(minhash.posterior_above(b, 32 * (i + 1), 0.85) >= 1e-6 > minhash.posterior_above(b - 1, 32 * (i + 1), 0.85) for i, b in enumerate(bounds))
    assert minhash.posterior_above(32, 32, 0.85) > 0.99


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    import zlib

    got = {(r.conv_id, r.turn): (r.role, r.text, r.times) for r in queries.damaged_turns(spark.createDataFrame(rows, TURNS)).collect()}
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        expected = {1: (role, "", 1), 2: (role, "A b c", 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(harm, (role, text, 1))
        assert got.get((c, t)) == (None if harm == 0 else tuple(" " if x is None else x for x in expected))
