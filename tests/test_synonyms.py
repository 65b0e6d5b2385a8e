"""Synonyms through chains, conflicts and circles, against a walk along the pointers."""

import random

import pytest

from lucidframe.operators import synonyms


def walked(pairs):
    """Every variant's end by following one pointer after another."""
    key = lambda s: " ".join(s.lower().split())
    targets, spelling = {}, {}
    for variant, canonical in pairs:
        if variant is None or canonical is None or not variant.strip() or not canonical.strip():
            continue
        spelling[key(canonical)] = min(canonical.strip(), spelling.get(key(canonical), canonical.strip()))
        if key(variant) != key(canonical):
            targets.setdefault(key(variant), set()).add(key(canonical))
    out = {}
    for node, to in targets.items():
        seen, at = {node}, node
        while len(targets.get(at, ())) == 1 and (at == node or at not in seen):
            seen.add(at)
            at = next(iter(targets[at]))
        if len(to) > 1:
            out[node] = (None, "conflict")
        elif len(targets.get(at, ())) == 1:
            out[node] = (None, "circle")
        else:
            out[node] = (spelling[at], "merged")
    return out


def resolved(spark, pairs):
    df = spark.createDataFrame(pairs, "variant string, canonical string")
    return {r.variant: (r.target, r.status) for r in synonyms.resolve(df).collect()}


PAIRS = [
    ("y", "yes"), ("YES", "Yes"), (" yes", "Yes!"), ("Yes!", "yes!"), ("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("two", "x"), ("two", "z"), ("into two", "TWO"),
    ("U.S.A.", "United  States"), ("us", "u.s.a."), ("us", "U.S.A."), (None, "x"), ("x", None), (" ", "x"), ("same", " Same"),
]


def test_chains_conflicts_and_circles(spark):
    got = resolved(spark, PAIRS)
    assert got == walked(PAIRS)
    assert got["y"] == ("Yes!", "merged") and got["tail"] == (None, "circle") and got["two"] == (None, "conflict") and got["into two"] == ("TWO", "merged")
    assert got["us"] == ("United  States", "merged") and "same" not in got and resolved(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_long_chains_and_random_tables(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(37)] + [(f"r{i}", f"r{rng.randrange(40)}") for i in range(40)] + [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(4)]
    pairs += [(f"loop{i}", f"loop{(i + 1) % 20}") for i in range(20)] + [(f"t{i}", f"t{i + 1}" if i < 24 else "loop3") for i in range(25)]
    assert resolved(spark, pairs) == walked(pairs)


def test_report_comes_before_the_merge(spark):
    table = synonyms.resolve(spark.createDataFrame(PAIRS, "variant string, canonical string"))
    df = spark.createDataFrame([(1, "Y"), (2, " YES "), (3, "two"), (4, None), (5, ""), (6, "other"), (7, "b"), (7, "u.s.a.")], "target int, `a.name` string")
    report = {r.variant: (r.status, r.rows) for r in synonyms.synonym_report(df, "a.name", table).collect()}
    assert report["y"] == ("merged", 1) and report["yes"] == ("merged", 1)
    assert report["two"] == ("conflict", 1) and report["us"] == ("merged", 0)
    out = synonyms.merge_synonyms(df, "a.name", table)
    assert out.columns == df.columns
    assert sorted((r[0], r[1]) for r in out.collect() if r[1]) == [(1, "Yes!"), (2, "Yes!"), (3, "two"), (6, "other"), (7, "United  States"), (7, "b")]
    assert synonyms.merge_synonyms(df, "a.name", table.limit(0)).count() == 8


def test_keys_are_made_once_per_row_and_not_while_sorting(spark):
    table = synonyms.resolve(spark.createDataFrame(PAIRS, "variant string, canonical string"))
    df = spark.createDataFrame([(1, "Y"), (2, " yes "), (3, None)], "row int, name string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = synonyms.merge_synonyms(df, "name", table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not [line for line in plan.split("\n") if "Sort [" in line and "regexp_replace" in line or "Sort [CASE" in line]
        assert sorted(map(tuple, out.collect())) == [(1, "Yes!"), (2, "Yes!"), (3, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
