"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity >= 3/4 differ in at most (|x| + |y|) / 7 features and differ in size by at
most 4/3. Sizes are cut into bands of that ratio; a band pair shares a partitioning of the feature domain
into more parts than features that may differ. Some parts are then untouched by the differences, and the
digest of the features in such a part is a signature that both sets have. Per band pair the first
`PARTS` parts are enumerated: with at least 2 of 5 parts agreeing even at the threshold, a pair
misses all of them with probability under 0.6 ** PARTS (1e-10). Sets up to `SMALL` features take
single features instead (enough of them that two similar sets must share one), which is exact.

A set takes part in two band pairs: as one of the larger band in its own, and as one of the smaller band in the
next. Two sets of the smaller band meet in their own band pair, so here only pairs with one of the larger band count.

The members of a signature are first paired with a few pivots, compared by a lower bound of their difference, then by
whole sets. Only where a signature still holds several components are the members outside its largest component
compared with all others, so copies never meet in all pairs.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import columns_of, written
from .words import mix, shingle_sets

SMALL = 42
PARTS = 48
PARTS_PER_DIFFERENCE = 1.25
LARGEST = 1 << 40  # bands reach beyond any text

PIVOTS = [0, -1, 0x3C6EF372FE94F82B, -0x4AB325AA0D1B5C71]  # a pivot is the member next to each of these numbers

_U = np.uint64
_NONE = np.zeros(0, np.uint64)
SKETCH_BITS = 1024
_SKETCH = [f"sketch{i}" for i in range(SKETCH_BITS // 64)]


def _tops() -> np.ndarray:
    tops, top = [], SMALL
    while top < LARGEST:
        top = top * 4 // 3
        tops.append(top)
    return np.array(tops)


_TOPS = _tops()


def _part_signatures(features: np.ndarray, band: int) -> np.ndarray:
    """Digests of the features in each of the first parts, for sets of at most _TOPS[band] features."""
    parts = int(PARTS_PER_DIFFERENCE * (2 * int(_TOPS[band]) // 7)) + 4
    spread = mix(features ^ _U(band * 7919 + 1))
    part = (((spread >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
    kept = part < PARTS
    part, values = part[kept], mix(spread[kept])
    if len(part) == 0:
        return np.zeros(0, np.uint64)
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    firsts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return mix(np.add.reduceat(values, firsts) + part[firsts].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(band + 1))


def signatures(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted feature set in its own band pair and in the next one.

    Two sets with similarity >= 3/4 share one that is at least one's own.
    """
    n = len(features)
    own, following = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if 0 < n <= SMALL:
        own = mix(features[: n - (3 * n + 3) // 4 + 1] ^ _U(0x5BF03635))
    if 4 * n >= 3 * (SMALL + 1):
        band = int(np.searchsorted(_TOPS, n))
        own, following = np.concatenate((own, _part_signatures(features, band))), _part_signatures(features, band + 1)
    return own, following


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of hash buckets: two sets differ in at least as many features as their sketches in bits."""
    odd = np.bincount((mix(features) & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_digest(features: np.ndarray) -> int:
    total = mix(features).sum(dtype=np.uint64) + _U(len(features))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NONE, *arrays]).view(np.int64)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        sizes, digests = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sketches, own, following = np.zeros((n, len(_SKETCH)), np.int64), [_NONE] * n, [_NONE] * n
        for row, features in shingle_sets(batch.column(1)):
            sizes[row] = len(features)
            if len(features):
                digests[row], sketches[row] = set_digest(features), sketch(features)
                own[row], following[row] = signatures(features)
        columns = [batch.column(0), pa.array(sizes), pa.array(digests)] + [pa.array(sketches[:, i]) for i in range(len(_SKETCH))]
        yield pa.RecordBatch.from_arrays([*columns, _lists(own), _lists(following)], ["doc_id", "n_shingles", "node", *_SKETCH, "own", "following"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for _, features in shingle_sets(batch.column(0)):
            nodes.append(set_digest(features))
            sets.append(features.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "features"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            merged = np.sort(np.concatenate((x, y)))
            shared = int((merged[1:] == merged[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(merged) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _may_link(x: str, y: str) -> Column:
    """Not ruled out by the sizes or by the sketches."""
    size_x, size_y = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH), F.lit(0))
    return (4 * F.least(size_x, size_y) >= 3 * F.greatest(size_x, size_y)) & (7 * differ <= size_x + size_y)


def _links(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set digests whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(classes, "node").select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(wanted, "doc_id").select("text").mapInArrow(_sets, "node long, features binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("features").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("features").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set size and the smallest id reachable by links.

    Rows keep their number: repeated rows are returned as often. A null or empty text, or one without words, has
    an empty set and links with nothing. A row with a null id is returned with a null component and links with
    nothing. Other columns are not looked at. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = written(texts.mapInArrow(_describe, "doc_id long, n_shingles long, node long, " + ", ".join(f"{s} long" for s in _SKETCH) + ", own array<long>, following array<long>"))
    filled = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(filled.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ["n_shingles", *_SKETCH])))

    signed = filled.select("node", F.lit(1).alias("larger"), F.explode("own").alias("signature"))
    signed = signed.unionByName(filled.select("node", F.lit(0).alias("larger"), F.explode("following").alias("signature")))
    shared = signed.groupBy("signature").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max("larger").alias("largest")).where("first <> last AND largest = 1")
    members = written(signed.join(shared.select("signature"), "signature").distinct())

    described_as = lambda side: classes.select(F.col("node").alias(side), F.struct("n_shingles", *_SKETCH).alias(f"of_{side}"))
    nearest = [F.min(F.col("node").bitwiseXOR(F.lit(p))).bitwiseXOR(F.lit(p)) for p in PIVOTS]
    pivots = members.where("larger = 1").groupBy("signature").agg(F.array_distinct(F.array(*nearest)).alias("pivots"))
    stars = members.join(pivots, "signature").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    stars = written(stars.join(described_as("b"), "b").join(described_as("a"), "a").where(_may_link("of_a", "of_b")).select("a", "b"))
    links = written(_links(texts, classes, stars))

    labels = components(links)
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("signature", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("signature").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    rows = written(labelled.join(mixed, "signature").join(described_as("node"), "node"))
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")
    apart = (F.col("x.larger") + F.col("y.larger") > 0) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    crossed = x.join(y, (F.col("x.signature") == F.col("y.signature")) & apart & _may_link("x.of_node", "y.of_node"))
    crossed = crossed.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    crossed = written(crossed.join(stars, ["a", "b"], "left_anti"))
    links = written(links.union(_links(texts, classes, crossed)))

    reps = classes.select("node", "rep")
    named = links.join(reps.withColumnsRenamed({"node": "a", "rep": "x"}), "a").join(reps.withColumnsRenamed({"node": "b", "rep": "y"}), "b")
    found = components(named, "x", "y")
    out = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")).alias("node"))
    out = out.join(reps, "node", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of every group of near duplicates: that with the smallest id.

    Texts without words and rows with a null id all stay. Rows that repeat an id and a sequence of words are one: the least by
    all columns stays. Different texts under one id all stay.
    """
    groups = jaccard_components(docs, id_col, text_col)
    kept = written(groups.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("times"), F.max("n_shingles").alias("words")))
    ids = kept.select(F.col("doc_id").alias("__kept"))
    key = F.col(id_col).cast("long")
    repeats = kept.where("times > 1 AND words > 0").select(F.col("doc_id").alias("__kept"))
    if repeats.isEmpty():
        return docs.where(F.col(id_col).isNull()).unionByName(docs.join(ids, key == F.col("__kept"), "left_semi"))
    single = docs.join(ids.join(repeats, "__kept", "left_anti"), key == F.col("__kept"), "left_semi")
    words = F.trim(F.regexp_replace(F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase), r"[\x20\x09-\x0D]+", " "))
    several = docs.join(repeats, key == F.col("__kept"), "left_semi").groupBy(key.alias("__kept"), F.md5(words).alias("__words"))
    least = several.agg(F.min(F.struct(*columns_of(docs))).alias("__least")).select("__least.*")
    return docs.where(F.col(id_col).isNull()).unionByName(single).unionByName(least)
