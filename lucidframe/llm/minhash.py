"""Near duplicates by MinHash bands with sequential Bayesian verification.

Every distinct shingle set is one class, known by 128 bits of digest. Its signature has `HASHES` minima; rows of `BAND` of
them are buckets, and classes that share a bucket are candidates. Two sets at the threshold share none with probability
(1 - 0.8 ** BAND) ** (HASHES // BAND), 1e-9.

Candidates are compared by two bits of every minimum, a batch of 32 minima in one long. After each batch the number that agree
gives a posterior over the similarity (uniform prior); a pair goes as soon as the posterior chance of the threshold is below
`MISS`. The bounds are constants per batch, so the whole test is one short-circuited condition of the join that finds the
candidates: pruned pairs are never rows. A certain bound follows in the same condition: parities of hash buckets differ in
no more places than the sets in features, so pairs just below the threshold, which no number of minima could tell from links
at that chance, seldom become rows either. Survivors are verified on their whole sets.

Members of a bucket first meet its pivots only. Where a bucket then still holds several components, the members outside its
largest one meet the others, so copies never meet in all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import SKETCH_BITS, sketch
from .store import written
from .words import mix, shingle_sets

SHINGLE = 4
SHARE = (80, 100)  # links: SHARE[1] * intersection >= SHARE[0] * union
BATCH, BATCHES = 32, 8
HASHES = BATCH * BATCHES
BAND = 5
MISS = 1e-7
CHUNK = 1 << 16  # features hashed at a time

_U = np.uint64
_SIGNS = [f"sign{i}" for i in range(BATCHES)]
_PARITIES = [f"parity{i}" for i in range(SKETCH_BITS // 64)]
_PIVOTS = [0, 0x3C6EF372FE94F82B]  # a pivot is the member next to each of these numbers
_FLIPS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FACTORS = mix(_FLIPS ^ _U(0xA5A5A5A5)) | _U(1)


def posterior_above(agree: int, of: int, share: float, floor: float = 0.25) -> float:
    """The chance that minima agree at a rate of at least `share` when `agree` of `of` do, every rate from `floor` on being as likely before."""
    above = lambda rate: sum(comb(of + 1, j) * rate**j * (1 - rate) ** (of + 1 - j) for j in range(agree + 1))
    return above(share) / above(floor)


def least_agreeing(miss: float = MISS, similarity: float = SHARE[0] / SHARE[1]) -> list[int]:
    """After each batch, the fewest agreeing minima with which a pair stays. Two bits of different minima agree by chance in a quarter."""
    rate = similarity + (1 - similarity) / 4
    return [next(m for m in range(n + 1) if posterior_above(m, n, rate) >= miss) for n in range(BATCH, HASHES + 1, BATCH)]


def minima(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of every hash function (columns) over each run of features that begins at `starts` (rows)."""
    out = np.empty((len(starts), HASHES), np.uint64)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((features ^ _FLIPS[i]) * _FACTORS[i], starts)
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every set; sets are hashed in runs, long ones in pieces, so memory stays bounded."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint64).max, np.uint64)
    pieces = [(row, features[i : i + CHUNK]) for row, features in enumerate(sets) for i in range(0, len(features), CHUNK)]
    while pieces:
        taken, size = 0, 0
        while taken < len(pieces) and (taken == 0 or size + len(pieces[taken][1]) <= CHUNK):
            size += len(pieces[taken][1])
            taken += 1
        now, pieces = pieces[:taken], pieces[taken:]
        starts = np.cumsum([0] + [len(x) for _, x in now[:-1]])
        found = minima(np.concatenate([x for _, x in now]), starts)
        for (row, _), least in zip(now, found, strict=True):
            np.minimum(out[row], least, out=out[row])
    return out


def signs(least: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, `BATCH` of them in one 64-bit number."""
    bits = ((least >> _U(24)) & _U(3)).reshape(len(least), BATCHES, BATCH)
    return (bits << (_U(2) * np.arange(BATCH, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def buckets(least: np.ndarray) -> np.ndarray:
    """A digest of every band of minima."""
    bands = HASHES // BAND
    rows = mix(least[:, : bands * BAND]).reshape(len(least), bands, BAND)
    places = _FACTORS[:BAND]
    return mix((rows * places).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[BAND])


def set_digests(features: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one, two = mix(features).sum(dtype=np.uint64), mix(features ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    both = mix(np.array([one, two], dtype=np.uint64) + _U(len(features))).view(np.int64)
    return int(both[0]), int(both[1])


_COMPARED = [*_SIGNS, *_PARITIES]
_NAMES = ["doc_id", "n_shingles", "digest", "digest2", *_COMPARED, "buckets"]


def _described_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    filled = [i for i, x in enumerate(sets) if len(x)]
    facts, found = np.zeros((len(sets), 3 + len(_COMPARED)), np.int64), np.zeros((0, HASHES // BAND), np.int64)
    if filled:
        least = _signatures([sets[i] for i in filled])
        facts[filled, :3] = [(len(sets[i]), *set_digests(sets[i])) for i in filled]
        facts[filled, 3 : 3 + BATCHES], found = signs(least).view(np.int64), buckets(least).view(np.int64)
        facts[filled, 3 + BATCHES :] = [sketch(sets[i]) for i in filled]
    lengths = np.zeros(len(sets) + 1, np.int32)
    lengths[np.array(filled, np.int64) + 1] = HASHES // BAND
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(found.ravel()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(facts[:, i].copy()) for i in range(facts.shape[1])), lists], _NAMES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, digests, signature and buckets of every text, in pieces of bounded size."""
    for batch in batches:
        first, held, size = 0, [], 0
        for row, features in shingle_sets(batch.column(1), SHINGLE):
            held.append(features)
            size += len(features)
            if size >= 4 * CHUNK or row + 1 == batch.num_rows:
                yield _described_batch(batch.column(0).slice(first, len(held)), held)
                first, held, size = row + 1, [], 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named, sets = [], []
        for _, features in shingle_sets(batch.column(0), SHINGLE):
            named.append(set_digests(features) if len(features) else (0, 0))
            sets.append(features.tobytes())
        one, two = (pa.array([x[i] for x in named], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([one, two, pa.array(sets, pa.binary())], ["digest", "digest2", "features"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            merged = np.sort(np.concatenate((x, y)))
            shared = int((merged[1:] == merged[:-1]).sum())
            keep.append(SHARE[1] * shared >= SHARE[0] * (len(merged) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _may_link(x: str, y: str) -> Column:
    """Sizes allow the threshold, no batch of minima leaves its posterior chance below `MISS`, and parities do not rule it out."""
    size_x, size_y = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    stays = SHARE[1] * F.least(size_x, size_y) >= SHARE[0] * F.greatest(size_x, size_y)
    differ = F.lit(0)
    for i, (name, least) in enumerate(zip(_SIGNS, least_agreeing(), strict=True)):
        bits = F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}"))
        either = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(either)
        stays = stays & (differ <= BATCH * (i + 1) - least)
    parities = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in _PARITIES), F.lit(0))
    return stays & ((SHARE[0] + SHARE[1]) * parities <= (SHARE[1] - SHARE[0]) * (size_x + size_y))


def _links(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(nodes.join(classes.select("node", "rep", "digest", "digest2"), "node"))
    read = texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("text").mapInArrow(_sets, "digest long, digest2 long, features binary")
    sets = written(read.join(wanted.select("node", "digest", "digest2"), ["digest", "digest2"]).select("node", "features").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("features").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("features").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def _facts(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("node").alias(side), F.struct("n_shingles", *_COMPARED).alias(f"of_{side}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: its set size, the smallest id reachable by links, and whether it is that one.

    Rows keep their number: repeated rows are returned as often, each kept if its id is its component's. A null or empty
    text, or one without words, has an empty set and links with nothing. A row with a null id is returned with a null
    component, links with nothing and is kept. Other columns are not looked at. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = written(texts.mapInArrow(_described, ", ".join(f"{n} long" for n in _NAMES[:-1]) + ", buckets array<long>"))
    key = ["digest", "digest2"]
    classes = described.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*key)
    classes = classes.agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ["n_shingles", *_COMPARED]), F.first("buckets").alias("buckets"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    buckets_of = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = buckets_of.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = written(buckets_of.join(shared.select("bucket"), "bucket").distinct())
    nearest = [F.min(F.col("node").bitwiseXOR(F.lit(p))).bitwiseXOR(F.lit(p)) for p in _PIVOTS]
    pivots = members.groupBy("bucket").agg(F.array_distinct(F.array(*nearest)).alias("pivots"))
    stars = members.join(pivots, "bucket").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    stars = written(stars.join(_facts(classes, "b"), "b").join(_facts(classes, "a"), "a").where(_may_link("of_a", "of_b")).select("a", "b"))
    links = written(_links(texts, classes, stars))

    labelled = members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    rows = written(labelled.join(mixed, "bucket").join(_facts(classes, "node"), "node"))
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    crossed = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & apart & _may_link("x.of_node", "y.of_node"))
    crossed = crossed.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    links = written(links.union(_links(texts, classes, written(crossed.join(stars, ["a", "b"], "left_anti")))))

    grouped = components(links).join(classes.select("node", "rep", *key), "node")
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    alone = classes.join(grouped.select("node"), "node", "left_anti").select(*key, F.col("rep").alias("component_id"))
    found = written(grouped.join(least, "component").select(*key, "component_id").union(alone))
    filled = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = described.select("doc_id", "n_shingles", *(F.when(filled, F.col(k)).alias(k) for k in key)).join(found, key, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
