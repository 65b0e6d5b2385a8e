"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get a binary code: signs after rotations that are fitted to a bounded sample (iterative quantization). A
code is cut into bytes; each index shard has one table per byte position. If two codes differ in at most r bits,
then by the pigeonhole principle some position differs in at most its own share of r, where the shares plus one each
add up to r + 1: probing every table within its share retrieves every code within r. Those are reranked by the
inner product of the original vectors in double precision.

The radius is learned on the sample, so that `AIM` of the sample's true neighbours lie within it. A larger table has
nearer neighbours than its sample, so there recall is higher. The largest inner product becomes a smallest angle by
one more component, sqrt(M^2 - |x|^2) for rows and 0 for queries, with M the largest norm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

BITS = 128
SAMPLE = 8192  # rows that rotations and radius are learned from
SAMPLE_QUERIES = 512
AIM = 0.97
SHARD_ROWS = 8192
QUERY_BLOCK_ROWS = 4096
ROUNDS = 25


@dataclass(frozen=True)
class Codes:
    """What is learned: rotations side by side, the norm bound and the radius."""

    rotations: np.ndarray
    norm: float
    radius: int

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.packbits(np.column_stack((x, rest)) @ self.rotations > 0, axis=1)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(np.column_stack((x, np.zeros(len(x)))) @ self.rotations > 0, axis=1)


def _rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation after which the signs are near to the values."""
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.sign(x @ rotation).T @ x)
        rotation = (left @ right).T
    return rotation


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, norm: float, neighbours: int) -> Codes:
    """Rotations and radius from a sample of rows."""
    rng = np.random.default_rng(7)
    rest = np.sqrt(np.maximum(norm**2 - (sample * sample).sum(axis=1), 0.0))
    wide = np.column_stack((sample, rest))
    rotations = np.column_stack([_rotation(wide, rng) for _ in range(math.ceil(BITS / wide.shape[1]))])[:, :BITS]
    codes = Codes(rotations, norm, BITS)
    queries = sample[:SAMPLE_QUERIES]
    rows, asked = codes.of_rows(sample), codes.of_queries(queries)
    found = []
    for i, query in enumerate(queries):
        scores = sample @ query
        scores[i] = -np.inf
        nearest = np.argsort(-scores)[: min(neighbours, len(sample) - 1)]
        found.append(distances(rows[nearest], asked[i]))
    found = np.concatenate(found) if found else np.zeros(0)
    return Codes(rotations, norm, int(np.ceil(np.quantile(found, AIM))) if len(found) else BITS)


def shares(radius: int, tables: int) -> np.ndarray:
    """What each table is probed within: shares plus one each add up to radius + 1."""
    total = radius + 1
    return np.array([total // tables + (i < total % tables) - 1 for i in range(tables)])


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_BYTES = np.arange(256, dtype=np.int64)


class Tables:
    """For each byte position of a shard's codes, a table from byte value to the rows that have it there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.buckets = [np.split(np.argsort(column, kind="stable"), np.cumsum(np.bincount(column, minlength=256))[:-1]) for column in codes.T]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the buckets that some table is probed at."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for buckets, byte, share in zip(self.buckets, code.tolist(), shares(radius, len(self.buckets)), strict=True):
            if share >= 0:
                hit[np.concatenate([buckets[value] for value in np.flatnonzero(_ONES[_BYTES ^ byte] <= share).tolist()])] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: probed table by table, then checked in full."""
        rows = self.probed(code, radius)
        return rows[distances(self.codes[rows], code) <= radius]


def within(codes: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
    return Tables(codes).within(code, radius)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8)


def _searcher(radius: int, width: int, neighbours: int):
    def search(key: tuple, asked: pa.Table, indexed: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        if asked.num_rows and indexed.num_rows:
            ids, vectors, codes = indexed["vec_id"].to_numpy(), _matrix(indexed["embedding"], width), np.ascontiguousarray(_codes(indexed["code"]))
            tables = Tables(codes)
            rows = zip(asked["vec_id"].to_pylist(), asked["query_key"].to_pylist(), _matrix(asked["embedding"], width), _codes(asked["code"]), strict=True)
            for query_id, query_key, vector, code in rows:
                wanted, reach = min(neighbours, int((ids != query_id).sum())), radius
                while True:  # fewer than wanted in the radius: this shard is probed again, wider
                    found = tables.within(code, reach)
                    found = found[ids[found] != query_id]
                    if len(found) >= wanted or reach >= BITS:
                        break
                    reach = min(BITS, reach + 8)
                scores = (vectors[found] * vector).sum(axis=1)
                best = np.lexsort((ids[found], -scores))[:neighbours]
                out["query_id"] += [query_id] * len(best)
                out["query_key"] += [query_key] * len(best)
                out["vec_id"] += ids[found][best].tolist()
                out["score"] += scores[best].tolist()
        return pa.table({k: pa.array(v, pa.float64() if k == "score" else pa.int64()) for k, v in out.items()})

    return search


def nearest(vectors: DataFrame, is_query: str, neighbours: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every row of which the SQL condition `is_query` holds.

    Candidates are all rows with another id; ties go to the smaller id; fewer candidates than `neighbours` are all
    returned. Null vectors or ids, zero vectors, null or non-finite components, and vectors of another length
    than most rows take no part. Rows that repeat id and vector count once; other vectors under one id are ranked each on
    its own. An empty table gives no rows. Queries meet the index shard by shard in blocks of bounded size.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(sound)
    lengths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width = lengths.width
    rows = written(rows.where(F.size("embedding") == width).distinct())
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    size = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("norm")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()
    learned = fit(_matrix(sample["embedding"], width), size.norm, neighbours)

    def encode(of_queries: bool):
        def run(batches):
            for batch in batches:
                x = _matrix(pa.chunked_array([batch.column(1)]), width)
                codes = learned.of_queries(x) if of_queries else learned.of_rows(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

        return run

    schema = "vec_id long, embedding array<double>, code binary"
    shards, blocks = math.ceil(size.n / SHARD_ROWS), math.ceil(rows.where(is_query).count() / QUERY_BLOCK_ROWS)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    index = rows.mapInArrow(encode(False), schema).withColumn("shard", spread(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    asked = rows.where(is_query).mapInArrow(encode(True), schema).withColumn("query_key", F.xxhash64("embedding")).withColumn("block", spread(max(blocks, 1))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = asked.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInArrow(_searcher(learned.radius, width, neighbours), "query_id long, query_key long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
