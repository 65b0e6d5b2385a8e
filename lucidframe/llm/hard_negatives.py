"""Hard negatives from exact integer inner products, several candidates to a multiplication.

Components become whole numbers. Biased to be non-negative, the components of several candidates are laid side by side as fields
of one wide integer, so that one product with an anchor's component multiplies all of them; added up over the components,
each field holds one candidate's inner product of biased vectors, and taking the biases off leaves the exact score. Fields
are as wide as the largest sum needs. Integers of 53 bits stay exact in doubles, so the products of a tile are one matrix
product; vectors too large for a field in 53 bits use Python's integers with fields of any width.

Anchors are dealt into blocks and rows into shards. A cell is one block with one shard: its anchors come first, then its rows
are streamed past them in tiles, and of every list only the best are held. A row is sent once per block of anchors of its
kind, an anchor once per shard. Positives come from cells of one label; the negatives' windows follow from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # a negative's score in hundredths of the positive's
BLOCK = 1 << 14  # anchors in a block
SHARD = 1 << 16  # rows in a shard, more where the blocks alone make enough cells
TILE = 1 << 10
EXACT_BITS = 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows (whole numbers held as doubles): exact, as 64-bit integers or Python's."""
    n, d = rows.shape
    if d == 0 or n == 0 or len(anchors) == 0:
        return np.zeros((len(anchors), n), np.int64)
    low, low_a = rows.min(), anchors.min()
    widest = d * int(rows.max() - low) * int(anchors.max() - low_a)
    width = max(widest, 1).bit_length()
    fields = EXACT_BITS // width
    if fields == 0 or d * int(max(abs(low), abs(rows.max()))) * int(max(abs(low_a), abs(anchors.max()))) >= 1 << 62:
        return _wide_scores(anchors, rows)
    biased, biased_a = rows - low, anchors - low_a
    words = -(-n // fields)
    lanes = np.zeros((fields, words, d))
    lanes.reshape(fields * words, d)[:n] = biased
    packed = (lanes * (2.0 ** (width * np.arange(fields)))[:, None, None]).sum(axis=0)
    products = (biased_a @ packed.T).astype(np.int64)
    found = np.concatenate([(products >> (width * i)) & ((1 << width) - 1) for i in range(fields)], axis=1)[:, :n]
    # (a - la)(b - lb) summed is ab - la * sum(b - lb) - lb * sum(a)
    return found + (int(low_a) * biased.sum(axis=1).astype(np.int64))[None, :] + (int(low) * anchors.sum(axis=1).astype(np.int64))[:, None]


def _wide_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same with Python's integers: all rows of the tile in one integer per component."""
    whole, whole_a = [[int(x) for x in row] for row in rows], [[int(x) for x in row] for row in anchors]
    low = min(min(row) for row in whole)
    low_a = min(min(row) for row in whole_a)
    widest = len(whole[0]) * (max(max(row) for row in whole) - low) * (max(max(row) for row in whole_a) - low_a)
    width = max(widest, 1).bit_length()
    packed = [sum((row[j] - low) << (width * i) for i, row in enumerate(whole)) for j in range(len(whole[0]))]
    out = np.empty((len(whole_a), len(whole)), object)
    for k, anchor in enumerate(whole_a):
        product = sum((a - low_a) * p for a, p in zip(anchor, packed, strict=True))
        for i, row in enumerate(whole):
            out[k, i] = ((product >> (width * i)) & ((1 << width) - 1)) + low_a * sum(x - low for x in row) + low * sum(anchor)
    return out


@dataclass
class _Best:
    """The best of every list of a cell: score, id and row, by list."""

    wanted: int
    lists: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    @classmethod
    def none(cls, wanted: int) -> _Best:
        return cls(wanted, *(np.zeros(0, np.int64) for _ in range(4)))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        lists, scores, ids, rows = (np.concatenate(p) for p in ((self.lists, lists), (self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores, lists))
        ranked = lists[order]
        firsts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        place = np.arange(len(ranked)) - np.repeat(firsts, np.diff(np.concatenate((firsts, [len(ranked)]))))
        order = order[place < self.wanted]
        self.lists, self.scores, self.ids, self.rows = lists[order], scores[order], ids[order], rows[order]

    def worst(self, n: int, low: np.ndarray) -> np.ndarray:
        """The score that a new member of every list must reach."""
        out = low.copy()
        counts = np.bincount(self.lists, minlength=n)
        full = np.flatnonzero(counts >= self.wanted)
        out[full] = self.scores[np.cumsum(counts)[full] - 1]
        return out


class _Cell:
    """One block of anchors, past which rows are streamed."""

    def __init__(self, cell: int, wanted: int):
        self.cell, self.wanted, self.parts, self.tiles = cell, wanted, [], None

    def meet(self, rows: dict[str, np.ndarray], same_label: bool) -> None:
        if self.tiles is None:
            anchors = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]} if self.parts else None
            n = len(anchors["row"]) if anchors else 0
            self.tiles = [({k: v[i : i + TILE] for k, v in anchors.items()}, _Best.none(self.wanted)) for i in range(0, n, TILE)]
        step = TILE // 4  # few at first, while nothing bounds the lists from below
        first = 0
        while first < len(rows["row"]):
            now = {k: v[first : first + step] for k, v in rows.items()}
            for anchors, best in self.tiles:
                self._tile(anchors, best, now, same_label)
            first, step = first + step, 4 * TILE

    def _tile(self, anchors: dict[str, np.ndarray], best: _Best, rows: dict[str, np.ndarray], same_label: bool) -> None:
        scores = packed_scores(anchors["vector"], rows["vector"])
        kinds = anchors["low"].shape[1]
        low, high = anchors["low"].ravel(), anchors["high"].ravel()
        worst = best.worst(len(low), low).reshape(-1, kinds)
        if scores.dtype == object:  # a score beyond a long is no score
            beyond = (scores > _MOST) | (scores < _LEAST)
            scores = np.where(beyond, 0, scores).astype(np.int64)
            possible = ~beyond
            possible &= scores >= worst.min(axis=1)[:, None]
        else:
            possible = scores >= worst.min(axis=1)[:, None]
        a, r = np.nonzero(possible)
        if same_label:
            other = anchors["row"][a] != rows["row"][r]
        else:
            other = anchors["label"][a] != rows["label"][r]
        a, r = a[other], r[other]
        found = scores[a, r]
        for kind in range(kinds):
            lists = a * kinds + kind
            taken = (found >= worst[a, kind]) & (found <= high[lists])
            if taken.any():
                best.add(lists[taken], found[taken], rows["id"][r[taken]], rows["row"][r[taken]])

    def results(self) -> Iterator[pa.RecordBatch]:
        for anchors, best in self.tiles or []:
            kinds = anchors["low"].shape[1]
            at, kind = best.lists // kinds, best.lists % kinds
            columns = [anchors["row"][at], kind.astype(np.int32), best.ids, best.scores, best.rows]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_row", "kind", "vec_id", "score", "row"])


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a run of one cell and kind as arrays; vectors as whole numbers."""
    out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "id", "label")}
    lists = batch.column("vector")
    with np.errstate(over="ignore"):
        out["vector"] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(batch.num_rows, -1)
    return out


def _windows(batch: pa.RecordBatch, kinds: int) -> dict[str, np.ndarray]:
    """The bounds of every list of an anchor; an empty range where it has fewer lists."""
    low, high = np.full((batch.num_rows, kinds), _MOST), np.full((batch.num_rows, kinds), _LEAST)
    for i, scores in enumerate(batch.column("positives").to_pylist()):
        for k, p in enumerate(scores):
            if p >= 0:  # below 0 the lower bound is above the upper one
                low[i, k], high[i, k] = -(-LOWEST * p // 100), HIGHEST * p // 100
    return {"low": low, "high": high}


def _mined(wanted: int, kinds: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows of every anchor's lists, cell by cell; without `kinds` one list per anchor, of rows other than itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            marks = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if end == start:
                    continue
                run = batch.slice(start, end - start)
                if cell is None or cell.cell != marks[0][start]:
                    if cell is not None:
                        yield from cell.results()
                    cell = _Cell(marks[0][start], wanted)
                numbers = _numbers(run)
                if marks[1][start]:
                    cell.meet(numbers, kinds is None)
                elif kinds is None:
                    cell.parts.append(numbers | {"low": np.full((run.num_rows, 1), _LEAST), "high": np.full((run.num_rows, 1), _MOST)})
                else:
                    cell.parts.append(numbers | _windows(run, kinds))
        if cell is not None:
            yield from cell.results()

    return run


_RESULT = "anchor_row long, kind int, vec_id long, score long, row long"


def _in_cells(anchors: DataFrame, rows: DataFrame, kind: list[str], wanted: int, kinds: int | None) -> DataFrame:
    """Every anchor's best rows of its kind, per shard."""
    spark = rows.sparkSession
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = anchors.groupBy(*kind).agg(F.count("*").alias("n")).join(rows.groupBy(*kind).agg(F.count("*").alias("m")), kind)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = sized.select(*kind, blocks.alias("blocks"), F.greatest(F.lit(1), F.least(F.ceil(F.col("m") / SHARD), F.ceil(F.lit(cells) / blocks))).cast("int").alias("shards"))
    sized = written(sized)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = anchors.join(sized, kind).select("*", dealt("blocks").alias("block"), every("shards").alias("shard"), F.lit(False).alias("is_row"))
    met = rows.join(sized, kind).select("*", every("blocks").alias("block"), dealt("shards").alias("shard"), F.lit(True).alias("is_row"))
    met = met.withColumn("positives", F.lit(None).cast("array<long>"))
    columns = [F.xxhash64(*kind, "block", "shard").alias("cell"), "is_row", "row", "id", "label", "vector", "positives"]
    both = given.select(*columns).union(met.select(*columns))
    return both.repartition("cell").sortWithinPartitions("cell", "is_row").mapInArrow(_mined(wanted, kinds), _RESULT)


def _best_of(found: DataFrame, by: list[str], wanted: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= wanted)


def hard_negatives(vectors: DataFrame, label: Column | None = None, anchors: str = "id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among `vectors`.

    `anchors` is a condition on `id`. Scores are inner products of floor(256 * x); higher ones come first, ties by id. An
    anchor's positives are its first 5 other rows of the same label, its negatives for each the first 10 rows of other
    labels with 30 to 90 hundredths of the positive's score. Rows with a null id, label or vector, or a null or non-finite
    component take no part; a repeated row is an anchor, positive or negative each time. Vectors of different lengths have
    no inner product, scores beyond 64 bits are none. Positives with a score below 0 have no negatives. An empty table
    gives no rows; other columns are not looked at.
    """
    whole = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x * F.lit(float(SCALE))) < F.lit(float("inf"))))
    named = vectors.where(whole & F.col(id_col).isNotNull())
    named = named.select(F.col(id_col).cast("long").alias("id"), F.coalesce(label, F.lit(None)).cast("long").alias("label") if label is not None else F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = written(named.where("label IS NOT NULL").withColumn("length", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))
    chosen = rows.where(anchors)

    near = _in_cells(chosen.withColumn("positives", F.lit(None).cast("array<long>")), rows, ["length", "label"], POSITIVES, None)
    positives = written(_best_of(near, ["anchor_row"], POSITIVES).select("anchor_row", (F.col("rank") - 1).alias("kind"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("kind", "positive_score"))), lambda p: p["positive_score"])
    listed = positives.groupBy(F.col("anchor_row").alias("row")).agg(ordered.alias("positives"))
    far = _in_cells(chosen.join(listed, "row"), rows, ["length"], NEGATIVES, POSITIVES)
    negatives = _best_of(far, ["anchor_row", "kind"], NEGATIVES)
    out = negatives.join(positives, ["anchor_row", "kind"]).join(chosen.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
