"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes marks chunk ends: a strict mask before the normal size, a loose one after it, within a
smallest and a largest size. Ends depend on the text around them only, so an insertion changes the chunks it touches
and no others. A fingerprint is the set of chunk digests with their bytes; the containment of one in the
other is the share of its bytes whose chunks the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a byte string, the last one its length."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < 32:  # doubles the number of bytes that a hash covers
        gear[step:] += gear[:-step] << np.uint32(step)
        step *= 2
    loose = np.flatnonzero(gear >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = (loose[gear[loose] >> np.uint32(32 - STRICT_BITS) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start = [], 0
    while n - start > SMALLEST:
        end = min(n, start + LARGEST)
        i = bisect_left(strict, start + SMALLEST)
        if i < len(strict) and strict[i] < start + NORMAL:
            end = strict[i]
        else:
            i = bisect_left(loose, start + NORMAL)
            if i < len(loose) and loose[i] < end:
                end = loose[i]
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_bytes(text: str) -> dict[int, int]:
    """Digest and total bytes of every distinct chunk of a text."""
    data = text.encode()
    found: dict[int, int] = {}
    start = 0
    for end in chunk_ends(data):
        digest = xxhash.xxh3_64_intdigest(data[start:end])
        found[digest] = found.get(digest, 0) + end - start
        start = end
    return found


def fingerprint(chunks: dict[int, int]) -> str:
    """Chunks as `digest:bytes`, digests in hex and in order, joined by commas."""
    return ",".join(f"{digest:016x}:{chunks[digest]}" for digest in sorted(chunks))


def containment(chunks: dict[int, int], other: dict[int, int]) -> float:
    """Share of the bytes of `chunks` that `other` holds too; 1 for equal chunks, and for two empty texts."""
    if chunks == other:
        return 1.0
    total = sum(chunks.values())
    return sum(min(size, other.get(digest, 0)) for digest, size in chunks.items()) / total if total else 0.0


def edited(text: str, following: str) -> str:
    """`text` whose last half (rounded down) gives way to as many first code points of `following`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [part.split(" ")[0] for part in _SCHEMA.split(", ")]


def _compared(doc_id: int | None, text: str, chunks: dict[int, int], following: str, next_chunks: dict[int, int]) -> tuple:
    changed = edited(text, following)
    changed_chunks = chunk_bytes(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (doc_id, len(text), digest, fingerprint(chunks), fingerprint(changed_chunks), containment(chunks, changed_chunks), containment(chunks, next_chunks))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text) in order: every row meets the next one of its range; guests are met only."""
    held = None
    for batch in batches:
        rows = []
        for place, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if guest and (held is None or held[0] != place):
                continue  # a second guest
            chunks = chunk_bytes(text)
            if held is not None and held[0] == place:
                rows.append(_compared(*held[1:], text, chunks))
            held = None if guest else (place, doc_id, text, chunks)
        yield _batch(rows)


def _without_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_compared(None, text, chunk_bytes(text), "", {}) for text in batch.column(0).to_pylist()])


def _ranges(bounds: np.ndarray):
    """Adds the range of each id; the first id of a range is a guest of the range before, the very first of the last one."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.searchsorted(bounds, ids, side="right") - 1
            first = np.flatnonzero(bounds[np.maximum(own, 0)] == ids)
            take = np.concatenate((np.arange(len(ids)), first))
            ranges = np.concatenate((own, (own[first] - 1) % len(bounds)))
            guests = np.concatenate((np.zeros(len(ids), bool), np.ones(len(first), bool)))
            taken = [column.take(pa.array(take)) for column in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(guests), *taken], ["range", "guest", *batch.schema.names])

    return place


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last half replaced by the start of the next document in the order of ids (after the last: the
    first). Ids are cut into ranges at quantiles; each range is sorted and read row by row, with the first document of the
    next range as a guest, so texts are shuffled once and no task holds more than two of them. A null text counts as empty.
    Rows of one id follow each other by text. A row with a null id has no place in the order: its next text is empty. A single
    row is its own next. Two empty texts are alike (1), an empty one is like no other (0). An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id").where("doc_id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 20 * ranges).alias("cuts"), F.min("doc_id").alias("least")).first()
    out = rows.where("doc_id IS NULL").select("text").mapInArrow(_without_order, _SCHEMA)
    if cuts.least is None:
        return out
    rough = np.unique(np.array([cuts.least, *cuts.cuts], dtype=np.int64))
    firsts = ids.mapInArrow(_ranges(rough), "range long, guest boolean, doc_id long").where("NOT guest").groupBy("range").agg(F.min("doc_id").alias("first")).toPandas()
    bounds = np.sort(firsts["first"].to_numpy(dtype=np.int64))
    placed = rows.where("doc_id IS NOT NULL").mapInArrow(_ranges(bounds), "range long, guest boolean, doc_id long, text string")
    placed = placed.repartition("range").sortWithinPartitions("range", "guest", "doc_id", "text")
    return placed.mapInArrow(_in_order, _SCHEMA).union(out)
