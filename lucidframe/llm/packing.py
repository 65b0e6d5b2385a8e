"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Every task packs its own documents in blocks of bounded size; nothing is shuffled. Documents longer than a window
fill whole windows; what is left of them and all shorter ones are cut evenly into pieces of at most LONGEST_PIECE, as
small pieces level windows far better than large ones. Differencing starts with one
partial partition per piece and merges the two most unbalanced ones so that the fullest windows of one meet the
emptiest of the other, until one near-equal partition is left. If a window is above capacity, the window
count rises and the block is packed again.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import digests_of, text_slices, word_bounds

CAPACITY = 4096
LONGEST_PIECE = 768
BLOCK_PIECES = 1536  # memory of a task: so many pieces
CACHED_WORDS = 2_000_000  # a worker's words, about 80 MB; beyond that it starts anew
MARK = "\x01"


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of every piece, sum of every window) by largest differencing over `windows` windows.

    A partial partition is its window sums in falling order, less their smallest, with the first and last piece of
    each window; pieces of a window are chained.
    """
    follows = np.full(len(sizes), -1)
    heap = []
    for piece, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        first = np.full(windows, -1)
        first[0] = piece
        heap.append((-size, piece, sums, first, first.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, sums, first, last = heapq.heappop(heap)
        _, _, other, other_first, other_last = heapq.heappop(heap)
        sums, other_first, other_last = sums + other[::-1], other_first[::-1], other_last[::-1]
        chained = (last >= 0) & (other_first >= 0)
        follows[last[chained]] = other_first[chained]
        first = np.where(first >= 0, first, other_first)
        last = np.where(other_last >= 0, other_last, last)
        rank = np.argsort(-sums, kind="stable")
        sums = sums[rank]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, first[rank], last[rank]))
    window_of = np.zeros(len(sizes), np.int64)
    for window, piece in enumerate(heap[0][3].tolist()):
        while piece >= 0:
            window_of[piece] = window
            piece = int(follows[piece])
    return window_of, np.bincount(window_of, weights=sizes, minlength=windows).astype(np.int64)


def balance(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of every piece, number of windows): as few windows as differencing fits into, found by raising the count."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window_of, sums = difference(sizes, windows)
        if sums.max() <= capacity:
            return window_of, windows
        windows += max(1, windows // 200)


class WordIds:
    """Token ids of whole texts, encoding each distinct word once.

    Words are split at ASCII white space, which the tokenizer drops and never joins across, so the ids of a
    text are those of its words in order. Words that differ only in the case of A-Z share their ids, so the
    tokenizer must lower-case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str("A") != "a":
            raise ValueError(f"{path} doesn't lower-case")
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # digests of the words learned, in order
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words side by side, and the number of ids of each.

        One call for all: the words are parted by a mark that is a token of its own. Words that hold the mark go one by one.
        """
        if len(self.mark) == 1 and not any(MARK.encode() in word for word in words):
            text = f" {MARK} ".join(word.decode() for word in words)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text in order."""
        for first, data, offsets in text_slices(column):
            starts, ends, before = word_bounds(data, offsets)
            distinct, sample, which = np.unique(digests_of(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) > CACHED_WORDS:
                self.forget()
            places = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = places < len(self.known)
            new[inside] = self.known[places[inside]] != distinct[inside]
            if new.any():
                raw = data.tobytes()
                ids, lengths = self._encoded([raw[starts[j] : ends[j]] for j in sample[new].tolist()])
                begins = len(self.flat) + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                at = places[new]
                self.flat = np.concatenate((self.flat, ids))
                self.known, self.starts, self.lengths = np.insert(self.known, at, distinct[new]), np.insert(self.starts, at, begins), np.insert(self.lengths, at, lengths)
                places = np.searchsorted(self.known, distinct)
            words = places[which]
            lengths = self.lengths[words]
            until = np.concatenate(([0], np.cumsum(lengths)))
            ids = self.flat[np.arange(until[-1]) + np.repeat(self.starts[words] - until[:-1], lengths)]
            for row in range(len(offsets) - 1):
                yield first + row, ids[until[before[row]] : until[before[row + 1]]]


_LEARNED: dict[str, WordIds] = {}  # a worker's tasks share the words they have learned


def word_ids(path: str) -> WordIds:
    if path not in _LEARNED:
        _LEARNED[path] = WordIds(path)
    return _LEARNED[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cuts(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Where a document of `total` ids is cut: whole windows, then even pieces of at most LONGEST_PIECE."""
    whole = total - total % capacity
    parts = -(-(total - whole) // min(LONGEST_PIECE, capacity))
    edges = [*range(0, whole, capacity), *(whole + (total - whole) * i // parts for i in range(parts)), total]
    return list(zip(edges[:-1], edges[1:]))


def _packer(path: str, end_id: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        open_pieces: list[list] = []

        def closed() -> None:
            """Gives the open pieces their windows."""
            nonlocal sequence
            window_of, windows = balance(np.array([piece[2] for piece in open_pieces]), capacity)
            filled = [0] * windows
            for piece, window in zip(open_pieces, window_of.tolist(), strict=True):
                piece += [sequence + window, filled[window]]
                filled[window] += piece[2]
            rows.extend(open_pieces)
            sequence += windows
            open_pieces.clear()

        for batch in batches:
            rows: list[list] = []
            ids_of = batch.column(0).to_pylist()
            for row, ids in encode(batch.column(1)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total = len(ids)
                for start, end in cuts(total, capacity):
                    piece = ids[start:end]
                    described = [ids_of[row], start, len(piece), zlib.crc32(piece.tobytes()), total]
                    if len(piece) == capacity:
                        rows.append([*described, sequence, 0])
                        sequence += 1
                    else:
                        open_pieces.append(described)
                if len(open_pieces) >= BLOCK_PIECES:
                    closed()
            yield _table(rows)
        if open_pieces:
            rows = []
            closed()
            yield _table(rows)

    return pack


def _table(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, without special tokens, and `end_id`. A null or empty text is `end_id` alone. Rows are
    packed each on its own, so repeated rows give pieces as often; a null id stays null. Sequence ids are the task's
    number times 2**32 and a count, the same when a task is redone. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, end_id, capacity), SCHEMA)
