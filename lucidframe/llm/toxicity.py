"""Toxicity by a lexicon with Levenshtein automata and context windows.

The lexicon is learned from labelled rows: word beginnings that toxic texts have far more often than others, each as
long as its texts allow, so an entry is a whole word (`idiot`) or a stem with any ending. Words of a text are matched
by walking a trie of the lexicon together with a Levenshtein automaton of the word. A match counts as quoted where
quotation marks surround it within a window of words. Logistic weights of the counts give the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import among_least, written
from .words import shingle_sets

ROWS_PER_LABEL = 4000  # labelled rows of each kind that lexicon and weights are learned from
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, ENTRIES = 4, 0.01, 25.0, 5000
SHORTEST, LONGEST = 3, 16
WINDOW = 12  # words on either side
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile("[\"“”„«»]")
END = "$"


def beginnings(word: str) -> list[str]:
    """Beginnings of a word from SHORTEST letters on; the whole word ends in END."""
    closed = word + END if len(word) < LONGEST else word[:LONGEST]
    return [closed[:n] for n in range(SHORTEST, len(closed) + 1)]


def choose_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[str]:
    """Shortest beginnings that tell toxic texts, each made longer as long as hardly a text is lost."""

    def tells(term: str) -> bool:
        t, c = counts[term]
        return t >= max(LEAST_TEXTS, LEAST_SHARE * toxic) and (t + 0.5) / (toxic + 1) >= LEAST_ODDS * (c + 0.5) / (clean + 1)

    longer: dict[str, list[str]] = {}
    for term in counts:
        longer.setdefault(term[:-1], []).append(term)
    chosen = []
    for term in sorted(counts, key=lambda t: (len(t), t)):
        if not tells(term) or any(term.startswith(c.rstrip(END)) and not c.endswith(END) for c in chosen):
            continue
        while not term.endswith(END):
            heir = max(longer.get(term, []), key=lambda t: (counts[t][0], t), default=None)
            if heir is None or 10 * counts[heir][0] < 9 * counts[term][0] or not tells(heir):
                break
            term = heir
        if term not in chosen:
            chosen.append(term)
    return chosen


def edits_of(entry: str) -> int:
    """Edits that still count as a misspelling: none in stems and short words."""
    return 0 if not entry.endswith(END) or len(entry) <= 5 else 1 if len(entry) <= 9 else 2


class Automaton:
    """The Levenshtein automaton of a word: a state holds, for each place in the word, the edits so far, up to `most`."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.most + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        out = [min(state[0] + 1, self.most + 1)]
        for i, own in enumerate(self.word):
            out.append(min(out[i] + 1, state[i] + (own != char), state[i + 1] + 1, self.most + 1))
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.most


class Lexicon:
    """A trie of entries; `find` gives the edits of the best entry that a word matches, None without one."""

    def __init__(self, entries: list[str]):
        self.stems = {e for e in entries if not e.endswith(END)}
        self.stem_sizes = sorted({len(e) for e in self.stems})
        self.trie: dict = {}
        self.first: dict[str, set[int]] = {}
        self.last: dict[str, set[int]] = {}
        self.inner: dict[int, set[str]] = {}
        for entry in (e for e in entries if e.endswith(END)):
            node, word = self.trie, entry[:-1]
            for char in word:
                node = node.setdefault(char, {})
            node[END] = edits_of(entry)
            parts = edits_of(entry) + 1  # of so many parts of an entry, one stands unchanged in every match
            cut = len(word) // parts
            sizes = range(len(word) - parts + 1, len(word) + parts)
            self.first.setdefault(word[:cut], set()).update(sizes)
            self.last.setdefault(word[(parts - 1) * cut :], set()).update(sizes)
            for size in sizes if parts == 3 else ():
                self.inner.setdefault(size, set()).add(word[cut : 2 * cut])
        self.first_sizes, self.last_sizes = sorted({len(p) for p in self.first}), sorted({len(p) for p in self.last})
        self.known: dict[str, int | None] = {}

    def _may_match(self, word: str) -> bool:
        n = len(word)
        return (
            any(n in self.first.get(word[:cut], ()) for cut in self.first_sizes)
            or any(n in self.last.get(word[-cut:], ()) for cut in self.last_sizes)
            or any(part in word for part in self.inner.get(n, ()))
        )

    def _walk(self, word: str) -> int | None:
        automaton = Automaton(word, 2)
        best, todo = None, [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for char, below in node.items():
                if char == END:
                    if state[-1] <= below and (best is None or state[-1] < best):
                        best = state[-1]
                    continue
                after = automaton.step(state, char)
                if automaton.alive(after):
                    todo.append((below, after))
        return best

    def find(self, word: str) -> int | None:
        try:
            return self.known[word]
        except KeyError:
            pass
        found = None
        if any(word[:n] in self.stems for n in self.stem_sizes):
            found = 0
        elif self._may_match(word):
            found = self._walk(word)
        if len(self.known) >= 300_000:
            self.known.clear()
        self.known[word] = found
        return found


FEATURES = 5


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Exact, misspelled, quoted exact and quoted misspelled matches (as logarithms), and their share of the words."""
    words = _WORD.findall(text.lower())
    hit = {w for w in set(words) if lexicon.find(w) is not None}
    counts = [0, 0, 0, 0]
    if hit:
        spans = [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(words):  # lower-casing changed the words' number
            text = text.lower()
            spans = [m.span() for m in _WORD.finditer(text)]
        for i, word in enumerate(words):
            if word in hit:
                before = text[spans[max(0, i - WINDOW)][0] : spans[i][0]]
                after = text[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
                quoted = len(_QUOTE.findall(before)) % 2 == 1 and _QUOTE.search(after) is not None
                counts[2 * quoted + (lexicon.find(word) > 0)] += 1
    return [*(math.log1p(c) for c in counts), 10.0 * sum(counts) / (len(words) + 10)]


_PRIOR = np.array([3.0, 1.0, -0.5, -1.0, 1.0, -2.5])  # what weights are drawn to where the labels say little


def fit_weights(rows: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights and intercept by Newton steps, drawn to the prior."""
    x = np.column_stack((rows, np.ones(len(rows))))
    w = _PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + strength * (w - _PRIOR)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update({b for w in set(_WORD.findall(text.lower())) for b in beginnings(w)})
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0]))], ["term", "toxic", "clean"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle digest, which copies of a text mostly share: their words are no evidence of their own."""
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for row, shingles in shingle_sets(batch.column(0)):
            if len(shingles):
                keys[row] = shingles[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])


def held_out(doc_id):
    """Rows that labels are never learned from; a null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Lexicon entries and weights from at most ROWS_PER_LABEL labelled rows of each kind, chosen by a digest of the id.

    Null labels or ids are no labels; an id labelled both ways counts as toxic. Without toxic rows the lexicon is empty.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    kinds = known.groupBy("toxic").agg(F.count("*").alias("ids"))
    low = known.join(F.broadcast(kinds), "toxic").where(among_least(F.col("doc_id"), ROWS_PER_LABEL, F.col("ids"))).drop("ids")
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = low.withColumn("place", place).where(F.col("place") <= ROWS_PER_LABEL).drop("place")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").mapInArrow(_keyed, "text string, toxic int, key long")
    texts = written(texts.dropDuplicates(["key", "toxic"]).drop("key"))
    sizes = {row.toxic: row["count"] for row in texts.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = texts.mapInArrow(_count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counted.where((F.col("toxic") >= LEAST_TEXTS) & ((F.col("toxic") + 0.5) * (clean + 1) >= LEAST_ODDS * (F.col("clean") + 0.5) * (toxic + 1)))
    terms = {row.term: (row.toxic, row.clean) for row in likely.orderBy(F.desc("toxic"), "term").limit(ENTRIES).collect()}
    entries = choose_entries(terms, toxic, clean)
    seen = texts.mapInArrow(_featured(entries), "features array<double>, toxic int").collect()
    rows = np.array([row.features for row in seen]).reshape(-1, FEATURES)
    return entries, fit_weights(rows, np.array([row.toxic for row in seen]))


def _featured(entries: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            rows = [features(text, lexicon) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["features", *batch.schema.names[1:]])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; score is the probability of label 1, predicted 1 from THRESHOLD on.

    Labels of held-out rows (crc32 of the id mod 4 is 2) are never looked at. A null text counts as empty and has the score of
    a text without matches; a null id is not held out. Repeated rows are scored each. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    entries, weights = learn(rows, labels)
    scored = rows.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").mapInArrow(_featured(entries), "features array<double>, doc_id long")
    total = sum((F.col("features")[i] * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
