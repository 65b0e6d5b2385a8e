"""Language identification by Bayesian fusion of evidence.

Text gives a likelihood per language (hashed letter trigrams, learned from a bounded sample of labelled rows). Declared markup
language and address suffix are weighed by how they go with the text's verdicts over all rows, and each host has a
prior smoothed towards its suffix's, which is smoothed towards that of all rows. These come from grouped sums of text
posteriors. A row's own posterior is left out of its host's prior.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import among_least, columns_of, while_writing, written
from .url_filters import host_of
from .words import text_slices

ROWS_PER_LANGUAGE = 1000  # labelled rows that a language's trigrams are learned from
BUCKETS = 1 << 12
HELD_LANGUAGES = 256  # languages whose counts a task holds before it hands them on
TEMPER = 0.3  # trigrams overlap, so each counts for less than an independent sign
HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 5.0, 20.0, 5.0
LEAST_POSTERIOR = 0.5
MISSING = ""

_LETTER = np.full(256, 32, dtype=np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, count of every bucket) of the letter trigrams of whole texts; bytes that are no letters part words."""
    for first, data, offsets in text_slices(column):
        letters = _LETTER[data]
        spread = (letters[:-2] * np.uint32(0x9E3779B1) ^ letters[1:-1] * np.uint32(0x85EBCA6B) ^ letters[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        buckets = (spread >> np.uint32(20)).astype(np.int64)
        full = (letters[:-2] != 32) & (letters[1:-1] != 32)  # a blank may only end a trigram
        for row in range(len(offsets) - 1):
            a, b = offsets[row], max(offsets[row], offsets[row + 1] - 2)
            yield first + row, np.bincount(buckets[a:b][full[a:b]], minlength=BUCKETS)


_UNSEEN = re.compile(r"(?i)(script|style|noscript)\b")
_CLOSED = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript")}
_ENTITY = re.compile(r"(?i)&[a-z]{2,8};|&#x?[0-9a-f]{1,7};")


def visible(html: str | None) -> str:
    """What a page shows, as far as its language is concerned: one pass over the tags, however broken.

    Scripts, styles and comments go up to their ends; where an end is missing, as after a tag that is never closed, only the tag
    goes, and no end is looked for twice.
    """
    html, out, at, missing = html or "", [], 0, set()

    def end_of(name: str, start: int) -> int:
        if name in missing:
            return -1
        found = html.find("-->", start) + 3 if name == "-->" else closed.end() if (closed := _CLOSED[name].search(html, start)) else 2
        if found == 2:
            missing.add(name)
        return found if found > 2 else -1

    while (tag := html.find("<", at)) >= 0:
        end = end_of("-->", tag + 4) if html.startswith("<!--", tag) else -1
        if unseen := _UNSEEN.match(html, tag + 1):
            end = end_of(unseen[1].lower(), unseen.end())
        if end < 0:
            end = html.find(">", tag) + 1
        if end == 0:
            break
        out += [_ENTITY.sub(" ", html[at:tag]), " "]
        at = end
    return "".join([*out, _ENTITY.sub(" ", html[at:])])


def _texts(column: pa.Array, markup: bool) -> pa.Array:
    return pa.array([visible(x) for x in column.to_pylist()], pa.string()) if markup else column


def learn_trigrams(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every bucket in each, from at most ROWS_PER_LANGUAGE rows per label.

    Every label is learned, however rare. Rows are chosen by a digest of their id. Null ids, texts and labels are left out.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).dropna()
    labels = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    low = rows.join(F.broadcast(labels), "lang").where(among_least(F.col("id"), ROWS_PER_LANGUAGE, F.col("ids")))
    chosen = low.withColumn("place", place).where(F.col("place") <= ROWS_PER_LANGUAGE).select("id").distinct()
    texts = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().join(F.broadcast(chosen), "id")

    def handed_on(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            held = np.flatnonzero(counts) if counts.any() else np.arange(1)  # a label without trigrams is one, too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held), pa.array(counts[held])], ["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, counts in trigram_counts(batch.column(0)):
                if langs[row] not in sums and len(sums) >= HELD_LANGUAGES:
                    yield from handed_on(sums)
                    sums = {}
                sums[langs[row]] = sums.get(langs[row], 0) + counts
        yield from handed_on(sums)

    with while_writing(labelled.sparkSession):
        found = texts.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].combine_chunks().dictionary_encode()
    order = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object))
    languages = [names.dictionary[int(i)].as_py() for i in order]
    counts = np.full((BUCKETS, len(languages)), 0.5)
    counts[found["bucket"].to_numpy(), np.argsort(order)[names.indices.to_numpy()]] += found["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=0))


def text_evidence(text: Column, model: np.ndarray, markup: bool = False) -> Column:
    """Tempered log-likelihood of every language, the largest 0; null where a text has no letters to go by."""

    @F.arrow_udf("array<double>")
    def score(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        out: list = [None] * len(column)
        for row, counts in trigram_counts(_texts(column, markup)):
            if counts.any():
                logs = TEMPER * (counts @ model)
                out[row] = (logs - logs.max()).tolist()
        return pa.array(out, pa.list_(pa.float64()))

    return score(text)


def declared_in(html: Column) -> Column:
    """The first subtag of the language that the html element declares, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1), F.lit(MISSING)))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)).otherwise(F.lit(MISSING))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, not once for each element that a lambda below sees."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _posterior(logs: Column) -> Column:
    """Probabilities of logarithms known up to a constant."""
    parts = _with(logs, lambda known: _with(F.array_max(known), lambda top: F.transform(known, lambda x: F.exp(x - top))))
    return _with(parts, lambda p: _with(_total(p), lambda total: F.transform(p, lambda x: x / total)))


def _smoothed(own: Column, towards: Column, strength: float) -> Column:
    return _with(own, lambda known: _with(_total(known), lambda total: F.zip_with(known, towards, lambda o, t: (o + strength * t) / (total + strength))))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """`rows` with __logs, __host, __suffix and __declared, plus `__lang` and `__posterior`; other columns pass through.

    `__lang` is null where the text has no letters or no language reaches LEAST_POSTERIOR. Grouped sums are joined back by
    host and by declared language; a hot host is one row there.
    """
    n = len(languages)
    sums = F.array(*(F.sum(F.col("p")[i]) for i in range(n)))
    seen = rows.where("__logs IS NOT NULL").select("__host", "__suffix", "__declared", _posterior(F.col("__logs")).alias("p"))
    grouped = written(seen.groupBy("__host", "__suffix", "__declared").agg(sums.alias("p")))
    everything = grouped.agg(sums.alias("p")).first().p
    overall = np.array([x or 0.0 for x in everything]) + 1.0
    general = F.array(*(F.lit(float(x)) for x in overall / overall.sum()))
    by_suffix = grouped.where(F.col("__suffix") != MISSING).groupBy("__suffix").agg(sums.alias("p"))
    by_suffix = by_suffix.select("__suffix", _smoothed(F.col("p"), general, SUFFIX_STRENGTH).alias("__towards"))
    by_host = grouped.groupBy("__host", "__suffix").agg(sums.alias("__sums")).join(by_suffix, "__suffix", "left")
    by_host = written(by_host.withColumn("__towards", F.coalesce("__towards", general)))
    # How often each language is declared so, among all rows that declare one, smoothed towards the declaration's overall share.
    declaring = grouped.where(F.col("__declared") != MISSING).groupBy("__declared").agg(sums.alias("p"))
    per_language = [x or 0.0 for x in declaring.agg(sums.alias("p")).first().p]
    totals = F.array(*(F.lit(float(x)) for x in per_language))
    share = _total(F.col("p")) / F.lit(max(float(sum(per_language)), 1e-9))
    signs = _with(share, lambda s: F.zip_with("p", totals, lambda x, t: F.log((x + DECLARED_STRENGTH * s) / (t + DECLARED_STRENGTH))))
    declaring = written(declaring.select("__declared", signs.alias("__signs")))

    nothing = F.array_repeat(F.lit(0.0), n)
    out = rows.withColumn("__own", _posterior(F.col("__logs"))).join(by_host, ["__host", "__suffix"], "left").join(declaring, "__declared", "left")
    others = F.zip_with(F.coalesce("__sums", nothing), "__own", lambda x, own: F.greatest(x - own, F.lit(0.0)))
    prior = _smoothed(others, F.coalesce("__towards", general), HOST_STRENGTH)
    logs = F.zip_with(F.zip_with("__logs", prior, lambda x, p: x + F.log(p)), F.coalesce("__signs", nothing), lambda x, sign: x + sign)
    out = out.withColumn("__fused", _posterior(logs)).withColumn("__posterior", F.coalesce(F.array_max("__fused"), F.lit(0.0)))
    named = F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position("__fused", F.col("__posterior")).cast("int"))
    return out.withColumn("__lang", F.when(F.col("__posterior") >= LEAST_POSTERIOR, named)).select(*columns_of(rows), "__lang", "__posterior")


def _unknown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"__lang": F.lit(None).cast("string"), "__posterior": F.lit(0.0)})


def identify_pages(pages: DataFrame, labelled: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, lang, posterior of every page, from its text, its markup, its address and its host's pages.

    lang is null (posterior 0) where a page shows no letters, also for null and empty pages; a null url is an empty
    host. Repeated rows and null ids are judged each. Without labelled rows every lang is null. An empty table gives no rows.
    """
    languages, model = learn_trigrams(labelled)
    host = host_of(F.col(url_col))
    evidence = text_evidence(F.col(html_col), model, markup=True) if languages else F.lit(None).cast("array<double>")
    rows = written(pages.select("page_id", host.alias("__host"), suffix_of(host).alias("__suffix"), declared_in(F.col(html_col)).alias("__declared"), evidence.alias("__logs")))
    out = fuse(rows, languages) if languages else _unknown(rows)
    return out.select("page_id", F.col("__host").alias("host"), F.col("__declared").alias("declared"), F.col("__lang").alias("lang"), F.round("__posterior", 6).alias("posterior"))


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with `__lang` and `__posterior`: `source` stands for the host and `lang` for what is declared, where present.

    Null and empty texts, and texts without letters, get a null `__lang`. All columns and rows stay as they are.
    """
    languages, model = learn_trigrams(docs if labelled is None else labelled)
    if not languages:
        return _unknown(docs)
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in docs.columns else F.lit(MISSING)
    rows = docs.withColumns({"__host": given("source"), "__suffix": F.lit(MISSING), "__declared": given("lang"), "__logs": text_evidence(F.col(text_col), model)})
    return fuse(rows, languages).drop("__host", "__suffix", "__declared", "__logs")


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that have a language, columns as they are."""
    return identify_documents(docs, **how).where("__lang IS NOT NULL").select(*columns_of(docs))
