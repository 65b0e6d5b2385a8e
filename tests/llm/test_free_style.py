"""Operators in Python tasks: against plain versions on small tables, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lucidframe.llm import fingerprints as fp
from lucidframe.llm import hamming_index as hi
from lucidframe.llm import language_id, packing, pseudonyms, toxicity

from .helpers import edge_rows, prose, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- packing -------------------------------------------------------------------

def check_packed(rows, pieces):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    left = {}
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for start, end in packing.cuts(len(ids)):
            cut = ids[start:end]
            assert 0 < len(cut) <= packing.CAPACITY
            key = (doc_id, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(ids))
            left[key] = left.get(key, 0) + 1
    sequences = {}
    for p in pieces:
        left[tuple(p)[:5]] -= 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert not any(left.values())
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sequences


def test_packing_edges(spark):
    rows = edge_rows()
    check_packed(rows, packing.pack_documents(table(spark, rows), TOKENIZER).collect())
    assert packing.pack_documents(table(spark, []), TOKENIZER).count() == 0


def test_packing_leaves_little_padding(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, int(rng.lognormvariate(5.5, 1)))) for i in range(700)]
    sequences = check_packed(rows, packing.pack_documents(table(spark, rows).coalesce(1), TOKENIZER).collect())
    total = sum(length for placed in sequences.values() for _, length in placed)
    assert total >= 0.98 * packing.CAPACITY * len(sequences)


@pytest.mark.parametrize("windows", [1, 2, 5, 40])
def test_differencing_places_every_piece(windows):
    sizes = np.random.default_rng(windows).integers(1, 4000, 90)
    window_of, sums = packing.difference(sizes, windows)
    assert sums.sum() == sizes.sum() and len(window_of) == 90 and window_of.max() < windows
    if windows < 10:
        assert sums.max() - sums.min() < 200


def test_word_ids_are_the_tokenizers():
    rng = random.Random(4)
    signs = "aAbB'sTreÄé́  \x1c\x85\x01\t\nΣσς12²<|endoftext|>İK가\U0001F600’\x0b\x0c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a<|startoftext|>b \x01 c", "", None]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    encode = packing.WordIds(TOKENIZER)
    for _ in range(2):
        assert [ids.tolist() for _, ids in encode(pa.array(texts, pa.string()))] == want


# --- fingerprints --------------------------------------------------------------

def test_chunks_cover_the_text_and_survive_shifts():
    rng = random.Random(1)
    data = prose(rng, 5000).encode()
    ends = fp.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= fp.LARGEST and sizes[:-1].min() >= fp.SMALLEST
    text = data.decode()
    assert fp.containment(fp.chunk_bytes(text), fp.chunk_bytes("inserted words " + text)) > 0.97
    assert fp.containment(fp.chunk_bytes(text), fp.chunk_bytes(prose(random.Random(7), 5000))) < 0.05
    assert fp.containment({}, {}) == 1.0 and fp.containment({}, fp.chunk_bytes("x")) == 0.0


def check_fingerprints(spark, rows, **how):
    got = sorted((tuple(r) for r in fp.fingerprint_documents(table(spark, rows), **how).collect()), key=repr)
    placed = sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    pairs = [(i, t, placed[(k + 1) % len(placed)][1]) for k, (i, t) in enumerate(placed)] + [(None, r[1] or "", "") for r in rows if r[0] is None]
    want = []
    for i, text, after in pairs:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new = fp.chunk_bytes(text), fp.chunk_bytes(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(own), fp.fingerprint(new), fp.containment(own, new), fp.containment(own, fp.chunk_bytes(after) if i is not None else {})))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_fingerprints_meet_the_next_document(spark, ranges):
    rng = random.Random(8)
    rows = [(rng.randrange(-50, 10**12), prose(rng, rng.randrange(0, 200))) for _ in range(150)]
    check_fingerprints(spark, rows, ranges=ranges)


def test_fingerprint_edges(spark):
    check_fingerprints(spark, edge_rows(), ranges=4)
    check_fingerprints(spark, [(7, "only one")])
    assert fp.fingerprint_documents(table(spark, [])).count() == 0


# --- nearest neighbours --------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, score string"


def test_neighbours_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(500, None, None), (520, [0.0] * 16, None), (540, [float("nan")] * 16, None), (560, [None, *[1.0] * 15], None), (580, [1.0], None), (None, x[0].tolist(), None), (0, x[0].tolist(), "s"), (600, x[20].tolist(), "s")]
    got = {}
    for r in hi.nearest(table(spark, rows, VECTORS), "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([*range(500), 600])
    vectors = np.array([*x, x[20]], np.float32).astype(np.float64)
    assert sorted(got) == [*range(0, 500, 20), 600]
    hits = 0
    for q, found in got.items():
        scores = (vectors * vectors[list(ids).index(q)]).sum(axis=1)
        scores[ids == q] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({f[1] for f in found} & set(ids[best].tolist()))
        for _, vec_id, score in found:
            assert score == pytest.approx(scores[list(ids).index(vec_id)], abs=1e-12)
    assert hits >= 0.9 * 20 * len(got)
    assert got[20][0][1] == 600 and got[600][0][1] == 20
    assert hi.nearest(table(spark, [], VECTORS), "vec_id % 20 = 0").count() == 0
    few = hi.nearest(table(spark, [(0, [1.0, 0.0], None), (1, [0.0, 2.0], None), (2, [3.0, 0.0], None)], VECTORS), "vec_id % 20 = 0").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few)] == [(1, 2, 3.0), (2, 1, 0.0)]


def test_probing_finds_every_code_in_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, (3000, hi.BITS // 8), dtype=np.uint8)
    for radius in (0, 10, 47, 52, 64, hi.BITS):
        want = np.flatnonzero(hi.distances(codes, codes[5]) <= radius)
        assert np.array_equal(hi.within(codes, codes[5], radius), want)


def test_tables_hold_every_row_under_its_bytes():
    codes = np.random.default_rng(2).integers(0, 256, (700, hi.BITS // 8), dtype=np.uint8)
    tables = hi.Tables(codes)
    for place, buckets in enumerate(tables.buckets):
        assert len(buckets) == 256 and all(np.array_equal(rows, np.flatnonzero(codes[:, place] == value)) for value, rows in enumerate(buckets))
    for radius in (-1, 0, 10, 47, hi.BITS):
        near = np.bitwise_count(codes ^ codes[5]) <= hi.shares(radius, hi.BITS // 8)
        assert np.array_equal(tables.probed(codes[5], radius), np.flatnonzero(near.any(axis=1)))
    assert len(hi.Tables(codes[:0]).within(codes[5], 47)) == 0


# --- toxicity ------------------------------------------------------------------

def test_misspellings_and_quotation():
    lexicon = toxicity.Lexicon(["idiot$", "worthless$", "scum$", "lowei"])
    assert [lexicon.find(w) for w in ("idiot", "idoit", "idiots", "idio", "worthles", "wrothless", "scum", "scun", "loweiabc", "lowe", "plain")] == [0, None, 1, 1, 1, 2, 0, None, 0, None, None]
    abuse, quoted = toxicity.features("you idiot", lexicon), toxicity.features('they said "you idiot" there', lexicon)
    assert abuse[0] > 0 == abuse[2] and quoted[2] > 0 == quoted[0]


def test_automaton_is_edit_distance():
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        automaton = toxicity.Automaton(a, 2)
        state = automaton.start()
        for char in b:
            state = automaton.step(state, char)
        assert state[-1] == min(distance(a, b), 3)


def test_toxicity_is_learned_from_rows_that_are_not_held_out(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        held = zlib.crc32(str(i).encode()) % 4 == 2
        words = prose(rng, 40, 3000).split()
        if toxic:
            words.insert(5, "idiot" if rng.random() < 0.5 else "moron")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if not held else 1 - toxic))
    truth = {i: int(any(w in t for w in ("idiot", "moron"))) for i, t in rows}
    schema = "doc_id long, toxic int, score string"
    out = toxicity.score_toxicity(table(spark, [*rows, *edge_rows()[:3]]), table(spark, [*labels, (None, 1), (900, None), (901, 7)], schema)).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id in truth and r.doc_id > 2:
            assert r.predicted == truth[r.doc_id] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert toxicity.score_toxicity(table(spark, []), table(spark, labels, schema)).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(table(spark, rows[:5]), table(spark, [], schema)).collect()} == {0}


# --- pseudonyms ----------------------------------------------------------------

KEY = b"test"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutations(size):
    permute = pseudonyms.Permutation(KEY)
    images = [permute("kind", size, i) for i in range(size)]
    assert sorted(images) == list(range(size))
    assert [permute("kind", size, i, back=True) for i in images] == list(range(size))


def test_formats_stay():
    permute = pseudonyms.Permutation(KEY)
    text = "Call +1 (980) 555-6268 or write Jo.b7@mail.example.com by 2024-02-29, 31.12.1999; card 4417744280351547, 4417-7442-8035-1547, host 129.38.82.176."
    new, spans = pseudonyms.pseudonymised(text, permute)
    assert [kind for _, kind, _ in spans] == ["phone", "email", "date", "date", "card", "card", "address"]
    values = [text[s:e] for s, _, e in spans]
    assert not any(v in new for v in values)
    again, same = pseudonyms.pseudonymised(new, permute)
    assert [kind for _, kind, _ in same] == [kind for _, kind, _ in spans]
    back, _ = pseudonyms.pseudonymised(new, permute, back=True)
    assert back == text.replace("Jo.b7", "jo.b7")
    cards = [new[s:e].replace("-", "") for s, kind, e in same if kind == "card"]
    assert cards[0] == cards[1] and pseudonyms.check_digit(cards[0][:-1]) == int(cards[0][-1])


def test_long_texts_are_treated_like_short_ones():
    permute = pseudonyms.Permutation(KEY)
    mixed = ["4417744280351547@mail.example.com", "2024-02-29@example.com", "129.38.82.176@example.com"]
    short = [pseudonyms.pseudonymised(value, permute) for value in mixed]
    assert [kind for _, spans in short for _, kind, _ in spans] == ["email"] * 3
    filler = [f"jo{i}@example.com 4417744280351547 2024-02-29" for i in range(100)]
    new, spans = pseudonyms.pseudonymised(" ".join([*mixed, *filler, *mixed]), permute)
    words = new.split(" ")
    assert words[:3] == words[-3:] == [value for value, _ in short]
    assert [kind for _, kind, _ in spans] == ["email"] * 3 + ["email", "card", "date"] * 100 + ["email"] * 3
    assert pseudonyms.pseudonymised(new, permute, back=True)[0] == " ".join([*mixed, *filler, *mixed])


@pytest.mark.parametrize("text", ["", "plain words", "4417744280351548", "999.1.1.1", "1.2.3", "2023-02-30", "version 2.0.1.", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a@b", "12345"])
def test_others_are_left_alone(text):
    assert pseudonyms.pseudonymised(text, pseudonyms.Permutation(KEY)) == (text, [])


def test_pseudonym_edges(spark):
    rows = [*edge_rows(), (20, "4417744280351547 and 4417744280351547")]
    out = pseudonyms.pseudonymise(table(spark, rows), KEY).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.n_card == 0 and r.doc_id is not None and r.text is not None) == sorted((r[0], r[1]) for r in rows[:-1] if r[0] is not None and r[1] is not None)
    hit = next(r for r in out if r.doc_id == 20)
    assert hit.n_card == 2 and len(set(hit.text.split(" and "))) == 1 and hit.spans == "card:0:16,card:21:37"
    assert len(out) == len(rows) and pseudonyms.pseudonymise(table(spark, []), KEY).count() == 0


# --- languages -----------------------------------------------------------------

WORDS = {"en": "the house stands near water with green trees", "de": "das haus steht nahe beim wasser mit grünen bäumen", "fr": "la maison se trouve près de l'eau avec arbres verts"}


def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40)))
        rows.append((3000 + i, text, lang, f"s{i % 3}", len(text)))
    return rows


def test_languages_of_documents(spark):
    rows = labelled(spark)
    out = language_id.identify_documents(table(spark, rows)).collect()
    assert sum(r["__lang"] == r.lang for r in out) >= 0.97 * len(rows)
    more = table(spark, [*rows, *edge_rows()])
    kept = language_id.keep_identified(more)
    assert kept.columns == more.columns
    gone = [(None, None), (1, None), (2, ""), (3, " \t\n"), 6]  # and a long text in which no two letters stand together
    assert kept.count() == len(rows) + len(edge_rows()) - len(gone)
    assert language_id.keep_identified(table(spark, [])).count() == 0


def test_languages_of_pages(spark):
    docs = table(spark, labelled(spark))
    page = lambda lang, text: f"<!DOCTYPE html><html lang='{lang}'><head><script>the house</script><title>x</title></head><body><p>{text}</p></body></html>"
    rows = [(i, f"http://h{i % 4}.example.{lang}/p", page(lang.upper() + "-x", WORDS[lang])) for i, lang in enumerate(list(WORDS) * 20)]
    unclear = [(900, "http://h1.example.de/p", page("de", "xq")), (901, None, None), (902, "http://h1.example.fr/", ""), (None, "no host", "<p>1 2 3</p>"), rows[0]]
    schema = "page_id long, url string, html string"
    out = {r.page_id: r for r in language_id.identify_pages(table(spark, rows + unclear, schema), docs).collect()}
    assert all(out[i].lang == lang and out[i].declared == lang for i, lang in enumerate(list(WORDS) * 20))
    assert out[901].lang is None and out[902].lang is None and out[None].lang is None and out[900].declared == "de"
    assert language_id.identify_pages(table(spark, [], schema), docs).count() == 0
    assert {r.lang for r in language_id.identify_pages(table(spark, rows, schema), table(spark, [])).collect()} == {None}


def test_rare_languages_are_learned(spark):
    signs = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(11)
    words = {f"l{i:02d}": ["".join(rng.choice(signs) for _ in range(6)) for _ in range(12)] for i in range(70)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    rows = [(100 * i + k, text(lang), lang, "s") for i, lang in enumerate(words) for k in range(2 if i % 10 == 0 else 3)]
    docs = table(spark, rows)
    languages, model = language_id.learn_trigrams(docs)
    assert languages == sorted(words) and model.shape == (language_id.BUCKETS, 70)
    pages = [(i, f"http://h{i}.example/p", f"<html><p>{text(lang)}</p></html>") for i, lang in enumerate(words)]
    out = language_id.identify_pages(table(spark, pages, "page_id long, url string, html string"), docs).collect()
    assert {r.page_id: r.lang for r in out} == dict(enumerate(words))


def test_broken_markup_takes_one_pass():
    plain = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]{2,8};|&#x?[0-9a-f]{1,7};")
    rng = random.Random(1)
    parts = ["<script", "</script >", "</SCRIPT>", "<style a=b>", "</style>", "<!--", "-->", "<p>", "<", ">", "&amp;", "&#x27;", "x y", "<noscript>", "<scripty>", ";"]
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert language_id.visible(page) == plain.sub(" ", page)
    began = time.perf_counter()
    for page in ("<script ", "<!-- ", "<script></script ", "< ", "<style>&amp; "):
        language_id.visible(page * (1 << 17))
    assert time.perf_counter() - began < 20


def test_phones_with_and_without_separators_are_linked(spark):
    numbers = ["+19805556268", "+1 980 555 6268", "+1 (980) 555-6268", "+1980 555 6268", "+491711234567", "+49 171 1234567", "+49 171 123 4567", "+380441234567", "+380 44 123 4567", "+1234567", "+123456789012345"]
    rows = [(i, f"call {n} now") for i, n in enumerate(numbers)]
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    digits = ["".join(c for c in out[i].text if c.isdigit()) for i in range(len(numbers))]
    for same in ([0, 1, 2, 3], [4, 5, 6], [7, 8]):
        assert len({digits[i] for i in same}) == 1
        assert all(digits[i] != "".join(c for c in numbers[i] if c.isdigit()) for i in same)
