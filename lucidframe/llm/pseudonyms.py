"""Personal data replaced by format-preserving pseudonyms.

Validated values (card numbers by their check digit, IPv4 addresses by their octets, calendar dates, telephone numbers,
e-mail addresses) are permuted by a keyed Feistel network within their own format: a card number becomes another
valid card number, a date another date written alike. Equal values get equal pseudonyms in every document, whatever
their separators; the key undoes them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Permutation:
    """A keyed permutation of [0, size) for any size: a Feistel network over a * b >= size, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, size: int, turn: int, half: int, modulus: int) -> int:
        message = f"{kind}:{size}:{turn}:{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=16).digest(), "big") % modulus

    def _once(self, kind: str, size: int, value: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(value, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2 == 0:
                move = self._round(kind, size, turn, right, a)
                left = (left + (-move if back else move)) % a
            else:
                move = self._round(kind, size, turn, left, b)
                right = (right + (-move if back else move)) % b
        return left * b + right

    def __call__(self, kind: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        value = self._once(kind, size, value, a, b, back)
        while value >= size:
            value = self._once(kind, size, value, a, b, back)
        return value


def check_digit(digits: str) -> int:
    """The digit that makes `digits` with it pass the mod 10 check."""
    total = 0
    for i, char in enumerate(reversed(digits)):
        double = int(char) * (2 if i % 2 == 0 else 1)
        total += double - 9 if double > 9 else double
    return -total % 10


def _refilled(value: str, digits: str) -> str:
    """`value` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in value)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def card(value: str, permute: Permutation, back: bool = False) -> str | None:
    digits = _digits(value)
    if check_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = len(digits) - 1
    changed = str(permute("card", 10**body, int(digits[:-1]), back)).zfill(body)
    return _refilled(value, changed + str(check_digit(changed)))


# Country codes of telephone numbers with one and two digits; all others have three.
_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _after_country(value: str) -> int:
    """Where the number without its country code begins: at the first separator after three digits at most, else by the known codes."""
    head = re.match(r"\+\d+", value).end()
    if head <= 4 and head < len(value):
        return head
    return 1 + next((n for n in (1, 2) if value[1 : 1 + n] in _CODES), 3)


def phone(value: str, permute: Permutation, back: bool = False) -> str | None:
    """The country code stays; 7 to 12 digits after it change, others are no telephone number here and stay as they are."""
    split = _after_country(value)
    digits = _digits(value[split:])
    if not 7 <= len(digits) <= 12:
        return None
    return value[:split] + _refilled(value[split:], str(permute("phone", 10 ** len(digits), int(digits), back)).zfill(len(digits)))


def address(value: str, permute: Permutation, back: bool = False) -> str | None:
    parts = value.split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in parts):
        return None
    changed = permute("address", 1 << 32, int.from_bytes(bytes(octets), "big"), back)
    return ".".join(map(str, changed.to_bytes(4, "big")))


def calendar(value: str, permute: Permutation, back: bool = False) -> str | None:
    """Year first, or day, month, year; whichever way, a date keeps its order and separators. Other years than 1900 to 2099 stay."""
    parts = re.split(r"[-/.]", value)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    try:
        day = date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    changed = _FIRST_DAY + timedelta(days=permute("date", (_LAST_DAY - _FIRST_DAY).days + 1, (day - _FIRST_DAY).days, back))
    new = [f"{changed.year:04d}", f"{changed.month:02d}", f"{changed.day:02d}"]
    separators = re.findall(r"[-/.]", value)
    fields = new if order[0] == 0 else new[::-1]
    return fields[0] + separators[0] + fields[1] + separators[1] + fields[2]


_LETTERS, _NUMBERS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def mailbox(value: str, permute: Permutation, back: bool = False) -> str | None:
    """Letters and digits before the @ change within their class (letters in lower case), all else stays."""
    name, domain = value.rsplit("@", 1)
    name = name.lower()
    size, number = 1, 0
    for char in name:
        signs = _LETTERS if char in _LETTERS else _NUMBERS if char in _NUMBERS else ""
        if signs:
            size, number = size * len(signs), number * len(signs) + signs.index(char)
    if size == 1:
        return None
    number = permute("mailbox", size, number, back)
    out = []
    for char in reversed(name):
        signs = _LETTERS if char in _LETTERS else _NUMBERS if char in _NUMBERS else ""
        if signs:
            number, place = divmod(number, len(signs))
            char = signs[place]
        out.append(char)
    return "".join(reversed(out)) + "@" + domain


# Kinds in the order in which they are looked for at a place.
KINDS: dict[str, tuple[str, Callable]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", mailbox),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)", phone),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w/-])(?!\.\d)", calendar),
    "address": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)", address),
    "card": (r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])(?!\.\d)", card),
}
_NUMERIC = re.compile(r"\d")


def pseudonymised(text: str, permute: Permutation, back: bool = False) -> tuple[str, list[tuple[int, str, int]]]:
    """The text with pseudonyms, and (start, kind, end) of what they replaced, in code points of the given text."""
    found: list[tuple[int, int, str, str]] = []  # by start, none overlapping another
    numeric = _NUMERIC.search(text) is not None
    for kind, (pattern, change) in KINDS.items():
        if not ("@" in text if kind == "email" else numeric):
            continue
        more = []
        for match in re.finditer(pattern, text):
            after = bisect_left(found, (match.end(),))  # matches of one kind are apart, so only earlier kinds can overlap
            if after and found[after - 1][1] > match.start():
                continue
            new = change(match.group(), permute, back)
            if new is not None:
                more.append((match.start(), match.end(), kind, new))
        found = sorted(found + more)
    if not found:
        return text, []
    parts, at, spans = [], 0, []
    for start, end, kind, new in found:
        parts += [text[at:start], new]
        spans.append((start, kind, end))
        at = end
    return "".join([*parts, text[at:]]), spans


_SCHEMA = "doc_id long, text string, " + ", ".join(f"n_{kind} long" for kind in KINDS) + ", spans string"


def _run(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = (None, []) if text is None else pseudonymised(text, permute, back)
                texts.append(new)
                spans.append(found)
            counts = [pa.array([sum(k == kind for _, k, _ in found) for found in spans], pa.int64()) for kind in KINDS]
            written = pa.array([",".join(f"{kind}:{start}:{end}" for start, kind, end in found) for found in spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *counts, written], ["doc_id", "text", *(f"n_{kind}" for kind in KINDS), "spans"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, a count for each kind and the spans replaced, for every row; `back` undoes them.

    Texts without personal data, empty and null ones are returned as they are. Repeated rows and null ids are treated like any
    other. An e-mail address is undone in lower case. No row depends on another, so nothing is shuffled. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(key, back), _SCHEMA)
