"""Personal data replaced by format-preserving pseudonyms.

A value is validated, mapped to a number of its format's domain, permuted by a keyed Feistel
network with cycle walking, and written in the same format: cards stay Luhn-valid, IBANs keep
their country and check digits, addresses stay addresses, dates stay dates of the same
century with the order and padding of their fields. The permutation depends on key and kind
alone, so equal values stay equal across documents, and it can be inverted with the key.

Kinds: email (local part, in blocks of ``EMAIL_BLOCK`` characters), IPv4 address, payment card
(by its check digit), IBAN, US social security number, phone number, date. A match that runs on into a neighbouring value is
shortened to what its kind's check and the neighbour allow; where a check rejects all
of its lengths, the other kinds and then the next position are tried. A digit run that no
kind's check accepts is left alone, as is text without any match. A date of two numbers up to
12 is read day first; one whose second number is larger is read month first and stays so.

Cases: null texts stay null and empty ones empty, with zero counts; repeated rows get a row
each; an empty table gives an empty result; very long texts and values take time in
proportion to their length; extra columns of the table are kept by ``pseudonymize``, and where
one is named like a count (n_<kind>, n_pii), the count gets underscores behind its name.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields, free_name, numbered

KINDS = ("email", "ip", "card", "iban", "ssn", "phone", "date")
#: In the order they are tried at a position.
PATTERNS = {
    "email": r"(?<![\w.%+-])[._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{r})" for k, r in PATTERNS.items()))
KIND = {k: re.compile(r) for k, r in PATTERNS.items()}
#: A match of these kinds can run on into the value behind it.
OPEN_ENDED = ("iban", "phone", "card")
END = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])")
START = re.compile(r"(?<![A-Za-z0-9+(])[A-Za-z0-9+(]")
#: How payment cards are written: in one piece or in groups.
CARD = re.compile(r"[2-6]\d{12,18}|[2-6]\d{3}([ -])\d{4}\1\d{4}\1(?:\d{4}(?:\1\d{1,3})?|\d{1,3})|3\d{3}([ -])\d{6}\2\d{4,5}")
IBAN_LENGTHS = dict(zip(
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split(),
    map(int, "24 23 28 20 28 20 16 22 22 29 28 21 22 28 24 22 18 28 20 29 24 18 18 27 22 22 23 18 27 28 21 28 22 23 23 26 27 30 30 20 28 32 21 20 21 21 25 27 24 22 19 27 31 30 18 15 24 28 29 25 29 24 22 24 31 24 19 24 27 25 28 23 24 26 29 22 24 20".split()),
))
#: Every kind holds one of these, so a text without any isn't searched further.
HINT = re.compile(r"@|\d")
#: Characters of an email's local part that are permuted together.
EMAIL_BLOCK = 64
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PiiParams:
    """key: the secret of the permutations, 1 to 64 bytes; whoever holds it can invert them."""

    key: bytes
    rounds: int = 8

    def __post_init__(self) -> None:
        if not 1 <= len(self.key) <= 64:
            raise ValueError("the key must have 1 to 64 bytes")


def expand(side: bytes, key: bytes, person: bytes, n: int) -> bytes:
    """``n`` keyed pseudo-random bytes, of several digests where one is too short."""
    if n <= 64:
        return hashlib.blake2b(side, key=key, person=person, digest_size=n).digest()
    return b"".join(hashlib.blake2b(side + k.to_bytes(8, "big"), key=key, person=person).digest() for k in range(-(-n // 64)))[:n]


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8, inverse: bool = False) -> int:
    """A keyed permutation of 0 ... size - 1: balanced Feistel network with cycle walking."""
    if size < 2:
        return value
    half = -(-(size - 1).bit_length() // 2) or 1
    mask = (1 << half) - 1
    wide = -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for r in range(rounds - 1, -1, -1) if inverse else range(rounds):
            side = left if inverse else right
            person = hashlib.md5(f"{tweak}/{size:x}/{r}".encode()).digest()
            mixed = int.from_bytes(expand(side.to_bytes(wide, "big"), key, person, wide + 8), "big") & mask
            left, right = (right ^ mixed, left) if inverse else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_checks(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced, in order, by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replacement of one match; None where the kind's check rejects it."""

    def __init__(self, p: PiiParams):
        self.p = p
        self.of = lru_cache(maxsize=65_536)(self._of)

    def _digits(self, digits: str, kind: str) -> str:
        n = len(digits)
        return f"{feistel(int(digits), 10**n, self.p.key, kind, self.p.rounds):0{n}d}"

    def _mixed(self, text: str, kind: str) -> str:
        """Letters to letters of their case, digits to digits, the rest as it is."""
        sizes = [10 if c in "0123456789" else 26 if c in ASCII else 1 for c in text]
        size = value = 0
        size = 1
        for c, s in zip(text, sizes):
            size, value = size * s, value * s + (ord(c) - ord("0") if s == 10 else ord(c.lower()) - ord("a") if s == 26 else 0)
        value = feistel(value, size, self.p.key, kind, self.p.rounds)
        out = []
        for c, s in zip(reversed(text), reversed(sizes)):
            value, d = divmod(value, s)
            out.append(c if s == 1 else ALNUM[d] if s == 10 else ALNUM[10 + d].upper() if c.isupper() else ALNUM[10 + d])
        return "".join(reversed(out))

    def _of(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _email(self, v: str) -> str:
        local, _, domain = v.partition("@")
        blocks = (local[k : k + EMAIL_BLOCK] for k in range(0, len(local), EMAIL_BLOCK))
        return "".join(self._mixed(b, f"email{k or ''}") for k, b in enumerate(blocks)) + "@" + domain

    def _ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return None
        n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, self.p.key, "ip", self.p.rounds)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if not luhn_ok(digits):
            return None
        body = self._digits(digits[:-1], "card")
        return refill(v, body + luhn_digit(body))

    def _iban(self, v: str) -> str | None:
        bare = v.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return None
        body = self._mixed(bare[4:], "iban")
        return refill(v, bare[:2] + iban_checks(bare[:2], body) + body)

    def _ssn(self, v: str) -> str | None:
        area, group, serial = v.split("-")
        if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
            return None
        n = ((_area(area) * 99) + int(group) - 1) * 9999 + int(serial) - 1
        n = feistel(n, 898 * 99 * 9999, self.p.key, "ssn", self.p.rounds)
        n, serial_n = divmod(n, 9999)
        area_n, group_n = divmod(n, 99)
        return f"{area_n + 1 + (area_n >= 665):03d}-{group_n + 1:02d}-{serial_n + 1:04d}"

    def _phone(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if not 8 <= len(digits) <= 15:
            return None
        lead = len(re.match(r"\+?(\d{1,3})?", v).group(1) or "") if v.startswith("+") else 0
        return refill(v, digits[:lead] + self._digits(digits[lead:], "phone"))

    def _date(self, v: str) -> str | None:
        a, b, c = re.split(r"[-/.]", v)
        iso = "-" in v
        y, m, d = (int(x) for x in ((a, b, c) if iso else (c, b, a)))
        swapped = not iso and m > 12  # month first
        if swapped:
            m, d = d, m
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        free = iso or len(a) == len(b) == 2
        styles = (0, 0) if free else (field_style(a), field_style(b))
        days = same_style(y // 100, swapped, *styles)
        tweak = f"date{y // 100}" + ("" if free and not swapped else f"/{swapped}{styles}")
        new = datetime.date.fromordinal(days[feistel(bisect_left(days, day), len(days), self.p.key, tweak, self.p.rounds)])
        if iso:
            return new.isoformat()
        x, z = (new.month, new.day) if swapped else (new.day, new.month)
        sep = v[len(a)]
        return f"{x:0{len(a)}d}{sep}{z:0{len(b)}d}{sep}{new.year:04d}"


def field_style(field: str) -> int:
    """Of a day or month beside a one-digit one: 1 one digit, 2 padded to two, 3 ten or more."""
    return 1 if len(field) == 1 else 2 if field[0] == "0" else 3


@lru_cache(maxsize=512)
def same_style(century: int, swapped: bool, first: int, second: int) -> array:
    """Ordinals of a century's dates that are written the same way: order of fields, and style of each (0: any)."""
    lo = datetime.date(max(1, century * 100), 1, 1).toordinal()
    hi = datetime.date(century * 100 + 99, 12, 31).toordinal()
    fits = lambda n, style: not style or (n > 9) == (style == 3)
    out = array("l")
    for k in range(lo, hi + 1):
        d = datetime.date.fromordinal(k)
        if swapped and d.day <= 12:  # would be read day first
            continue
        x, z = (d.month, d.day) if swapped else (d.day, d.month)
        if fits(x, first) and fits(z, second):
            out.append(k)
    return out


ASCII = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _area(area: str) -> int:
    n = int(area)
    return n - 1 - (n > 666)


def neighbours(names: Pseudonyms, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Values (start, end) that begin inside lo ... hi; of digit runs nothing tells where they begin."""
    found = []
    for s in START.finditer(text, lo + 1, hi):
        m = PATTERN.match(text, s.start())
        if m and m.lastgroup != "card" and names.of(m.lastgroup, m.group()) is not None:
            found.append(m.span())
    return found


def best_end(names: Pseudonyms, text: str, kind: str, lo: int, hi: int) -> int | None:
    """The end of the kind's value from ``lo``, at most ``hi``, that the check accepts and that leaves neighbours whole."""
    ends = [e.start() for e in END.finditer(text, lo, hi) if e.start() < hi and KIND[kind].fullmatch(text, lo, e.start())]
    good = [e for e in (*ends, hi) if names.of(kind, text[lo:e]) is not None]
    if len(good) < 2:
        return good[0] if good else None
    near = neighbours(names, text, lo, hi)

    def order(e: int) -> tuple[bool, int, int]:
        value = text[lo:e]
        chars = sum(c.isalnum() for c in value)
        national = chars == IBAN_LENGTHS.get(value[:2]) if kind == "iban" else value.startswith("+1") and chars == 11
        taken = sum(s < e and (e < u or good[0] <= s) for s, u in near)
        return not national, taken, -e

    return min(good, key=order)


def choose(names: Pseudonyms, text: str, m: re.Match) -> tuple[int, int, str, str] | None:
    """(start, end, kind, pseudonym) of the value that the match holds, or None where no kind accepts any of its lengths."""
    lo = m.start()
    for kind in list(PATTERNS)[list(PATTERNS).index(m.lastgroup) :]:
        w = m if kind == m.lastgroup else KIND[kind].match(text, lo)
        if not w:
            continue
        start, end = w.span()
        if kind == "card" and not w.group().isdigit():  # a card beside a short number goes before an account of all digits
            starts = [start, *(s.start() for s in START.finditer(text, start + 1, end))]
            ends = [end, *(e.start() for e in reversed([*END.finditer(text, start, end)]) if e.start() < end)]
            cards = ((s, e) for s in starts for e in ends if CARD.fullmatch(text, s, e))
            own = next(((s, e) for s, e in cards if luhn_ok(re.sub(r"\D", "", text[s:e]))), None)
            start, end = own or (start, best_end(names, text, kind, start, end))
        elif kind in OPEN_ENDED:
            end = best_end(names, text, kind, start, end)
        new = names.of(kind, text[start:end]) if end is not None else None
        if new is not None:
            return start, end, kind, new
    return None


def pseudonymizer(p: PiiParams) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function from a text to the text with pseudonyms and the number of each kind."""
    names = Pseudonyms(p)

    def run(text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        if not HINT.search(text):
            return text, counts

        out, done, at = [], 0, 0
        while m := PATTERN.search(text, at):
            hit = choose(names, text, m)
            if hit is None:
                at = m.start() + 1
                continue
            lo, hi, kind, new = hit
            counts[kind] = counts.get(kind, 0) + 1
            out += text[done:lo], new
            done = at = hi
        return "".join(out) + text[done:], counts

    return run


def pseudonymize(docs: DataFrame, p: PiiParams, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The documents with pseudonyms in ``text``, and n_<kind> and n_pii."""
    names = list(columns or docs.columns)
    numbers: list[str] = []
    for k in (*KINDS, "pii"):
        numbers.append(free_name([*names, *numbers], f"n_{k}"))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = pseudonymizer(p)
        for b in batches:
            texts, counts = [], []
            for x in b.column(at):
                text, found = change(x.as_py()) if x.is_valid else (None, {})
                texts.append(text)
                counts.append(found)
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            arrays += [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([sum(c.values()) for c in counts], pa.int64())], names=[*names, *numbers])

    return numbered(docs, names).mapInArrow(run, fields(docs, names, **dict.fromkeys(numbers, "long")))
