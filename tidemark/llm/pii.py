"""PII (9): format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers (Luhn), IPv4 addresses, telephone numbers, dates, IBANs (mod 97),
social security numbers and e-mail addresses are validated and replaced by
another value of the same format that is valid in the same way.  A value is
written as a number below the count of values of its format, and a Feistel
network permutes these numbers: as it is a permutation under one key, equal
values get equal pseudonyms in all documents, different ones different, and who
has the key can go back.  Spellings of one value stay linked: a date is permuted
as a day, whichever way it is written, within its century and within the days
and months that need as many digits and can be read in as many ways; a telephone
number as its digits, with or without the +1.

What fails validation, such as a long number without Luhn's check digit, is left
as it is, and so are digits other than 0 to 9.  Left out are telephone numbers without + other than in groups of 3-3-4, with + those
of fewer than 8 digits, cards in groups other than 4-4-4-1 to 7, 4-6-5 and 4-6-4, dates
with names of months or years of two digits, IPv6 addresses, and names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import ready
from .words import strings

#: For tests and examples; a deployment passes its own.
KEY = b"an example key, to be replaced"
ROUNDS = 8


@lru_cache(1 << 16)
def permute(n: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """n in 0..size-1 to its place under the key, by a Feistel network over an even number of bits and walking cycles until it lies in the domain."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = n >> half, n & low
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            message = b"%d|%d|%s|" % (r, size, kind.encode()) + (left if back else right).to_bytes(width, "big")
            f = int.from_bytes(_stream(key, message, width), "big") & low
            left, right = (right ^ f, left) if back else (right, left ^ f)
        n = left << half | right
        if n < size:
            return n


def _stream(key: bytes, message: bytes, n: int) -> bytes:
    if n <= 64:
        return hashlib.blake2b(message, key=key[:64], digest_size=n).digest()
    return hashlib.shake_256(key + b"|" + message).digest(n)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def card(text: str, key: bytes, back: bool = False) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + str(permute(int(d[1:-1]), 10 ** (len(d) - 2), key, "card" + d[0], back)).zfill(len(d) - 2)
    return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def ip(text: str, key: bytes, back: bool = False) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    d = _digits(text)
    if not 10 <= len(d) <= 15:
        return None
    written, rest = d[:-10], d[-10:]
    country = written or "1"
    if rest[0] in "01" or rest[3] in "01":
        # No North American number: all but the country's digits and the first of the rest.
        n = permute(int(rest[1:]), 10**9, key, f"phone{country}{rest[0]}", back)
        while str(n).zfill(9)[2] not in "01" and rest[0] not in "01":
            n = permute(n, 10**9, key, f"phone{country}{rest[0]}", back)
        return _refill(text, written + rest[0] + str(n).zfill(9))
    n = ((int(rest[0]) - 2) * 100 + int(rest[1:3])) * 800 + (int(rest[3]) - 2) * 100 + int(rest[4:6])
    n = permute(n * 10_000 + int(rest[6:]), 800 * 800 * 10_000, key, "phone" + country, back)
    head, line = divmod(n, 10_000)
    area, exchange = divmod(head, 800)
    return _refill(text, f"{written}{area + 200:03d}{exchange + 200:03d}{line:04d}")


def country(digits: str) -> int:
    """Digits of the calling code that an international number begins with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3


def international(text: str, key: bytes, back: bool = False) -> str | None:
    """A number with + outside North America: all but the calling code and the first digit after it."""
    d = _digits(text)
    if not 8 <= len(d) <= 15 or d[0] in "01":
        return None
    k = country(d) + 1
    return _refill(text, d[:k] + str(permute(int(d[k:]), 10 ** (len(d) - k), key, "international" + d[:k], back)).zfill(len(d) - k))


def ssn(text: str, key: bytes, back: bool = False) -> str | None:
    a, b, c = int(text[:3]), int(text[4:6]), int(text[7:])
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = 898
    n = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    n, c = divmod(permute(n, areas * 99 * 9999, key, "ssn", back), 9999)
    a, b = divmod(n, 99)
    a += 1
    a += a >= 666
    return f"{a:03d}{text[3]}{b + 1:02d}{text[6]}{c + 1:04d}"


def _class(d: datetime.date) -> tuple[int, int, bool]:
    """Dates that are permuted among themselves: of a century, with days up to 9, up to 12 or beyond, and with months up to 9 or beyond."""
    return d.year // 100, (d.day > 9) + (d.day > 12), d.month > 9


@lru_cache(1 << 8)
def _days(century: int, days: int, late: bool) -> list[int]:
    first, last = datetime.date(max(1, 100 * century), 1, 1), datetime.date(100 * century + 99, 12, 31)
    return [n for n in range(first.toordinal(), last.toordinal() + 1) if _class(datetime.date.fromordinal(n)) == (century, days, late)]


def date(text: str, key: bytes, back: bool = False) -> str | None:
    a, sign, b, _, c = re.split(r"([-/.])", text)
    # Year first; day first with dots; else month first, if that is a date.
    order = "ymd" if len(a) == 4 else "dmy" if sign == "." or int(a) > 12 else "mdy"
    written = dict(zip(order, (a, b, c)))
    try:
        d = datetime.date(int(written["y"]), int(written["m"]), int(written["d"]))
    except ValueError:
        return None
    every = _days(*_class(d))
    n = permute(bisect_left(every, d.toordinal()), len(every), key, "date%d.%d.%d" % _class(d), back)
    d = datetime.date.fromordinal(every[n])
    new = {"y": f"{d.year:04d}", "m": f"{d.month:0{len(written['m'])}d}", "d": f"{d.day:0{len(written['d'])}d}"}
    return sign.join(new[x] for x in order)


def _letters(text: str, key: bytes, kind: str, back: bool) -> str:
    """Letters to letters of their case and digits to digits; other signs stay."""
    bases = [(ord("a"), 26) if "a" <= c <= "z" else (ord("A"), 26) if "A" <= c <= "Z" else (ord("0"), 10) if "0" <= c <= "9" else None for c in text]
    n, size = 0, 1
    for c, b in zip(text, bases):
        if b:
            n, size = n * b[1] + ord(c) - b[0], size * b[1]
    n = permute(n, size, key, kind + "".join("." if not b else chr(b[0]) for b in bases), back)
    out = []
    for c, b in zip(reversed(text), reversed(bases)):
        if b:
            n, x = divmod(n, b[1])
            c = chr(b[0] + x)
        out.append(c)
    return "".join(reversed(out))


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    flat = text.replace(" ", "")
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(flat) <= 34 or check(flat) != 1:
        return None
    body = _letters(flat[4:], key, "iban" + flat[:2], back)
    out = flat[:2] + f"{98 - check(flat[:2] + '00' + body):02d}" + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in text)


def email(text: str, key: bytes, back: bool = False) -> str | None:
    local, _, domain = text.partition("@")
    labels = domain.split(".")
    if any(not x or x[0] == "-" or x[-1] == "-" for x in labels) or not labels[-1].isalpha() or local[0] == "." or ".." in local:
        return None
    # All but the top-level label; the local part under a key that doesn't depend on it, so that people and hosts stay linked.
    return _letters(local, key, "local", back) + "@" + ".".join([_letters(x, key, "host", back) for x in labels[:-1]] + labels[-1:])


#: What can hold a number; it begins with a digit, so that texts without any are passed over quickly.
_RUN = re.compile(r"\d[\d().+\-/ ]{4,}\d", re.ASCII)
_FORMS: list[tuple[str, re.Pattern, Callable]] = [
    ("date", re.compile(r"(?:(?<![\d.\-/])|(?<=\d{4}-\d{2}-\d{2}/))(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d\-]|\.\d|/(?!\d{4}-\d{2}-\d{2}(?!\d)))", re.ASCII), date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.ASCII), ip),
    ("international", re.compile(r"(?<![\d+])\+\d{1,14}(?:[ .\-/]?(?:\(\d{1,5}\) ?)?\d{1,14}){0,7}(?!\d)", re.ASCII), international),
    ("ssn", re.compile(r"(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])", re.ASCII), ssn),
    ("phone", re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{10,15}(?!\d)", re.ASCII), phone),
    ("card", re.compile(r"(?<![\d.+-])\d{4}([ -])\d{6}\1\d{4,5}(?!\d)|(?<![\d.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])|(?<![\d.+-])\d{13,19}(?!\d)", re.ASCII), card),
]
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", re.ASCII)
#: Lengths of the IBANs of each country.
_LENGTHS = {
    c: int(n)
    for n, cs in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ "
            "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,CY,DO,GT,HU,LB,PL 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
        ).split()
    )
    for c in cs.split(",")
}
#: Calling codes of two digits.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def pseudonymize(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, int]:
    """(text with pseudonyms, how many); back undoes it with the same key."""
    count = 0
    taken: list[tuple[int, int, str]] = []

    def add(start: int, end: int, new: str | None) -> bool:
        if new is None or any(start < b and a < end for a, b, _ in taken):
            return False
        taken.append((start, end, new))
        return True

    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            add(*found.span(), email(found.group(), key, back))
        at = text.find("@", max(at + 1, found.end() if found else 0))
    runs = list(_RUN.finditer(text))
    if runs:
        at = 0
        while found := _IBAN.search(text, at):
            value = found.group()
            # Words in capitals may follow: the country's length first, then the longest.
            ends = [len(value), *(k for k in range(len(value) - 1, 14, -1) if value[k] == " ")]
            ends.sort(key=lambda k: len(value[:k].replace(" ", "")) != _LENGTHS.get(value[:2]))
            end = next((k for k in ends if add(found.start(), found.start() + k, iban(value[:k], key, back))), 0)
            at = found.start() + (end or 2)
    for run in runs:
        for _, form, change in _FORMS:
            # A sign or a parenthesis may come before.
            for found in form.finditer(text, max(0, run.start() - 2), run.end()):
                value = found.group()
                # Other numbers may follow an international one.
                while not add(found.start(), found.start() + len(value), change(value, key, back)) and change is international:
                    value = re.sub(r"[^\d]+\d*$", "", value)
                    if len(value) < 9:
                        break
    out, last = [], 0
    for start, end, new in sorted(taken):
        out += [text[last:start], new]
        last = end
        count += 1
    return "".join([*out, text[last:]]), count


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with pseudonyms in text, and replaced: how many values were.

    All rows are returned, an empty table gives none; without a value the text is
    as it was, a missing text stays missing and has 0, rows without doc_id are
    changed like others.  Whole texts are read, however long, and rows that repeat
    are changed alike.  A column of docs named replaced is overwritten.
    """
    ready(docs.sparkSession)
    docs = docs.drop("replaced").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields]).add("replaced", IntegerType())
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for b in batches:
            raw = b.column(place)
            texts = strings(raw).to_pylist()
            done = [pseudonymize(t, key) for t in texts]
            new = pa.array([x if ok else None for (x, _), ok in zip(done, raw.is_valid().to_pylist())], pa.string())
            columns = [new if k == place else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], [*names, "replaced"])

    return docs.mapInArrow(run, schema)
