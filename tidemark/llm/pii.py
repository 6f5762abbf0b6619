"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their format's validation are replaced by a keyed
permutation of that format: digits stay digits, letters stay letters, check
digits are computed anew, separators stay. The permutation is a balanced Feistel
network of keyed BLAKE2b rounds on the value's index, walked until it falls in
the format's range, so it is one to one: equal values keep equal pseudonyms in
all documents, and the key gives them back (``decrypt``), unless a row of digit
groups can be read as a card in several ways and the pseudonym is read otherwise.

Kinds: email (all but the top-level label), phone (national digits), card (Luhn;
the first digit stays), ip (v4), date (ISO or with slashes or dots, 1900-2099),
iban (mod 97; country stays), ssn (area, group and serial rules). A date goes to a
date of the same shape: one digit stays one, a leading zero stays one, and where
only one order of day and month makes sense the new date has that order too; with
slashes an order that could be either is month first, with dots day first.

Semantics: null text stays null; equal rows stay equal; a text without such
values is unchanged byte for byte; a text of any length is read whole, and the time
grows with its length; other columns are kept (:func:`pseudonymise`) and may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "date", "iban", "ssn")


class Feistel:
    """Keyed permutations of 0..n-1; ``tweak`` names the format."""

    def __init__(self, key: bytes, decrypt: bool = False):
        self.key, self.decrypt = hashlib.sha256(key).digest(), decrypt

    def _round(self, tweak: bytes, k: int, half: int, value: int) -> int:
        size = (half + 7) // 8
        out = b""
        block = 0
        while len(out) < size:
            h = hashlib.blake2b(tweak + b"|%d|%d|%d|" % (k, half, block) + value.to_bytes(size, "big"), key=self.key, digest_size=min(64, max(8, size)))
            out += h.digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << half) - 1)

    def __call__(self, x: int, n: int, tweak: str) -> int:
        if n <= 1:
            return x
        half, name = max(1, ((n - 1).bit_length() + 1) // 2), f"{tweak}|{n}".encode()
        low = (1 << half) - 1
        while True:
            a, b = x >> half, x & low
            for k in reversed(range(ROUNDS)) if self.decrypt else range(ROUNDS):
                if self.decrypt:
                    a, b = b ^ self._round(name, k, half, a), a
                else:
                    a, b = b, a ^ self._round(name, k, half, b)
            x = a << half | b
            if x < n:
                return x

    def digits(self, s: str, tweak: str) -> str:
        return str(self(int(s), 10 ** len(s), tweak)).zfill(len(s)) if s else s

    def characters(self, s: str, tweak: str) -> str:
        """ASCII letters and digits among themselves, each in its kind and case."""
        kinds = [10 if c.isdigit() else 26 for c in s if c.isascii() and c.isalnum()]
        x, n = 0, 1
        for c, r in zip((c for c in s if c.isascii() and c.isalnum()), kinds):
            x, n = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), n * r
        shape = "".join("0" if r == 10 else "a" for r in kinds)
        y, out = self(x, n, f"{tweak}|{shape}"), []
        for r in reversed(kinds):
            y, d = divmod(y, r)
            out.append(str(d) if r == 10 else chr(97 + d))
        made = iter(reversed(out))
        return "".join((next(made).upper() if c.isupper() else next(made)) if c.isascii() and c.isalnum() else c for c in s)


def luhn(s: str) -> int:
    """Sum modulo 10; 0 for a number with the right check digit."""
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    made = iter(digits)
    return "".join(next(made) if c.isdigit() else c for c in shape)


def _only(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _email(s: str, f: Feistel) -> str:
    body, dot, top = s.rpartition(".")
    return f.characters(body, "email") + dot + top


def _phone(s: str, f: Feistel) -> str | None:
    m = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    keep = m.end() if m else 0
    if s[0] == "+" and not m:
        keep = 2
    digits = _only(s[keep:])
    return s[:keep] + _fill(s[keep:], f.digits(digits, "phone")) if 7 <= len(digits) <= 15 else None


def _card(s: str, f: Feistel) -> str | None:
    d = _only(s)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + f.digits(d[1:-1], "card" + d[0])
    return _fill(s, body + str((10 - luhn(body + "0")) % 10))


def _ip(s: str, f: Feistel) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = f(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST


def _field(s: str, short: bool) -> str:
    """Shape of a day or month: ``1`` one digit, ``0`` a leading zero beside one digit, ``2`` two digits beside one, ``p`` padded."""
    return "1" if len(s) == 1 else "p" if not short else "0" if s[0] == "0" else "2"


_RANGES = {"1": range(1, 10), "0": range(1, 10), "2": range(10, 32), "p": range(1, 32)}


@functools.lru_cache(maxsize=64)
def _dates(day: str, month: str, least_day: int) -> list[int]:
    """All days of the calendar, from 0, whose day and month have these shapes."""
    out = []
    for n in range(_DAYS):
        x = datetime.date.fromordinal(_FIRST + n)
        if x.day in _RANGES[day] and x.month in _RANGES[month] and x.day >= least_day:
            out.append(n)
    return out


def _date(s: str, f: Feistel) -> str | None:
    a, sep, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", s).groups()
    order, least_day = "ymd" if len(a) == 4 else "mdy" if sep == "/" else "dmy", 1
    v = dict(zip(order, (a, b, c)))
    if order != "ymd" and int(v["m"]) > 12 >= int(v["d"]):
        order, least_day = ("dmy" if order == "mdy" else "mdy"), 13
        v = dict(zip(order, (a, b, c)))
    try:
        day = datetime.date(int(v["y"]), int(v["m"]), int(v["d"])).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    short = min(len(v["d"]), len(v["m"])) == 1
    shape = _field(v["d"], short), _field(v["m"], short)
    every = _dates(*shape, least_day)
    new = datetime.date.fromordinal(_FIRST + every[f(bisect.bisect_left(every, day), len(every), f"date|{''.join(shape)}|{least_day}")])
    out = {"y": f"{new.year:04d}"} | {k: f"{x:02d}" if kind in "0p" else str(x) for k, kind, x in (("d", shape[0], new.day), ("m", shape[1], new.month))}
    return sep.join(out[k] for k in order)


def _iban(s: str, f: Feistel) -> str | None:
    d = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = f.characters(d[4:], "iban" + d[:2])
    new = iter(d[:2] + f"{98 - number(body + d[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _ssn(s: str, f: Feistel) -> str | None:
    def good(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = _only(s)
    if not good(d):
        return None
    while True:
        d = f.digits(d, "ssn")
        if good(d):
            return _fill(s, d)


_MAIL = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_LOCAL = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]*[A-Za-z0-9_+-]\Z")
_RUN = re.compile(r"[0-9+(][0-9 ().+/-]*[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBERS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])(?!\.\d)"), _date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("card", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{2,6}){2,4})(?!\d)"), _card),
    ("phone", re.compile(r"\+\d(?:[ .()-]{0,2}\d){6,14}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"), _phone),
)


class _Spans:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def find(text: str, f: Feistel) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every value, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        m = _MAIL.match(text, at)
        local = _LOCAL.search(text, max(floor, at - 64), at) if m else None
        if local and (start := local.start() + len(local.group()) - len(local.group().lstrip("!#$%&'*+/=?^_`{|}~.-"))) < at:
            found.append((start, m.end(), "email", _email(text[start : m.end()], f)))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    taken = _Spans()
    for start, end, _, _ in found:
        taken.add(start, end)
    for m in _IBAN.finditer(text):
        for end in range(m.end(), m.start() + 14, -1):
            if end < m.end() and text[end : end + 1].isalnum() and text[end - 1] != " " and text[end] != " ":
                continue
            if (new := _iban(text[m.start() : end].rstrip(), f)) and taken.free(m.start(), end):
                found.append((m.start(), m.start() + len(new), "iban", new))
                taken.add(m.start(), m.start() + len(new))
                break
    for run in _RUN.finditer(text):
        a = run.start()
        for kind, pattern, change in _NUMBERS:
            m = pattern.search(text, a, run.end())
            while m:
                s, e = m.span()
                off = text[e : e + 1].isalnum() or text[s - 1 : s].isalnum() and text[s] not in "+("
                if off or not taken.free(s, e) or not (new := change(m.group(), f)):
                    # A rejected match may hold a shorter value, or a value that starts at a later group.
                    shorter = pattern.match(text, s, e - 1) if kind in ("card", "phone") else None
                    m = shorter or pattern.search(text, s + 1, run.end())
                    continue
                found.append((s, e, kind, new))
                taken.add(s, e)
                m = pattern.search(text, e, run.end())
    return iter(sorted(found))


def replace(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """``text`` with pseudonyms, and how many of each kind."""
    out, at, count = [], 0, dict.fromkeys(KINDS, 0)
    for start, end, kind, new in find(text, f):
        out += [text[at:start], new]
        at = end
        count[kind] += 1
    return ("".join([*out, text[at:]]) if out else text), count


def pseudonymise(docs: DataFrame, key: bytes = b"tidemark", text_col: str = "text", counts: bool = False, decrypt: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; with ``counts``, n_<kind> columns follow.

    One pass over the scan; nothing is shuffled. Give ``key`` from a secret store:
    the default only serves tests.
    """
    import pyarrow as pa

    at, schema = docs.columns.index(text_col), T.StructType(list(docs.schema))
    for kind in KINDS if counts else ():
        schema = schema.add(f"n_{kind}", "long")

    @lean
    def change(batches):
        f = Feistel(key, decrypt)
        for batch in batches:
            texts, numbers = [], {k: [] for k in KINDS}
            for text in batch.column(at):
                text = text.as_py()
                new, count = replace(text, f) if text else (text, dict.fromkeys(KINDS, 0))
                texts.append(new)
                for k in KINDS:
                    numbers[k].append(count[k])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            extra = [pa.array(numbers[k], pa.int64()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays(columns + extra, [x.name for x in schema])

    return docs.mapInArrow(change, schema)


def pii_report(docs: DataFrame, key: bytes = b"tidemark", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), n_<kind> for every row."""
    return pseudonymise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), key, counts=True)
