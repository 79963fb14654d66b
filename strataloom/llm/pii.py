"""Format-preserving pseudonyms for personal numbers, dates and mail names.

What is found is validated (check digits, ranges, calendar), numbered within the
set of all valid values of its format, and permuted there by a keyed Feistel
network. So a pseudonym is again a valid value of the same format, equal values
have equal pseudonyms in all documents, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataloom.llm.common import Batches, lean, slices

ROUNDS = 10
KINDS = ("email", "ip", "card", "phone", "ssn", "date")

# --- the permutation --------------------------------------------------------


class Feistel:
    """Keyed permutation of ``0 .. size - 1``: alternating halves modulo ``a`` and ``b``, walked until inside."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size, self.a = size, isqrt(max(0, size - 1)) + 1
        self.b = -(-size // self.a)
        self.base = blake2b(f"{name}:{size}".encode(), key=key, digest_size=64)

    def _mask(self, step: int, half: int) -> int:
        one = self.base.copy()
        one.update(b"%d:%d" % (step, half))
        return int.from_bytes(one.digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for step in range(ROUNDS) if not back else reversed(range(ROUNDS)):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._mask(step, left)) % self.b
            else:
                left = (left + sign * self._mask(step, right)) % self.a
        return left * self.b + right

    def walk(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next place of ``x`` on its cycle that lies inside and is ``valid``; with ``back`` the one before."""
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


# --- formats: text to number within the format, and back ----------------------


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(template: str, digits: str) -> str:
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), template)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Pseudonyms:
    """Finds values in texts and replaces them under one key."""

    #: tried from left to right at each place
    found = re.compile(
        r"(?P<email>[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
        r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
        r"|(?P<phone>(?<![\w+])\+?1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
        r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
        r"|(?P<date>(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/.])\d{1,2}([/.])\d{1,2}\6\d{4}(?![\w/]))"
        r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    )
    hint = re.compile(r"@|\d[\d ()./+-]{5}").search

    def __init__(self, key: bytes):
        self.key = key[:64]
        self.permutation = lru_cache(maxsize=4096)(lambda name, size: Feistel(self.key, name, size))

    def swap(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or, with ``back``, the value of a pseudonym); None if it is not valid."""
        return getattr(self, f"_{kind}")(value, back)

    def _card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        width = len(digits) - 2
        keep = lambda x: len({digits[0], *(body := f"{x:0{width}d}"), str(luhn(digits[0] + body))}) > 1
        body = digits[0] + f"{self.permutation(f'card{digits[0]}', 10**width).walk(int(digits[1:-1]), back, keep):0{width}d}"
        return _refill(value, body + str(luhn(body)))

    def _phone(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        own = digits[-10:]
        if own[0] in "01" or own[3] in "01":
            return None
        at = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        head, line = divmod(self.permutation("phone", 800 * 800 * 10_000).walk(at, back), 10_000)
        return _refill(value, f"{digits[:-10]}{head // 800 + 200}{head % 800 + 200}{line:04d}")

    def _ssn(self, value: str, back: bool) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self.permutation("ssn", 898 * 99 * 9999).walk(at, back), 9999)
        area, group = divmod(rest, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
            return None
        at = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.permutation("ip", 1 << 32).walk(at, back).to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        a, b, c = map(int, re.split(r"\D", value))
        iso, day_first = "-" in value, a > 12
        try:
            day = datetime.date(a, b, c) if iso else datetime.date(c, b, a) if day_first else datetime.date(c, a, b)
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        # a day-first date keeps a day over 12, or it would be read as month-first
        keep = (lambda x: datetime.date.fromordinal(FIRST_DAY + x).day > 12) if not iso and day_first else lambda _: True
        day = datetime.date.fromordinal(FIRST_DAY + self.permutation("date", LAST_DAY - FIRST_DAY + 1).walk(day.toordinal() - FIRST_DAY, back, keep))
        if iso:
            return day.isoformat()
        padded = all(len(p) == 2 for p in re.split(r"\D", value)[:2])
        sign = value[-5]
        return sign.join([*(f"{x:0{2 if padded else 1}d}" for x in ((day.day, day.month) if day_first else (day.month, day.day))), f"{day.year:04d}"])

    def _email(self, value: str, back: bool) -> str | None:
        name, domain = value.split("@")
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in name]
        size, at = 1, 0
        for c, r in zip(name, radix, strict=True):
            size, at = size * r, at * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)
        at, out = self.permutation("email" + "".join(map(chr, (65 + r for r in radix))), size).walk(at, back), []
        for c, r in zip(reversed(name), reversed(radix), strict=True):
            at, d = divmod(at, r)
            out.append(str(d) if r == 10 else chr((65 if c.isupper() else 97) + d) if r == 26 else c)
        return "".join(reversed(out)) + "@" + domain

    def text(self, text: str | None, back: bool = False) -> tuple[str | None, list[int]]:
        """A text with every valid value replaced, and how many of each kind were."""
        counts = [0] * len(KINDS)
        if not text or not self.hint(text):
            return text, counts

        def put(match: re.Match) -> str:
            kind = match.lastgroup
            new = self.swap(kind, match[0], back)
            if new is None:
                return match[0]
            counts[KINDS.index(kind)] += 1
            return new

        return self.found.sub(put, text), counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced and, with ``counts``, the long columns ``n_email, n_ip, n_card, n_phone, n_ssn, n_date`` behind.

    All other columns pass through, apart from such that bear the counts' names. Row
    by row, without a shuffle; null and empty texts stay as they are; repeated
    rows are treated alike. ``back`` undoes it under the same key.
    """
    counted = [f"n_{kind}" for kind in KINDS] if counts else []
    kept = [c for c in docs.columns if c not in counted]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in counted)])

    def run(batches: Batches) -> Batches:
        own = Pseudonyms(key)
        for part in slices(batches):
            done = [own.text(t, back) for t in part.column("text").to_pylist()]
            arrays = [part.column(c) if c != "text" else pa.array([t for t, _ in done], part.schema.field("text").type) for c in kept]
            arrays += [pa.array([n[k] for _, n in done], pa.int64()) for k in range(len(counted))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *counted])

    return docs.select(*kept).mapInArrow(lean(run), schema)
