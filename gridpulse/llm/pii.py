"""Format-preserving pseudonyms for personal data.

Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers,
IPv4 addresses, dates and e-mail addresses are found and validated. Each is
replaced by a keyed permutation of its own format: a Feistel network over the
digits (or the days, or the letters), walked along its cycle until the result is
valid again. Equal values get equal pseudonyms in all documents, separators and
lengths stay, and check digits are made anew. Decimal digits of other scripts
count as digits and are replaced by digits of their script.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import sliced

KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
ROUNDS = 8

# formats (fixed values)
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
NUMBERS = {
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)",
    "card": r"(?:\d{13,19}|\d{4}(?P<by>[ -])\d{4}(?P=by)\d{4}(?P=by)\d{4}|\d{4}(?P<by6>[ -])\d{6}(?P=by6)\d{5})(?!\w|[.-]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)",
}
NUMBER = re.compile(r"(?<![\w.+-])(?=[+(\d]|[A-Z]{2}\d\d)(?:" + "|".join(f"(?P<{k}>{p})" for k, p in NUMBERS.items()) + ")")
OTHER_DIGIT = re.compile(r"(?![0-9])\d")
TO_ASCII = {i: str(unicodedata.decimal(chr(i))) for i in range(128, sys.maxunicode + 1) if chr(i).isdecimal()}
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


class Feistel:
    """A keyed permutation of 0..n-1 for every n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, x: int) -> int:
        data = f"{tweak}:{i}:{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, valid=lambda y: True) -> int:
        """Walks from x until the result is below n and valid; for a valid x, a permutation of the valid."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for i in range(ROUNDS):
                left, right = right, left ^ (self._round(f"{tweak}:{n}", i, right) & mask)
            x = left << half | right
            if x < n and valid(x):
                return x


def luhn_digit(head: str) -> str:
    """The last digit that makes a number valid."""
    total = 0
    for i, c in enumerate(reversed(head)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_number(country_check_body: str) -> int:
    turned = country_check_body[4:] + country_check_body[:4]
    return int("".join(str(int(c, 36)) for c in turned))


def _digits_of(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def _put(value: str, digits: str) -> str:
    """The value with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in value)


def _number(f: Feistel, digits: str, tweak: str, valid=lambda s: True) -> str:
    n = len(digits)
    return str(f.permute(int(digits), 10**n, tweak, lambda y: valid(str(y).zfill(n)))).zfill(n)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _date(value: str):
    """(date, its format) or None."""
    kinds = {"-": ("%Y-%m-%d",), ".": ("%d.%m.%Y",), "/": ("%Y/%m/%d",) if value[4] == "/" else ("%m/%d/%Y", "%d/%m/%Y")}
    for form in kinds["-" if "-" in value else "." if "." in value else "/"]:
        try:
            got = dt.datetime.strptime(value, form).date()
        except ValueError:
            continue
        if 0 <= got.toordinal() - FIRST_DAY < DAYS:
            return got, form
    return None


def _letters(f: Feistel, local: str) -> str:
    """Letters and digits permuted as one number of mixed radix; case and signs stay."""
    radix = [26 if c.isalpha() else 10 for c in local if c.isascii() and c.isalnum()]
    x, n = 0, 1
    for c in local:
        if c.isascii() and c.isalnum():
            r = 26 if c.isalpha() else 10
            x, n = x * r + (ord(c.lower()) - 97 if c.isalpha() else int(c)), n * r
    y, out = f.permute(x, n, "email:" + ",".join(map(str, radix))), []
    for c in reversed(local):
        if c.isascii() and c.isalnum():
            y, d = divmod(y, 26 if c.isalpha() else 10)
            new = chr(97 + d) if c.isalpha() else str(d)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(reversed(out))


def pseudonym(f: Feistel, kind: str, value: str) -> str | None:
    """The pseudonym of a found value, or None if the value isn't valid."""
    digits = _digits_of(value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{_letters(f, local)}@{domain}" if any(c.isascii() and c.isalnum() for c in local) else None
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        head = _number(f, digits[:-1], "card")
        return _put(value, head + luhn_digit(head))
    if kind == "iban":
        compact = value.replace(" ", "")
        if len(compact) < 15 or _iban_number(compact) % 97 != 1 or not digits[2:]:
            return None
        body = compact[:2] + "00" + _put(compact[4:], _number(f, _digits_of(compact[4:]), "iban"))
        check = f"{98 - _iban_number(body) % 97:02d}"
        left = iter(body[:2] + check + body[4:])
        return "".join(c if c == " " else next(left) for c in value)
    if kind == "ssn":
        return _put(value, _number(f, digits, "ssn", _ssn_valid)) if _ssn_valid(digits) else None
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+?(\d*)", value)[1]) if value[0] == "+" else 0
        if country >= len(digits) - 5:  # no sign after the country code: its first digits stay
            country = min(2, country)
        return _put(value, digits[:country] + _number(f, digits[country:], "phone"))
    if kind == "ipv4":
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]  # octets of as many digits
        x, n = 0, 1
        for p, (low, size) in zip(parts, ranges, strict=True):
            x, n = x * size + int(p) - low, n * size
        y, new = f.permute(x, n, "ipv4:" + ",".join(str(len(p)) for p in parts)), []
        for low, size in reversed(ranges):
            y, d = divmod(y, size)
            new.append(str(low + d))
        return ".".join(reversed(new))
    got = _date(value)
    if got is None:
        return None
    day, form = got
    return dt.date.fromordinal(FIRST_DAY + f.permute(day.toordinal() - FIRST_DAY, DAYS, "date")).strftime(form)


def _in_kind(old: str, new: str) -> str:
    """The new value of as many characters, its digits in the script of the old one's at their place."""
    return "".join(chr(ord(a) - int(a) + int(b)) if ord(a) in TO_ASCII else b for a, b in zip(old, new, strict=True))


def replace(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the old text."""
    if not text.isascii() and OTHER_DIGIT.search(text):
        new, spans = _replace(text.translate(TO_ASCII), f)
        out, at = [], 0
        for _, start, end in spans:  # lengths stay
            out += [text[at:start], _in_kind(text[start:end], new[start:end])]
            at = end
        return "".join([*out, text[at:]]), spans
    return _replace(text, f)


def _replace(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    found = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            if (new := pseudonym(f, "email", m[0])) is not None:
                found.append((m.start(), m.end(), "email", new))
    emails, at_email, pos = list(found), 0, 0  # addresses and numbers ascend: one sweep over both
    while m := NUMBER.search(text, pos):
        value = m[0]
        new = pseudonym(f, m.lastgroup, value)
        while new is None and m.lastgroup == "iban" and " " in value:  # its last groups may be words that follow
            value = value.rpartition(" ")[0]
            new = pseudonym(f, "iban", value)
        end = m.start() + len(value)
        while at_email < len(emails) and emails[at_email][1] <= m.start():
            at_email += 1
        if new is None or (at_email < len(emails) and emails[at_email][0] < end):
            pos = m.start() + 1  # another kind may begin inside
            continue
        found.append((m.start(), end, m.lastgroup, new))
        pos = end
    out, at = [], 0
    for start, end, _, new in sorted(found):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [(k, s, e) for s, e, k, _ in sorted(found)]


def pseudonymised(docs: DataFrame, key: bytes, counts: str | None = None) -> DataFrame:
    """docs, all columns, with pseudonyms in ``text``; ``counts`` names a further column of the number replaced.

    A null text stays null, an empty one empty. Invalid numbers and dates stay.
    Equal values have equal pseudonyms under one key, whatever the separators.
    Lengths stay. No shuffle; repeated rows stay.
    """
    out = docs.withColumn(counts, F.lit(0).cast("long")) if counts else docs
    schema = out.schema

    def run(batches):
        f = Feistel(key)
        for batch in sliced(batches):
            texts, n = [], []
            for text in batch.column("text").to_pylist():
                new, spans = replace(text, f) if text else (text, [])
                texts.append(new)
                n.append(len(spans))
            i = batch.schema.get_field_index("text")
            batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            if counts:
                j = batch.schema.get_field_index(counts)
                batch = batch.set_column(j, batch.schema.field(j), pa.array(n, pa.int64()))
            yield batch

    return out.mapInArrow(run, schema)
