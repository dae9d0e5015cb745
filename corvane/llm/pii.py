"""Personal data replaced by format-preserving pseudonyms.

Numbers, dates, addresses and keys are found, validated, and permuted within their own format by a keyed
Feistel network: a card number becomes another card number that passes the same check, a date another
date. A permutation maps equal values to equal pseudonyms, so records stay linked across documents
without any table, and the holder of the key can undo it. Secrets and keys of any length are taken whole; where the
values of a format exceed SHORT, the rounds run over its symbols instead of one number, in time linear in the length.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Values of a format up to which they are permuted as one number: a half is at most 128 bits, well within a round's 192.
SHORT = 2**256
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _round(key: bytes, tweak: bytes, i: int, half: int, n: int) -> int:
    h = hashlib.blake2b(b"%s|%d|%d|%d" % (tweak, n, i, half), key=key, digest_size=24)
    return int.from_bytes(h.digest(), "big")


def feistel(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size), ``size`` at least 2: alternating modular Feistel rounds, cycle-walked."""
    a = max(2, math.isqrt(size - 1) + 1)
    while True:
        left, right = divmod(value, a)
        if not inverse:
            for i in range(ROUNDS):
                left, right = right, (left + _round(key, tweak, i, right, size)) % a
        else:
            for i in reversed(range(ROUNDS)):
                left, right = (right - _round(key, tweak, i, left, size)) % a, left
        value = left * a + right
        if value < size:
            return value


def _long(symbols: list[int], radix: list[int], key: bytes, tweak: bytes, inverse: bool) -> list[int]:
    """A keyed permutation of sequences of symbols, each below its radix (256 at most).

    Alternating Feistel rounds: the symbols of one half are shifted by a key stream that hangs on the other half.
    """
    cut = len(symbols) // 2
    halves, radices = np.split(np.array(symbols, np.int64), [cut]), np.split(np.array(radix, np.int64), [cut])
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        t = i % 2
        seed = hashlib.blake2b(b"%s|%d|" % (tweak, i) + halves[1 - t].astype(np.uint8).tobytes(), key=key).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(halves[t])), "<u8")
        shift = (stream % radices[t].astype(np.uint64)).astype(np.int64)
        halves[t] = (halves[t] - shift if inverse else halves[t] + shift) % radices[t]
    return np.concatenate(halves).tolist()


def _walk(value: int, size: int, ok: Callable[[int], bool], key: bytes, tweak: bytes, inverse: bool) -> int:
    """The permutation kept inside the values that are ok."""
    while True:
        value = feistel(value, size, key, tweak, inverse)
        if ok(value):
            return value


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


# First and last of the leading four digits that card issuers use, and how many digits such a number may have.
ISSUERS = (
    (2221, 2720, 16, 16), (3000, 3059, 14, 19), (3095, 3095, 14, 19), (3400, 3499, 15, 15), (3528, 3589, 16, 19), (3600, 3699, 14, 19), (3700, 3799, 15, 15),
    (3800, 3999, 14, 19), (4000, 4999, 13, 19), (5000, 5099, 13, 19), (5100, 5599, 16, 16), (5600, 5899, 13, 19), (6000, 6999, 13, 19),
)


def card_number(digits: str) -> bool:
    """The check digit is right and the number begins as an issuer's numbers of that length do."""
    return luhn(digits) and any(lo <= int(digits[:4]) <= hi and least <= len(digits) <= most for lo, hi, least, most in ISSUERS)


def _card(digits: str, key: bytes, inverse: bool) -> str:
    """The digits after the issuer's four, so that the check digit stays right."""
    head, n = digits[:4], len(digits) - 4
    tail = _walk(int(digits[4:]), 10**n, lambda v: luhn(f"{head}{v:0{n}d}"), key, b"card" + head.encode(), inverse)
    return f"{head}{tail:0{n}d}"


def _fit(template: str, symbols: str) -> str:
    """``template`` with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in template)


def _characters(text: str, key: bytes, kind: bytes, inverse: bool) -> str:
    """Each ASCII digit, capital and small letter becomes one of its kind."""
    value, size, radix = 0, 1, []
    for c in text:
        base = next((b for b in ("09", "AZ", "az") if b[0] <= c <= b[1]), None)
        radix.append(base)
        if base and size <= SHORT:
            n = ord(base[1]) - ord(base[0]) + 1
            value, size = value * n + ord(c) - ord(base[0]), size * n
    if size == 1:
        return text
    shape = "".join({None: "-", "09": "9", "AZ": "A", "az": "a"}[b] for b in radix).encode()
    if size > SHORT:
        at = [k for k, b in enumerate(radix) if b]
        new = _long([ord(text[k]) - ord(radix[k][0]) for k in at], [ord(radix[k][1]) - ord(radix[k][0]) + 1 for k in at], key, kind + shape, inverse)
        out = list(text)
        for k, v in zip(at, new, strict=True):
            out[k] = chr(ord(radix[k][0]) + v)
        return "".join(out)
    value = feistel(value, size, key, kind + shape, inverse)
    out = []
    for c, base in zip(reversed(text), reversed(radix), strict=True):
        if base:
            value, v = divmod(value, ord(base[1]) - ord(base[0]) + 1)
            c = chr(ord(base[0]) + v)
        out.append(c)
    return "".join(reversed(out))


def _hex(digits: str, key: bytes, tweak: bytes, inverse: bool) -> str:
    """Small hex digits, some of them numbers and some letters, to such ones."""
    n = len(digits)
    while True:
        if 16**n > SHORT:
            digits = "".join(f"{v:x}" for v in _long([int(c, 16) for c in digits], [16] * n, key, tweak, inverse))
        else:
            digits = f"{feistel(int(digits, 16), 16**n, key, tweak, inverse):0{n}x}"
        if not (digits.isdigit() or digits.isalpha()):
            return digits


def _cased(text: str, key: bytes, kind: bytes, inverse: bool) -> str:
    """``_characters`` of the lower-cased text with the capitals where they were: spellings of one name stay linked."""
    out = _characters("".join(c.lower() if "A" <= c <= "Z" else c for c in text), key, kind, inverse)
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(text, out, strict=True))


def _date(y: int, m: int, d: int) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    return day if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _move_date(day: datetime.date, key: bytes, inverse: bool) -> datetime.date:
    return datetime.date.fromordinal(FIRST_DAY + feistel(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", inverse))


def _iban_check(body: str, country: str) -> str:
    as_number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(as_number) % 97:02d}"


# What the kinds look like. The order is the order of precedence at one place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])(?P<lead>[._%+\-]*+)(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-]*+)@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "day_date": r"(?<![0-9./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]|[./][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}|[0-9]{3}(?P<dash>[ .\-])[0-9]{3}(?P=dash)[0-9]{4}|0[0-9](?:[ .\-][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /\-][0-9]{5,8}(?!-[0-9]))(?![0-9])|(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}[ .\-]?|00[1-9][0-9]{0,2}[ .\-])[0-9]{2,6}(?:[ .\-]?[0-9]{2,6}){1,4}(?![0-9])|(?<![A-Za-z])(?i:tel|telephone|telefon|phone|mobile|fax)\.?\s{0,2}:?\s{0,2}(?P<short>[0-9]{3}[ .\-][0-9]{4})(?![0-9]|-[0-9])",
    "secret": r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<hidden>[A-Za-z0-9+/_.\-]{8,})",
    "hex_key": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.\-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ \-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4})(?![0-9A-Za-z]|[.\-][0-9])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: Every kind holds a digit or an @.
HINT = re.compile(r"[0-9@]")


def _swap(m: re.Match, key: bytes, inverse: bool) -> tuple[str, str | None]:
    """The pseudonym and the kind, or the text itself and None if the validation fails."""
    kind = next(k for k in KINDS if m[k] is not None)
    value = m[0]
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "email":
        lead, local = m["lead"], m["local"]
        return lead + _cased(local, key, b"email", inverse) + value[len(lead) + len(local) :], kind
    if kind == "secret":
        hidden = m["hidden"]
        if not any(c.isdigit() for c in hidden):
            return value, None
        return value[: -len(hidden)] + _characters(hidden, key, b"secret", inverse), kind
    if kind == "iban":
        plain = value.replace(" ", "")
        if _iban_check(plain[4:], plain[:2]) != plain[2:4]:
            return value, None
        body = _characters(plain[4:], key, b"iban" + plain[:2].encode(), inverse)
        return _fit(value, plain[:2] + _iban_check(body, plain[:2]) + body), kind
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return value, None
        n = feistel(int.from_bytes(bytes(octets), "big"), 2**32, key, b"ip", inverse)
        return ".".join(map(str, n.to_bytes(4, "big"))), kind
    if kind == "iso_date":
        day = _date(*map(int, value.split("-")))
        return (value, None) if day is None else (_move_date(day, key, inverse).isoformat(), "date")
    if kind == "day_date":
        sep = m["sep"]
        x, y, year = map(int, value.split(sep))
        # month first only where it can't be the day; each of both forms, and each width of its numbers, is permuted in itself
        day, first = (_date(year, y, x), True) if y <= 12 else (_date(year, x, y), False)
        if day is None:
            return value, None
        wide = [len(n) for n in value.split(sep)[:2]]
        while True:
            day = _move_date(day, key, inverse)
            parts = (day.day, day.month) if first else (day.month, day.day)
            if (first or day.day > 12) and all(n < 10**w for n, w in zip(parts, wide, strict=True)):
                return sep.join(f"{n:0{w}d}" for n, w in zip((*parts, day.year), (*wide, 4), strict=True)), "date"
    if kind == "ssn":
        ok = lambda v: not (v // 10**6 in (0, 666) or v // 10**8 == 9 or v // 10**4 % 100 == 0 or v % 10**4 == 0)
        if not ok(int(digits)):
            return value, None
        return _fit(value, f"{_walk(int(digits), 10**9, ok, key, b'ssn', inverse):09d}"), kind
    if kind == "phone":
        if m["short"] is not None:
            return value[: -len(m["short"])] + _characters(m["short"], key, b"phone", inverse), kind
        if not 7 <= len(digits) <= 15:
            return value, None
        # the country's code, or the zero and digit before a national number, stays: it is what such a number is known by
        head = re.match(r"(?:\+|00)[0-9]{1,3}(?![0-9])|\+[0-9]", value) or (m["dash"] is None and re.match("0[0-9]", value))
        code = re.sub(r"[^0-9]", "", head[0]) if head else ""
        rest = digits[len(code) :]
        if len(rest) < 4:
            return value, None
        return _fit(value, code + _characters(rest, key, b"phone" + code.encode(), inverse)), kind
    if kind == "hex_key":
        upper = value.upper() == value
        out = _hex(value.lower(), key, b"hex%d%d" % (len(value), upper), inverse)
        return (out.upper() if upper else out), kind
    if not card_number(digits):
        return value, None
    return _fit(value, _card(digits, key, inverse)), kind


def pseudonymise(text: str | None, key: bytes, inverse: bool = False) -> tuple[str | None, list[str]]:
    """The text with every validated value replaced (or, ``inverse``, restored) and the kinds replaced."""
    if not text or not HINT.search(text):
        return text, []
    kinds: list[str] = []

    def one(m: re.Match) -> str:
        new, kind = _swap(m, key, inverse)
        if kind:
            kinds.append(kind)
        return new

    return PATTERN.sub(one, text), kinds


COUNTED = ("email", "iban", "ip", "date", "ssn", "phone", "secret", "hex_key", "card")


def pseudonyms(docs: DataFrame, *, key: str, text: str = "text", counts: str = "n_pii", inverse: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a column ``counts``: struct with the number replaced of each kind.

    Null stays null, other columns stay, each row is treated by itself (no shuffle), so repeated rows get equal results, and an
    existing column called ``counts`` is refused. What fails its validation (an octet over 255, a date that
    doesn't exist, a wrong IBAN check, a card number of no issuer or without its check digit) is left alone. Where two kinds
    begin at one place, the earlier one in KINDS is taken. Texts of any length are read in one pass, in time linear in the length.
    """
    if counts in docs.columns:
        raise ValueError(f"docs has a column {counts}")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf("text string, " + ", ".join(f"{k} bigint" for k in COUNTED))
    def swap(s: pd.Series) -> pd.DataFrame:
        done = [pseudonymise(t, secret, inverse) for t in s]
        return pd.DataFrame([(t, *map(kinds.count, COUNTED)) for t, kinds in done], columns=["text", *COUNTED])

    out = docs.withColumn(counts, swap(F.col(text).cast("string")))
    cols = [F.col(f"{counts}.text").alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*cols, F.struct(*[F.col(f"{counts}.{k}").alias(k) for k in COUNTED]).alias(counts))
