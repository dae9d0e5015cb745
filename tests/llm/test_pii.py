from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from helpers import awkward, empty
from support import SMALL, database

from corvane.llm import pii, queries

KEY = hashlib.blake2b(b"k", digest_size=32).digest()
TEXT = "mail a.b99@x.org or +1 (017) 555-7713, card 4111111111111111, 4111-1111-1111-1111, no 1234567890123456, ip 10.0.0.1. Born 1980-02-29 or 29.02.1980 or 12/31/1999; ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32 x \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""


@pytest.mark.parametrize("size", [2, 3, 7, 10, 100, 1000])
def test_feistel_is_a_permutation(size):
    image = [pii.feistel(v, size, KEY, b"t") for v in range(size)]
    assert sorted(image) == list(range(size))
    assert [pii.feistel(v, size, KEY, b"t", inverse=True) for v in image] == list(range(size))


def test_round_trip_and_formats():
    out, kinds = pii.pseudonymise(TEXT, KEY)
    assert pii.pseudonymise(out, KEY, inverse=True)[0] == TEXT
    assert sorted(kinds) == sorted(["email", "phone", "card", "card", "ip", "date", "date", "date", "ssn", "iban", "hex_key"])
    for secret in ("a.b99@", "555-7713", "4111111111111111", "10.0.0.1", "1980-02-29", "123-45-6789", "WEST", "b44e15e0"):
        assert secret not in out
    card = out.split("card ")[1].split(",")[0]
    assert len(card) == 16 and pii.luhn(card)
    again = out.split("card ")[1].split(", ")[1].replace("-", "")
    assert "no 1234567890123456," in out  # no check digit
    assert again == card  # equal values stay linked whatever their spacing
    assert pii.pseudonymise(TEXT, KEY)[0] == out and pii.pseudonymise(TEXT, KEY[::-1])[0] != out


def test_more_phones_and_secrets():
    t = "call 017-555-7713 or 017 555 7713 or (017) 555-7713 or 01 23 45 67 89 or +49 30 1234567; api_key=Ab1-xY9zQ4kk2 password: hunter2hunter"
    out, kinds = pii.pseudonymise(t, KEY)
    assert kinds.count("phone") == 5 and kinds.count("secret") == 2 and pii.pseudonymise(out, KEY, inverse=True)[0] == t
    for secret in ("555-7713", "555 7713", "23 45 67", "1234567", "Ab1-xY9z", "hunter2"):
        assert secret not in out


def test_long_secrets_take_no_longer():
    t = "token = " + "aB3" * 80
    out, kinds = pii.pseudonymise(t, KEY)
    assert kinds == ["secret"] and out != t and len(out) == len(t) and pii.pseudonymise(out, KEY, inverse=True)[0] == t


@pytest.mark.parametrize("n", [44, 128, 256, 257, 1000, 20_000])
def test_long_secrets_are_replaced_whole(n):
    rng = random.Random(n)
    hidden = "".join(rng.choices("ABCdefghi0123456789+/_.-", k=n - 2)) + "9z"
    out, kinds = pii.pseudonymise(f"token={hidden} end", KEY)
    new = out[len("token=") : -len(" end")]
    assert kinds == ["secret"] and len(new) == n and pii.pseudonymise(out, KEY, inverse=True)[0] == f"token={hidden} end"
    assert not any(hidden[k : k + 16] == new[k : k + 16] for k in range(n - 15))
    other = pii.pseudonymise(f"token={hidden[:-1]}q end", KEY)[0][len("token=") : -len(" end")]
    assert not any(other[k : k + 16] == new[k : k + 16] for k in range(n - 15))  # an equal head is no link


@pytest.mark.parametrize("n", [32, 64, 65, 128, 129, 1000, 20_000])
def test_long_hex_keys_are_replaced_whole(n):
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        value = "".join(random.Random(n).choices(digits, k=n))
        out, kinds = pii.pseudonymise(f"x {value} y", KEY)
        assert kinds == ["hex_key"] and len(out) == n + 4 and set(out[2:-2]) <= set(digits)
        assert pii.pseudonymise(out, KEY, inverse=True)[0] == f"x {value} y"
        assert not any(value[k : k + 16] == out[k + 2 : k + 18] for k in range(n - 15))


def test_what_is_not_valid_stays():
    t = "ip 300.1.1.1 date 2023-02-30 iban GB00 WEST 1234 5698 7654 32 ssn 000-12-3456 version 3.1 CC BY-NC 4.0. year 2024, 12345"
    assert pii.pseudonymise(t, KEY) == (t, [])


def test_dates_keep_their_form():
    for t in ("3.4.1980", "13.4.1980", "3.12.1980", "03.4.1980", "29/2/2024", "12/31/1999", "1/31/1999", "03.04.1980"):
        out, kinds = pii.pseudonymise(t, KEY)
        assert kinds == ["date"] and [len(x) for x in out.replace("/", ".").split(".")] == [len(x) for x in t.replace("/", ".").split(".")]
        assert pii.pseudonymise(out, KEY, inverse=True)[0] == t
    days = [f"{d}.{m}.{y}" for y in range(1990, 2000) for m in range(1, 10) for d in range(1, 10)]
    assert len({pii.pseudonymise(t, KEY)[0] for t in days}) == len(days)


def test_spellings_of_one_address_stay_linked():
    a, b = (pii.pseudonymise(t, KEY)[0] for t in ("john.doe7@x.org", "John.Doe7@x.org"))
    assert a == b.lower() and b[0].isupper() and pii.pseudonymise(b, KEY, inverse=True)[0] == "John.Doe7@x.org"


def test_national_and_short_phones():
    for t in ("030 1234567", "0049 30 123456", "Tel: 555-1234", "+49 30 1234567", "0171/1234567"):
        out, kinds = pii.pseudonymise(f"at {t} now", KEY)
        assert kinds == ["phone"] and pii.pseudonymise(out, KEY, inverse=True)[0] == f"at {t} now"
    for t in ("pages 555-1234", "id 0012345678", "1706000000001", "sum 0123456"):
        assert pii.pseudonymise(t, KEY) == (t, [])


@pytest.mark.parametrize("run", ["a" * 1_000_000, "a." * 400_000, "x@" * 300_000, "9" * 1_000_000, "0-" * 400_000, "aB3/+" * 200_000, "x@" + "b-" * 400_000, "token " * 150_000, "12." * 300_000])
def test_time_is_linear(run):
    began = time.process_time()
    pii.pseudonymise(run + " 1", KEY)
    assert time.process_time() - began < 20


def plain(text):
    """Spans of what is certainly personal: read word by word, with checks of their own."""
    out = []
    for m in re.finditer(r"\S+", text):
        word = m[0].strip('".,;:()|$%&#*<>!?')
        at = m.start() + m[0].find(word)
        digits = word.replace("-", "")
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits))) if digits.isdigit() else 1
        octets = word.split(".")
        if word.count("@") == 1 and "." in word.split("@")[1] and word.isascii():
            out.append((at, at + word.index("@")))
        elif digits.isdigit() and len(digits) == 16 and digits[0] in "23456" and total % 10 == 0 and pii.card_number(digits):
            out.append((at, at + len(word)))
        elif len(octets) == 4 and all(o.isdigit() and int(o) < 256 for o in octets):
            out.append((at, at + len(word)))
        elif len(word) >= 32 and set(word) <= set("0123456789abcdef") and not word.isdigit() and not word.isalpha():
            out.append((at, at + len(word)))
    return out + [m.span(1) for m in re.finditer(r"\+1 (\(\d{3}\) \d{3}-\d{4})", text)]


def test_query_against_plain_version(spark):
    texts = dict(database(SMALL).execute("SELECT doc_id, text FROM documents").fetchall())
    secret = hashlib.blake2b(queries.PII_KEY.encode(), digest_size=32).digest()
    found = 0
    for r in queries.op6_pii(spark, SMALL).collect():
        old = texts[r.doc_id]
        if old is None:
            assert r.text is None
            continue
        assert pii.pseudonymise(r.text, secret, inverse=True)[0] == old
        spans, at, kept = sorted(plain(old)), 0, ""
        for a, b in spans:
            kept, at = kept + re.escape(old[at:a]) + rf"(?!{re.escape(old[a:b])}(?![0-9A-Za-z]))([^\n]{{1,60}}?)", b
        assert re.fullmatch(kept + re.escape(old[at:]), r.text, re.S)
        assert sum(r[f"n_{k}"] for k in pii.COUNTED) == len(spans)
        found += len(spans)
    assert found > 0


def test_random_numbers_stay_distinct():
    rng = random.Random(3)
    cards = {f"4{rng.randrange(10**15):015d}" for _ in range(3000)}
    out = [pii.pseudonymise(c, KEY)[0] for c in cards]
    assert len(set(out)) == len(cards) and all(pii.luhn(a) == pii.luhn(b) and (a != b) == pii.luhn(a) for a, b in zip(cards, out, strict=True))


def test_awkward_rows(spark):
    out = pii.pseudonyms(awkward(spark), key="k")
    assert out.count() == 10 and out.columns == [*awkward(spark).columns, "n_pii"]
    assert {r.doc_id: r.text for r in out.collect()}[3] is None
    assert pii.pseudonyms(empty(spark), key="k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonyms(awkward(spark), key="k", counts="rank")
