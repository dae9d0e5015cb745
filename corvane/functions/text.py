"""Text functions: normal forms, sentences, excerpts, markers and speaker labels.

All take and return columns. Patterns are Unicode-aware where letters beyond ASCII count as letters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def compact(text: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def fixed(value: Column, form: str) -> Column:
    """``value`` in a form such as %.2f, rounded by what the double is exactly, as C and Python do: 0.15 in %.1f is 0.1, where format_string gives 0.2."""

    @F.arrow_udf("string")
    def shown(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else form % x for x in v.to_pylist()], pa.string())

    return shown(value.cast("double"))


def title_key(text: Column) -> Column:
    """Lower case, ASCII letters, digits and single spaces only."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)[^a-z0-9\s]", "")
    return F.regexp_replace(kept, WHITE, " ")


def quote_key(text: Column) -> Column:
    return compact(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def name_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def ticker(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9.-]", "")


def sentences(text: Column) -> Column:
    """array<string>: a sentence ends at . ! or ? before white space, which a compact text has as single spaces."""
    return F.filter(F.split(compact(text), " (?<=[.!?] )"), lambda s: s != "")


def excerpt(text: Column, chars: int = 160) -> Column:
    """The first sentence if it fits, else the text if it fits, else its head and an ellipsis."""
    whole = compact(text)
    first = F.get(F.split(whole, r"(?<=[.!?])\s+"), F.lit(0))
    head = F.concat(F.rtrim(F.substring(whole, 1, chars - 1)), F.lit("…"))
    return F.when(F.length(first).between(1, chars), first).when(F.length(whole) <= chars, whole).otherwise(head)


def head_and_tail(text: Column, chars: int = 700) -> Column:
    """Long texts keep three quarters of ``chars`` from the head and the rest from the tail."""
    whole = compact(text)
    head = int(chars * 0.75)
    tail = chars - head - 5
    cut = F.concat(F.rtrim(F.substring(whole, 1, head)), F.lit(" ... "), F.ltrim(F.substring(whole, -tail, tail)))
    return F.when(F.length(whole) <= chars, whole).otherwise(cut)


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether any marker occurs, as a plain substring of the lower-cased text."""
    low = F.lower(text)
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(low, F.lit(m))
    return found


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


#: Words of names that tell no company.
GENERIC = ("inc", "corp", "ltd", "plc", "group", "company", "holdings")


def company_tokens(name: str | None) -> list[str]:
    """Words of a company's name that identify it."""
    return [t for t in re.split(r"[^a-z0-9]+", (name or "").lower()) if len(t) >= 4 and t not in GENERIC]


def phrase(term: str) -> str:
    """A pattern for the whole word or phrase, not inside another word. The term comes first: what stands before it is looked at only where it is found."""
    t = rf"\Q{term.lower()}\E"
    return rf"(?U){t}(?!\w)(?<!\w{t})"


def mentions(text: Column, symbol: str) -> Column:
    """The symbol as a word, or with a dollar sign anywhere."""
    low = F.lower(text)
    return low.rlike(phrase(symbol)) | F.contains(low, F.lit(f"${symbol.lower()}"))


def speaker_label(label: Column) -> Column:
    """A speaker's label without what stands after a dash or, in brackets, for a title."""
    head = F.trim(F.substring_index(compact(label), " -- ", 1))
    bare = F.regexp_replace(head, r"(?i)\s+\([^)]*(officer|analyst|operator|relations|director|president|chief)[^)]*\)\s*$", "")
    return F.regexp_replace(compact(bare), r"^[ \-]+|[ \-]+$", "")


def name_and_role(text: Column) -> Column:
    """struct<name, role> of ``Name - role`` or ``Name, role``; a name alone has no role."""
    dash = F.regexp_replace(text, r"\s+(?:--|—|–|-)\s+", " -- ")
    by = F.when(F.contains(dash, F.lit(" -- ")), F.lit(" -- ")).when(F.contains(dash, F.lit(",")), F.lit(","))
    at = F.position(by, dash)
    name = F.when(by.isNull(), dash).otherwise(F.substr(dash, F.lit(1), at - 1))
    role = F.when(by.isNull(), F.lit("")).otherwise(F.substr(dash, at + F.length(by)))
    return F.struct(F.trim(name).alias("name"), F.trim(role).alias("role"))


SPEAKER_LINE = r"^([A-Za-z][A-Za-z .,'&()\-/]{1,80}):\s*(.+)$"


def speaker_line(line: Column) -> Column:
    """struct<speaker, spoken> of a ``Name: text`` line; null for any other line."""
    trimmed = F.trim(line)
    spoken = F.trim(F.regexp_extract(trimmed, SPEAKER_LINE, 2))
    who = compact(F.regexp_extract(trimmed, SPEAKER_LINE, 1))
    return F.when(trimmed.rlike(SPEAKER_LINE) & (F.length(spoken) >= 2), F.struct(who.alias("speaker"), spoken.alias("spoken")))
