"""Times and numbers as they come in feeds: many spellings to one type, null for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a date, in the order in which they are tried.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyyMMdd'T'HHmmss")


def compact_time(text: Column) -> Column:
    """YYYYMMDDTHHMMSS, UTC."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd'T'HHmmss"))


def iso_time(text: Column) -> Column:
    """ISO 8601; without an offset UTC."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t))


def epoch_time(text: Column) -> Column:
    """Whole seconds since 1970, as text or number."""
    return F.timestamp_seconds(text.cast("string").try_cast("bigint"))


def any_date(text: Column) -> Column:
    """The first of DATE_FORMS that fits, else ISO 8601."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMS], iso_time(t))


def months(first: Column, last: Column) -> Column:
    """array<date>: the first days of the months from one date to another, both included; empty if the last comes first, null for null."""
    a, b = F.trunc(first, "month"), F.trunc(last, "month")
    return F.when(a <= b, F.sequence(a, b, F.expr("INTERVAL 1 MONTH"))).when(a > b, F.array().cast("array<date>"))


def number(text: Column) -> Column:
    """A number written as text; null for none, nan, null, a dash, blanks and what is no number."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(~t.isin("", "none", "nan", "null", "-"), t.try_cast("double"))


def percent_number(text: Column) -> Column:
    """3/4 is 75; else signs and units around the number go."""
    t = F.trim(text.cast("string"))
    a, b = (F.regexp_extract(t, r"^(-?[0-9.]+)\s*/\s*([0-9.]+)$", k).try_cast("double") for k in (1, 2))
    return F.coalesce(F.try_divide(a, b) * 100, F.nullif(F.regexp_replace(t, r"[^0-9.\-]", ""), F.lit("")).try_cast("double"))
