"""Dates as evidence: strict parsing, never guessing a missing part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.patterns import by_alphabet, found, java
from tracewell.functions.text import clean_lines, let, strip_space

ISO_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` when the day exists, else null.  Arguments are digit strings."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return let(text, lambda t: F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t))


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(v) for i, m in enumerate(K.MONTHS) for v in (m.lower(), str(i + 1))])
    return F.coalesce(F.try_element_at(numbers, F.lower(name)), F.lit("x"))


def _date_from(text: Column, pattern: str, order: tuple[int, int, int], named: bool) -> Column:
    part = lambda g: F.regexp_extract(text, java(pattern, True), g)
    year, month, day = (part(g) for g in order)
    return calendar_date(year, _month_number(month) if named else month, day)


_ISO_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})\z"
_MONTH_FIRST = r"^(" + K.MONTH + r")\s+(\d{1,2}),?\s+(\d{4})\z"
_DAY_FIRST = r"^(\d{1,2})\s+(" + K.MONTH + r")\s+(\d{4})\z"
_DATED_CLOCK = r"^(\d{4})-(\d{2})-(\d{2})(?:T|\s)(.+)\z"
_CLOCK = r"(?:T|\s)\d{1,2}:\d{2}"


def _in_years(date: Column, as_of: int) -> Column:
    return let(date, lambda d: F.when(F.substring(d, 1, 4).cast("int").between(1900, as_of + 1), d))


def normalize_evidence_date(raw: Column, as_of: int) -> Column:
    """A publisher's date as ``yyyy-MM-dd`` or a UTC instant; null unless it is unambiguous.

    ``as_of`` is the current year; a date may lie at most one year after it.
    """
    return let(F.substring(clean_lines(raw), 1, 120), lambda value: F.when(
        ~found(value, K.RELATIVE_AGE) & found(value, K.HAS_YEAR), _in_years(_parsed(value), as_of)
    ))


def _parsed(value: Column) -> Column:
    # A clock without an offset counts as UTC, which is the session time zone.
    bare = F.regexp_replace(value, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    # one spelling for all: day before month, three letters of the month, seconds
    bare = F.regexp_replace(bare, r"^([A-Z][a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+", "$2 $1 $3 ")
    bare = F.regexp_replace(bare, r"^(\d{1,2})\s+([A-Z][a-z]{2})[a-z]*\.?\s+(\d{4}),?\s+", "$1 $2 $3 ")
    bare = F.regexp_replace(bare, r"(\s\d{2}:\d{2})(?![:\d])", "$1:00")
    spelled = let(bare, lambda text: F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")),
    ))
    real_day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull()
    return (
        F.when(found(value, _ISO_DATE), _date_from(value, _ISO_DATE, (1, 2, 3), False))
        .when(found(value, _MONTH_FIRST), _date_from(value, _MONTH_FIRST, (3, 1, 2), True))
        .when(found(value, _DAY_FIRST), _date_from(value, _DAY_FIRST, (3, 2, 1), True))
        .when(~found(value, _CLOCK), None)
        .when(
            found(value, _DATED_CLOCK),
            F.when(real_day, F.date_format(value.try_cast("timestamp"), ISO_INSTANT)),
        )
        .otherwise(F.date_format(spelled, ISO_INSTANT))
    )


def instant_of(date: Column) -> Column:
    """The instant a normalized date stands for (midnight UTC for a day)."""
    return date.try_cast("timestamp")


def strict_date(date: Column) -> Column:
    """True for an existing ``yyyy-MM-dd`` day."""
    return F.coalesce(
        date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull(), F.lit(False)
    )


def event_date(claim: Column) -> Column:
    """The first day named in a claim (2000 onwards).  A bare year is not a day."""
    first = lambda pattern, ignore_case: by_alphabet(
        claim, pattern, ignore_case, lambda p: F.regexp_extract(claim, p, 1))
    day = lambda name: strip_space(F.regexp_replace(name, r"(?i)(\d)(?:st|nd|rd|th)", "$1"))
    named = let(first(K.EVENT_DATE_NAMED, True), lambda name: F.when(
        name != "", let(day(name), lambda d: _date_from(d, _MONTH_FIRST, (3, 1, 2), True))))
    return let(first(K.EVENT_DATE_ISO, False), lambda iso: F.when(
        iso != "", _date_from(strip_space(iso), _ISO_DATE, (1, 2, 3), False)).otherwise(named))


