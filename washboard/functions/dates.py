"""Date detection and parsing on text columns.

A date text is reduced to ``year-month-day`` by the first shape it matches and then checked by a cast.
Month comes first in slashed dates; day first is tried when the month is not possible. Regular
expressions and casts only, so no parser exceptions are raised for the many texts that are no dates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard.functions.text import as_col, strip_ws

# --- fixed values: the published patterns; (?U) gives \d, \s and \b the meaning they have for Unicode text ---
DATE_SIGNAL = (
    r"(?U)(?:\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
    r"|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
    r"|\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\b"
    r"|\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}\b)"
)
TIME_ONLY = r"(?U)^\s*\d{1,2}:\d{2}(:\d{2})?\s*([AaPp][Mm])?\s*$"
# --- end of fixed values ---

_DAYS = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?"
_MONTHS = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_CLOCK24 = r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?"
_CLOCK12 = r"(?:0?[1-9]|1[0-2])(?::[0-5][0-9]){1,2}\s*[ap]m"
_ZONE = r"\s*(?:z|[+-][0-9]{2}:?[0-9]{2})?"
_TIME_TAIL = rf"(?i)(?:t|\s+)(?:{_CLOCK12}|{_CLOCK24}{_ZONE})\z"
_YEAR_FIRST = r"^([0-9]{4})[-/. ]([0-9]{1,2})[-/. ]([0-9]{1,2})\z"
_YEAR_LAST = r"^([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{4}|[0-9]{2})\z"
_DAY_NAME = rf"(?i)^([0-9]{{1,2}})(?:st|nd|rd|th)?[-/ ]?{_MONTHS}[-/., ]{{0,2}}([0-9]{{4}}|[0-9]{{2}})\z"
_NAME_DAY = rf"(?i)^{_MONTHS}[-/. ]{{1,2}}([0-9]{{1,2}})(?:st|nd|rd|th)?[-/, ]{{1,2}}([0-9]{{4}}|[0-9]{{2}})\z"
_NAME_YEAR = rf"(?i)^{_MONTHS}[-/., ]{{1,2}}([0-9]{{4}})\z"
_YEAR_NAME = rf"(?i)^([0-9]{{4}})[-/ ]{_MONTHS}[-/ ]([0-9]{{1,2}})\z"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"
_YEAR_MONTH = r"^([0-9]{4})[-/.]([0-9]{1,2})\z"
_MONTH_YEAR = r"^([0-9]{1,2})[-/.]([0-9]{4})\z"
_YEAR_ONLY = r"^[0-9]{4}\z"
_QUARTER = r"(?i)^(?:([0-9]{4})[- ]?q([1-4])|([1-4])[- ]?q([0-9]{4}))\z"

# calendar span of a nanosecond timestamp, which bounds the dates the published results can hold
FIRST_DAY, LAST_DAY = date(1677, 9, 22), date(2262, 4, 11)


def has_date_signal(c) -> Column:
    return as_col(c).rlike(DATE_SIGNAL)


def is_time_only(c) -> Column:
    return as_col(c).rlike(TIME_ONLY)


def date_core(c) -> Column:
    """The date part of a text: stripped, without a weekday in front and a valid time of day behind."""
    return F.regexp_replace(
        F.regexp_replace(strip_ws(c), rf"(?i)^{_DAYS}[., ]+", ""), _TIME_TAIL, ""
    )


def _full_year(year: Column, reference_year: int) -> Column:
    """Two digits mean the century that keeps the year within fifty years of the reference year."""
    century = reference_year // 100 * 100
    guess = year.try_cast("int") + F.lit(century)
    near = (
        F.when(guess >= reference_year + 50, guess - 100)
        .when(guess < reference_year - 50, guess + 100)
        .otherwise(guess)
    )
    return F.when(F.length(year) == 2, near.cast("string")).otherwise(year)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _month_number(month: Column) -> Column:
    """Number of a month given by number, by name or by quarter (``q2``)."""
    start = F.position(F.lower(F.substring(month, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return (
        F.when(month < "A", month)
        .when(month.startswith("q"), (F.substring(month, 2, 1).try_cast("int") * 3 - 2).cast("string"))
        .otherwise(F.floor((start + F.lit(2)) / F.lit(3)).cast("string"))
    )


# The order in which shapes are tried, and where year, month and day stand in them; a fourth part says that month and day may be
# the other way round. Groups that took no part in the match are empty.
_SHAPES = (
    (_YEAR_FIRST, "$1|$2|$3"), (_YEAR_LAST, "$3|$1|$2|either"), (_DAY_NAME, "$3|$2|$1"), (_NAME_DAY, "$3|$1|$2"),
    (_COMPACT, "$1|$2|$3"), (_YEAR_ONLY, "$0|1|1"), (_YEAR_MONTH, "$1|$2|1"), (_MONTH_YEAR, "$2|$1|1"),
    (_NAME_YEAR, "$2|$1|1"), (_YEAR_NAME, "$1|$2|$3"), (_QUARTER, "$1$4|q$2$3|1"),
)


def parse_core(core, reference_year: int | None = None) -> Column:
    """Date of a text that went through ``date_core``; null when it is no date.

    Every shape is first written as ``year|month|day``, so that the steps behind it stand in the plan once."""
    core = as_col(core)
    reference_year = reference_year or date.today().year
    found = F.lit(None).cast("string")
    for shape, order in reversed(_SHAPES):
        found = F.when(core.rlike(shape), F.regexp_replace(core, shape, order)).otherwise(found)
    parts = F.split(found, r"\|")
    year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
    year, month = _full_year(year, reference_year), _month_number(month)
    swapped = F.when(F.size(parts) > 3, _day(year, day, month))
    parsed = F.coalesce(F.when(found.isNotNull(), _day(year, month, day)), swapped)
    return F.when(parsed.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), parsed)


def parse_mixed(c, reference_year: int | None = None) -> Column:
    """Date of a text in any supported shape; a lone time of day is not a date."""
    return parse_core(date_core(c), reference_year)


def format_mdy(d) -> Column:
    return F.date_format(as_col(d), "MM/dd/yyyy")
