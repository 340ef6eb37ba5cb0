"""Number checks and conversions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions.text import as_col

SIGNED = r"^[+-]?\p{Nd}+(\.\p{Nd}+)?\z"
UNSIGNED = r"^\p{Nd}+(\.\p{Nd}+)?\z"
SCIENTIFIC = r"^[+-]?\p{Nd}+\.?\p{Nd}*[eE][+-]?\p{Nd}+"
# what a number parser accepts; keeps out Java forms such as "12d" and "NaN"
PARSEABLE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def is_number(c) -> Column:
    return as_col(c).rlike(SIGNED)


def is_unsigned_number(c) -> Column:
    return as_col(c).rlike(UNSIGNED)


def is_scientific(c) -> Column:
    return as_col(c).rlike(SCIENTIFIC)


def is_repeated_digit(c) -> Column:
    """Thirteen times the same digit."""
    return as_col(c).rlike(r"^(\p{Nd})\1{12}\z")


def is_fake_id(c, fakes=domain.FAKE_IDS) -> Column:
    return as_col(c).isin(*fakes)


def to_number(c) -> Column:
    """Double, or null where the text is not a number."""
    c = as_col(c)
    return F.when(c.rlike(PARSEABLE), F.trim(c).try_cast("double"))


def expand_scientific(c) -> Column:
    """Scientific notation as integer text, cut towards zero; empty text when it is no number.

    Beyond 19 digits the shortest decimal form of the double is written out, so trailing digits are zeros."""
    number = to_number(c)
    return F.coalesce(
        number.try_cast("bigint").cast("string"), number.try_cast("decimal(38,0)").cast("string"), F.lit("")
    )


def id_digits(c) -> Column:
    """Digits of an identity number, whichever way it was typed."""
    c = as_col(c)
    digits = F.regexp_replace(c, r"\P{Nd}+", "")
    return F.when(is_scientific(c), expand_scientific(c)).otherwise(digits)


def out_of_bounds(c, bounds) -> Column:
    """True when the number lies outside the inclusive bounds; false when it is no number."""
    low, high = bounds
    return F.coalesce(~to_number(c).between(low, high), F.lit(False))


def ceil_pages(total: Column, size: int) -> Column:
    """Pages needed for ``total`` rows, at least one."""
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("bigint")
