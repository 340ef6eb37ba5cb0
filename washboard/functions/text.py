"""Text expressions. Each takes a Column (or a column name) and returns a Column."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard import domain

# Java's \s is narrower than Python's whitespace; this class covers the same code points.
WHITESPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"
# Single characters in a class are one table look-up each in Java, ranges are not; over many cells the
# spelled-out classes run several times faster.
LETTERS = string.ascii_letters
LETTERS_DIGITS = string.ascii_letters + string.digits


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(as_col(c), rf"^[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def collapse_ws(c) -> Column:
    """Turn whitespace runs into one space and strip both ends."""
    return F.trim(F.regexp_replace(as_col(c), f"[{WHITESPACE}]+", " "))


def null_like(c, tokens=domain.NULL_TOKENS, *, stripped: bool = False) -> Column:
    """True for null and for texts that stand for null. ``stripped`` says that the column already went
    through ``collapse_ws``, so that a look at the length decides most cells."""
    c = as_col(c)
    if not stripped:
        return c.isNull() | F.lower(strip_ws(c)).isin(*tokens)
    longest = max(map(len, tokens), default=0)
    return c.isNull() | ((F.length(c) <= longest) & F.lower(c).isin(*tokens))


def na_on_load(c, tokens=domain.NA_ON_LOAD) -> Column:
    """Texts that a CSV load reads as null."""
    c = as_col(c)
    return F.when(~c.isin(*tokens), c)


def strip_special(c, safe: bool = False) -> Column:
    """Replace disallowed characters by a space, collapse spaces, strip.

    Illegal characters and whitespace both end up as one space per run, so one pass does it."""
    keep = LETTERS_DIGITS + r"\-." + (r",#/&'()" if safe else "")
    return F.trim(F.regexp_replace(as_col(c), f"[^{keep}]+", " "))


def title_case(c) -> Column:
    """Capital after any non-letter, lower case elsewhere (``o'neil 3rd`` -> ``O'Neil 3Rd``); ASCII text.

    ``initcap`` only looks at spaces, so a marker and a space go before each letter that follows another
    kind of character, and come out again afterwards. All of it stays in generated code."""
    c = as_col(c)
    marked = F.regexp_replace(c, f"([^{LETTERS} ])(?=[{LETTERS}])", "$1\u0001 ")
    inner = F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
    return F.when(c.rlike(f"[^{LETTERS} ][{LETTERS}]"), inner).otherwise(F.initcap(c))


def digits_only(c) -> Column:
    return F.regexp_replace(as_col(c), r"\P{Nd}+", "")


def alnum_key(c) -> Column:
    """Lower case, every other run of characters as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", " "))


def drop_corp_words(c) -> Column:
    """Remove the words ltd, limited and bank; spaces inside stay."""
    return F.trim(F.regexp_replace(as_col(c), r"\b(ltd|limited|bank)\b", ""))


def gender_key(c) -> Column:
    """Lower case with anything but letters and whitespace as a space, stripped."""
    return strip_ws(F.regexp_replace(F.lower(as_col(c)), f"[^a-z{WHITESPACE}]+", " "))


def phone_digits(c) -> Column:
    """Phone number without country prefix, leading zero and punctuation."""
    c = strip_ws(c)
    for prefix in (r"^\+92", "^0092", "^92", "^0"):
        c = F.regexp_replace(c, prefix, "")
    return digits_only(c)


def literal_lookup(pairs: dict[str, str], key: Column) -> Column:
    """Replacement for ``key`` from a short Python mapping, null when it is missing."""
    if not pairs:
        return F.lit(None).cast("string")
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)
