"""Row-local cleaning steps: each one is a single projection over the columns it concerns.

Operators take a ``TrackedFrame`` and return one. None of them shuffles. Steps after the first rely on
texts being trimmed already, as they are in ``clean_dataset``; pass ``stripped=False`` for raw input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions import numbers, text
from washboard.operators.tracked import Edit, TrackedFrame
from washboard.rules import ColumnRule, RulePack

SIMPLE_KINDS = ("cnic", "numeric", "float", "bool", "gender", "cell_no")


def trim_whitespace(t: TrackedFrame, columns=None) -> TrackedFrame:
    """Collapse whitespace runs and strip, in every column."""
    return t.update({n: Edit(text.collapse_ws(t.value(n)), "TRIM") for n in columns or t.names})


def null_standardize(t: TrackedFrame, pack: RulePack = RulePack(), columns=None, *, stripped=True) -> TrackedFrame:
    """Null tokens become null; every null cell, native ones too, goes to review."""
    edits = {}
    for n in columns or t.names:
        v = t.value(n)
        empty = text.null_like(v, pack.null_tokens, stripped=stripped)
        edits[n] = Edit(F.when(~empty, v), "NULL_STANDARDIZED", empty)
    return t.update(edits)


def strip_special_chars(t: TrackedFrame, rules, pack: RulePack = RulePack(), *, stripped=True) -> TrackedFrame:
    """Keep letters, digits, hyphen and dot (safe columns: a few more) in text and geo columns."""
    edits = {}
    for rule in rules:
        v = t.value(rule.name)
        empty = text.null_like(v, pack.null_tokens, stripped=stripped)
        clean = text.strip_special(v, rule.special_chars_ok and rule.kind != "geo")
        edits[rule.name] = Edit(F.when(empty, v).otherwise(clean), "SPECIAL_CHARS_CLEANED")
    return t.update(edits)


def apply_casing(t: TrackedFrame, rules, pack: RulePack = RulePack(), *, stripped=True) -> TrackedFrame:
    """Title or upper case; geo columns are always in title case."""
    edits = {}
    for rule in rules:
        casing = "title" if rule.kind == "geo" else rule.casing
        if casing is None:
            continue
        v = t.value(rule.name)
        empty = text.null_like(v, pack.null_tokens, stripped=stripped)
        cased = F.upper(v) if casing == "upper" else text.title_case(v)
        edits[rule.name] = Edit(
            F.when(empty, v).otherwise(cased), "UPPER_CASED" if casing == "upper" else "TITLE_CASED"
        )
    return t.update(edits)


def prepared(rule: ColumnRule, v: Column) -> Column | None:
    """The reduced text a check looks at several times; it gets a projection of its own."""
    if rule.kind == "cnic":
        return numbers.id_digits(v)
    if rule.kind == "cell_no":
        return text.phone_digits(v)
    if rule.kind == "gender":
        return text.gender_key(v)
    if rule.kind == "bool":
        return F.lower(text.strip_ws(v))
    return None


def bool_edit(v: Column, key: Column, present: Column, pack: RulePack) -> Edit:
    known = F.when(key.isin(*pack.no_values), "No").when(key.isin(*pack.yes_values), "Yes")
    return Edit(F.when(present, F.coalesce(known, v)).otherwise(v), "BOOL_STANDARDIZED", present & known.isNull())


def gender_edit(v: Column, key: Column, present: Column, pack: RulePack) -> Edit:
    spellings = {s: label for label, many in pack.gender.items() for s in many}
    known = text.literal_lookup(spellings, key)
    return Edit(F.when(present, F.coalesce(known, v)).otherwise(v), "GENDER_STANDARDIZED", present & known.isNull())


def cnic_edit(v: Column, digits: Column, present: Column, rule: ColumnRule, pack: RulePack) -> Edit:
    """Format and validity of an identity number; repeats are found by ``keys.decide_flags``."""
    long_enough = F.length(digits) == domain.ID_LENGTH
    invalid = present & (
        ~long_enough | numbers.is_fake_id(digits, pack.fake_ids) | numbers.is_repeated_digit(digits)
    )
    return Edit(
        F.when(present & long_enough, digits).otherwise(v), "CNIC_FORMAT",
        invalid | ~present if rule.non_null else invalid,
    )


def id_edit(v: Column, present: Column, rule: ColumnRule) -> Edit:
    bad = present & ~numbers.is_unsigned_number(text.strip_ws(v))
    return Edit(review=bad | ~present if rule.non_null else bad)


def phone_edit(v: Column, digits: Column, present: Column) -> Edit:
    valid = present & (F.length(digits) == domain.PHONE_LENGTH) & digits.startswith(domain.PHONE_START)
    return Edit(
        F.when(valid, F.concat(F.lit("0"), digits)).otherwise(v), "CELL_NO_NORMALIZED", present & ~valid
    )


def numeric_edit(v: Column, present: Column) -> Edit:
    return Edit(review=present & ~numbers.is_number(text.strip_ws(v)))


def coord_edit(v: Column, present: Column, rule: ColumnRule) -> Edit:
    plain = numbers.is_number(text.strip_ws(v))
    outside = numbers.out_of_bounds(v, rule.bounds or domain.LAT_BOUNDS)
    return Edit(review=present & (~plain | outside))


def check_values(t: TrackedFrame, rules, pack: RulePack = RulePack(), *, stripped=True) -> TrackedFrame:
    """The one-projection kinds: yes/no, gender, identity numbers, ids, phones, numbers, coordinates."""
    helpers = {f"key{t.slot(r.name)}": prepared(r, t.value(r.name)) for r in rules}
    helpers = {k: c for k, c in helpers.items() if c is not None}
    if helpers:
        t = t.with_df(t.df.withColumns(helpers))
    edits = {}
    for rule in rules:
        v, key = t.value(rule.name), F.col(f"key{t.slot(rule.name)}")
        # false rather than null for null cells, so that review flags stay two-valued
        present = F.coalesce(~text.null_like(v, pack.null_tokens, stripped=stripped), F.lit(False))
        if rule.kind == "bool":
            edit = bool_edit(v, key, present, pack)
        elif rule.kind == "gender":
            edit = gender_edit(v, key, present, pack)
        elif rule.kind == "cnic":
            edit = cnic_edit(v, key, present, rule, pack)
        elif rule.kind == "cell_no":
            edit = phone_edit(v, key, present)
        elif rule.kind == "float":
            edit = coord_edit(v, present, rule)
        elif rule.is_id:
            edit = id_edit(v, present, rule)
        else:
            edit = numeric_edit(v, present)
        edits[rule.name] = Edit(edit.value, edit.step, F.coalesce(edit.review, F.lit(False)))
    t = t.update(edits)
    return t.with_df(t.df.drop(*helpers))


def apply_rules(t: TrackedFrame, pack: RulePack) -> TrackedFrame:
    """All row-local rule steps for the rule columns that exist: checks, special characters, casing."""
    rules = pack.present(t.names)
    words = [r for r in rules if r.kind in ("string", "geo")]
    t = check_values(t, [r for r in rules if r.kind in SIMPLE_KINDS], pack)
    return apply_casing(strip_special_chars(t, words, pack), words, pack)
