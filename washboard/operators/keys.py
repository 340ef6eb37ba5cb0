"""Repeated keys, repeated rows and record keys, without a window over a key.

Counting is a two-sided aggregate (combined in each task before the shuffle), so a key that holds a third
of all rows costs no more than any other. Which rows belong to repeated keys is found by a join on the
repeated keys only, see ``lookup.members_of``. All of it runs on a narrow table of keys.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions import numbers, text
from washboard.operators import lookup
from washboard.operators.lookup import BROADCAST_ROWS, bounded_key, left_by_row, members_of
from washboard.operators.tracked import ROW_COLUMN, TrackedFrame
from washboard.rules import RulePack
from washboard.session import counted, counts_of, stage, stage_counted

RECORD_KEY = "record_key"
ROW_DIGEST = "row_digest"


def repeated_keys(keys: DataFrame, on: list[str], row: str = ROW_COLUMN) -> DataFrame:
    """Groups of two or more rows: key columns, row count ``n``, first row ``first_row``. Null keys are left out."""
    present = keys
    for k in on:
        present = present.where(F.col(k).isNotNull())
    return (
        present.groupBy(*on).agg(F.count("*").alias("n"), F.min(row).alias("first_row")).where(F.col("n") > 1)
    )


def rows_with_repeated_key(rows: DataFrame, on: list[str], row: str = ROW_COLUMN, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every member of a repeated group: the columns of ``rows`` plus ``n`` and ``first_row``."""
    return members_of(rows, stage(repeated_keys(rows, on, row), "repeats"), on, "n", limit)


def row_digest(values: list[Column]) -> Column:
    """SHA-256 over all values; nulls equal each other and differ from every text."""
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def base_key(original: Column, row: Column, tokens=domain.NULL_TOKENS) -> Column:
    """Key text of a record before repeats are told apart; ``ROW_<n>`` (row 1 is the header) where it is null."""
    return F.when(text.null_like(original, tokens), row_label(row)).otherwise(text.strip_ws(original))


def row_label(row: Column) -> Column:
    return F.concat(F.lit("ROW_"), (row + F.lit(2)).cast("string"))


def record_key(base: Column, row: Column, is_first: Column) -> Column:
    return F.when(is_first, base).otherwise(
        F.concat(base, F.lit("__duplicate_row_"), (row + F.lit(2)).cast("string"))
    )


def unique_columns(names, pack: RulePack) -> tuple[list[str], list[str]]:
    """Names of the unique id columns and of the unique identity-number columns, in rule order."""
    present = pack.present(names)
    return (
        [r.name for r in present if r.is_id and r.unique],
        [r.name for r in present if r.kind == "cnic" and r.unique],
    )


def record_key_column(names, pack: RulePack, key_column: str | None = None) -> str | None:
    """The column that names a record: the requested one if it exists, else the last unique id column."""
    ids, _ = unique_columns(names, pack)
    return key_column if key_column in names else (ids[-1] if ids else None)


def add_keys(t: TrackedFrame, pack: RulePack, key_column: str | None = None) -> TrackedFrame:
    """Carry the key texts along; call it after null tokens are gone and before values change further."""
    ids, cnics = unique_columns(t.names, pack)
    source = record_key_column(t.names, pack, key_column)
    row = F.col(ROW_COLUMN)
    new = {"base_key": base_key(t.original(source), row, pack.null_tokens) if source else row_label(row)}
    for n in ids:
        new[f"id_key{t.slot(n)}"] = text.strip_ws(t.value(n))
        new[f"id_text{t.slot(n)}"] = t.value(n)
    for n in cnics:
        new[f"id_text{t.slot(n)}"] = t.value(n)
        digits = numbers.id_digits(t.value(n))
        new[f"id_key{t.slot(n)}"] = F.when(F.length(digits) == domain.ID_LENGTH, digits)
    return t.with_df(t.df.withColumns(new))


def key_table(t: TrackedFrame, pack: RulePack, key_column: str | None = None) -> DataFrame:
    """Narrow long table (row_idx, kind, known, reviewed, key) of all keys that are compared. ``kind`` is a column slot,
    -1 for the record key and -2 for the whole cleaned row; ``known`` says that the key's cell is flagged already, ``reviewed``
    that some cell of the row is. Row labels are unique and stay out."""
    ids, cnics = unique_columns(t.names, pack)
    parts = [(t.slot(n), F.col(f"id_key{t.slot(n)}"), t.flagged(n)) for n in ids + cnics]
    if record_key_column(t.names, pack, key_column):
        parts.append((-1, F.col("base_key"), F.lit(False)))

    def entry(kind: int, key: Column, known: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), known.alias("known"), key.alias("key"))

    entries = [F.when(c.isNotNull(), entry(kind, F.encode(bounded_key(c), "UTF-8"), known)) for kind, c, known in parts]
    entries.append(entry(-2, row_digest([t.value(n) for n in t.names]), F.lit(False)))
    reviewed = reduce(or_, [t.flagged(n) for n in t.names], F.lit(False))
    long = t.df.select(ROW_COLUMN, reviewed.alias("reviewed"), F.explode(F.array(*entries)).alias("entry")).where("entry is not null")
    return long.select(ROW_COLUMN, "entry.kind", "entry.known", "reviewed", "entry.key")


def repeat_counts(t: TrackedFrame, pack: RulePack) -> dict[str, Column]:
    """Aggregates of the table of flagged rows: what the repeats add to the counts of the rows themselves."""
    ids, cnics = unique_columns(t.names, pack)
    slots = [t.slot(n) for n in ids + cnics]
    any_repeat = reduce(or_, [F.col(f"repeat{s}") for s in slots], F.col("same_row"))
    return {
        "rows_added": F.count_if(any_repeat & ~F.col("reviewed")), "same_rows": F.count_if("same_row"),
        "repeated_ids": F.count_if(F.col(f"repeat{t.slot(ids[-1])}") if ids else F.lit(False)),
        **{f"added{s}": F.count_if(F.col(f"repeat{s}") & ~F.col(f"known{s}")) for s in slots},
    }


def decide_flags(
    t: TrackedFrame, pack: RulePack, key_column: str | None = None, counts: dict[str, Column] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """Written table of flagged rows only, and counts: row_idx, one boolean per unique column (``repeat<slot>``, and ``known<slot>``
    where the cell is flagged already), ``later_key`` for a record that repeats an earlier key, ``same_row`` for a repeated row,
    ``reviewed`` for a row with flagged cells.

    ``counts`` are aggregates of ``t``, observed while the keys are written; those of ``repeat_counts`` are observed
    with the flags."""
    ids, cnics = unique_columns(t.names, pack)
    rows, seen = counted(t.df, counts or {})
    keys = stage(key_table(t.with_df(rows), pack, key_column), "keys")
    members = rows_with_repeated_key(keys, ["kind", "key"])
    kind = F.col("kind")
    flags = [F.bool_or(kind == t.slot(n)).alias(f"repeat{t.slot(n)}") for n in ids + cnics]
    flags += [F.bool_or((kind == t.slot(n)) & F.col("known")).alias(f"known{t.slot(n)}") for n in ids + cnics]
    flagged = members.groupBy(ROW_COLUMN).agg(
        *flags,
        F.bool_or((kind == -1) & (F.col(ROW_COLUMN) != F.col("first_row"))).alias("later_key"),
        F.bool_or(kind == -2).alias("same_row"), F.bool_or("reviewed").alias("reviewed"),
    )
    written, added = stage_counted(flagged, "flags", repeat_counts(t, pack))
    return written, counts_of(seen, counts or {}) | added


def apply_flags(t: TrackedFrame, pack: RulePack, flags: DataFrame) -> TrackedFrame:
    """Join the flags to the rows, flag the repeated ids for review and add the record columns.

    Comes after all other steps: a repeated cell that is flagged already keeps its review value, which is the
    same text or the one of a later step; any other gets the text it had before formatting."""
    ids, cnics = unique_columns(t.names, pack)
    slots = [t.slot(n) for n in ids + cnics]
    names = [f"repeat{s}" for s in slots] + ["later_key", "same_row"]
    df = left_by_row(t.df, flags.select(ROW_COLUMN, *names), ROW_COLUMN, lookup.NARROW * lookup.BROADCAST_ROWS).withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    is_dup = F.col(f"repeat{t.slot(ids[-1])}") if ids else F.lit(False)
    is_dup_cnic = F.lit(False)
    for n in cnics:
        is_dup_cnic = is_dup_cnic | F.col(f"repeat{t.slot(n)}")
    t = t.with_df(df.withColumns({
        RECORD_KEY: record_key(F.col("base_key"), F.col(ROW_COLUMN), ~F.col("later_key")),
        "is_dup": is_dup, "is_dup_cnic": is_dup_cnic, "duplicate_row": F.col("same_row"),
    }))
    reviews = {}
    for n, slot in zip(ids + cnics, slots):
        repeat, known = F.col(f"repeat{slot}"), t.flagged(n)
        reviews[f"r{slot}"] = F.when(repeat & ~known, F.col(f"id_text{slot}")).otherwise(t.review_value(n))
        reviews[f"f{slot}"] = known | repeat
    return t.with_df(t.df.withColumns(reviews))
