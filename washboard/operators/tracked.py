"""A table whose cells remember what happened to them.

Every data column becomes five flat columns: original text, current value, a bit mask of applied steps,
the review value and the review flag. The flag is separate because a review value may be null. Flat
columns of primitive types keep the row-local stages in generated code, let a scan prune the columns a
job does not use, and survive a shuffle cheaply. Maps and JSON are built in the last projection only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Step labels, in the order steps can be applied to one cell; the position is the bit.
STEPS = (
    "TRIM", "NULL_STANDARDIZED", "CNIC_FORMAT", "CELL_NO_NORMALIZED", "BOOL_STANDARDIZED", "GENDER_STANDARDIZED",
    "SPECIAL_CHARS_CLEANED", "UPPER_CASED", "TITLE_CASED", "GEO_STANDARDIZED", "CATEGORY_STANDARDIZED",
    "DATE_STANDARDIZED", "BANK_STANDARDIZED",
)
STEP_SEPARATOR = " | "
ROW_COLUMN = "row_idx"
RECORD_COLUMN = "_record"
DUPLICATE_ROW = "Duplicate row"


@dataclass(frozen=True)
class Edit:
    """One step's work on one column.

    ``value`` is the new value (null-safe different from the old one means changed, recorded as ``step``);
    ``review`` says which rows are flagged, with the value the cell had before the step."""

    value: Column | None = None
    step: str | None = None
    review: Column | None = None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def step_text(mask: Column) -> Column:
    """Step labels of a mask, in order, joined by the separator."""
    return F.concat_ws(STEP_SEPARATOR, *[F.when(_has(mask, bit), F.lit(s)) for bit, s in enumerate(STEPS)])


def step_array(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_has(mask, bit), F.lit(s)) for bit, s in enumerate(STEPS)]))


def _has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def json_text(value: Column) -> Column:
    """A text as a JSON value. Only texts with characters that are escaped go through the JSON writer."""
    escaped = F.btrim(F.to_json(F.array(value)), F.lit("[]"))  # quotes are what lies at the brackets
    return F.when(value.isNull(), "null").when(value.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


class TrackedFrame:
    """A lazy DataFrame plus the names of its data columns. Methods return new frames."""

    def __init__(self, df: DataFrame, names: tuple[str, ...], row: str = ROW_COLUMN):
        self.df, self.names, self.row = df, tuple(names), row
        self._position = {n: i for i, n in enumerate(self.names)}

    @classmethod
    def begin(cls, df: DataFrame, row: str = ROW_COLUMN, columns=None) -> "TrackedFrame":
        """Start tracking. ``row`` is the row-order column; other columns are data, read as text."""
        if row not in df.columns:
            raise ValueError(f"no row order column {row!r}; add one with sources.row_index")
        names = tuple(columns or [c for c in df.columns if c != row])
        out = [F.col(quoted(row)).cast("bigint").alias(ROW_COLUMN)]
        for i, name in enumerate(names):
            source = F.col(quoted(name)).cast("string")
            out += [
                source.alias(f"o{i}"), source.alias(f"v{i}"), F.lit(0).alias(f"m{i}"),
                F.lit(None).cast("string").alias(f"r{i}"), F.lit(False).alias(f"f{i}"),
            ]
        return cls(df.select(*out), names)

    def _part(self, letter: str, name: str) -> Column:
        return F.col(f"{letter}{self._position[name]}")

    def value(self, name: str) -> Column:
        return self._part("v", name)

    def original(self, name: str) -> Column:
        return self._part("o", name)

    def mask(self, name: str) -> Column:
        return self._part("m", name)

    def review_value(self, name: str) -> Column:
        return self._part("r", name)

    def flagged(self, name: str) -> Column:
        return self._part("f", name)

    def slot(self, name: str) -> int:
        return self._position[name]

    def with_df(self, df: DataFrame) -> "TrackedFrame":
        return TrackedFrame(df, self.names, self.row)

    def update(self, edits: dict[str, Edit]) -> "TrackedFrame":
        """Apply one step to many columns in one projection."""
        new: dict[str, Column] = {}
        for name, edit in edits.items():
            i, old = self._position[name], self.value(name)
            if edit.value is not None:
                new[f"v{i}"] = edit.value
                new[f"m{i}"] = F.when(
                    ~edit.value.eqNullSafe(old), self.mask(name).bitwiseOR(F.lit(1 << STEPS.index(edit.step)))
                ).otherwise(self.mask(name))
            if edit.review is not None:
                new[f"r{i}"] = F.when(edit.review, old).otherwise(self.review_value(name))
                new[f"f{i}"] = self.flagged(name) | edit.review
        return self.with_df(self.df.withColumns(new)) if new else self

    # ---- outputs -------------------------------------------------------------------------------

    def cleaned(self) -> DataFrame:
        """Row index and the current values under their public names."""
        return self.df.select(ROW_COLUMN, *[self.value(n).alias(n) for n in self.names])

    def cells(self) -> DataFrame:
        """One row per touched cell: row_idx, column, original, value, steps, flagged, review_value."""
        entries = [
            F.when(
                (self.mask(n) != 0) | self.flagged(n),
                F.struct(
                    F.lit(n).alias("column"), self.original(n).alias("original"), self.value(n).alias("value"),
                    step_text(self.mask(n)).alias("steps"), self.flagged(n).alias("flagged"),
                    self.review_value(n).alias("review_value"),
                ),
            )
            for n in self.names
        ]
        exploded = self.df.select(ROW_COLUMN, F.explode(F.array(*entries)).alias("cell")).where("cell is not null")
        return exploded.select(ROW_COLUMN, "cell.*")

    def changes(self) -> Column:
        """Map column -> [new value, step text] of the changed cells."""
        return self._touched_map(
            lambda n: self.mask(n) != 0, lambda n: F.array(self.value(n), step_text(self.mask(n))),
            value_type="array<string>",
        )

    def reviews(self, duplicate_row: Column | None = None) -> Column:
        """Map column -> review value of the flagged cells."""
        extra = []
        if duplicate_row is not None:
            extra = [(duplicate_row, F.struct(F.lit(RECORD_COLUMN).alias("key"), F.lit(DUPLICATE_ROW).alias("value")))]
        return self._touched_map(self.flagged, self.review_value, extra)

    def touched_originals(self) -> Column:
        """Map column -> original value of the changed or flagged cells."""
        return self._touched_map(lambda n: (self.mask(n) != 0) | self.flagged(n), self.original)

    def touched_columns(self) -> Column:
        """Names of the changed or flagged columns."""
        return F.array_union(F.map_keys(self.changes()), F.map_keys(self.reviews()))

    def changes_json(self) -> Column:
        """``changes`` as JSON text."""
        return self._touched_json(lambda n: self.mask(n) != 0, lambda n: F.concat(
            F.lit("["), json_text(self.value(n)), F.lit(',"'), step_text(self.mask(n)), F.lit('"]')))

    def reviews_json(self, duplicate_row: Column | None = None) -> Column:
        """``reviews`` as JSON text."""
        extra = [] if duplicate_row is None else [(duplicate_row, RECORD_COLUMN, json_text(F.lit(DUPLICATE_ROW)))]
        return self._touched_json(self.flagged, lambda n: json_text(self.review_value(n)), extra)

    def originals_json(self) -> Column:
        """``touched_originals`` as JSON text."""
        return self._touched_json(lambda n: (self.mask(n) != 0) | self.flagged(n), lambda n: json_text(self.original(n)))

    def _touched_json(self, touched, value, extra=()) -> Column:
        # texts put together in generated code, where a map would be built entry by entry and then written
        entries = [*((touched(n), n, value(n)) for n in self.names), *extra]
        parts = [F.when(condition, F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), v)) for condition, n, v in entries]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    def _touched_map(self, touched, value, extra=(), value_type="string") -> Column:
        # flattening lists of no or one entry stays in generated code, filtering entries would not
        entries = [(touched(n), F.struct(F.lit(n).alias("key"), value(n).alias("value"))) for n in self.names]
        none = F.array().cast(f"array<struct<key:string,value:{value_type}>>")
        lists = [F.when(condition, F.array(entry)).otherwise(none) for condition, entry in [*entries, *extra]]
        return F.map_from_entries(F.flatten(F.array(*lists)))
