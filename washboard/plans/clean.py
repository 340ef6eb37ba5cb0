"""The whole cleaning run: every step in order, decisions taken from the data in between.

Questions are put to the data: which labels and banks the distinct values stand for and which columns hold dates, each a
job over the columns it concerns. Then the rows with their history are written once, which also tells the type of columns
without a rule: what does not fit it is flagged where the rows are read. Repeated keys are looked for on a narrow table of keys
read from there, and all counts of the run are taken on the way. All outputs read the written rows. Rows only move when many of them
are flagged as repeats; then once, by row index, and never for the cleaned table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washboard.operators import banks, canonical, cells, dates, keys, lookup, quality, summary
from washboard.operators.lookup import ValueMap
from washboard.operators.tracked import ROW_COLUMN, TrackedFrame
from washboard.rules import RulePack, default_pack
from washboard.session import stage, stage_counted


@dataclass
class Decisions:
    """What was read off the data. Reusable for another table of the same kind."""

    labels: ValueMap = field(default_factory=ValueMap)
    date_columns: list[str] = field(default_factory=list)
    banks: ValueMap = field(default_factory=ValueMap)
    types: dict[str, str] = field(default_factory=dict)


@dataclass
class CleanResult:
    """Lazy outputs of a cleaning run: ``rows`` are the written rows, ``tracked`` the same with the repeats flagged."""

    rows: TrackedFrame
    tracked: TrackedFrame
    decisions: Decisions
    pack: RulePack
    counts: dict[str, int]

    @property
    def cleaned(self) -> DataFrame:
        """Row index and cleaned columns; repeats change no value, so their flags are not joined."""
        return self.rows.cleaned()

    def records(self) -> DataFrame:
        """One audit record per input row, with map columns."""
        t = self.tracked
        return t.df.select(
            ROW_COLUMN, F.col(keys.RECORD_KEY).alias("uuid"), t.touched_originals().alias("original_values"),
            t.changes().alias("cleaned_values"), t.reviews(F.col("duplicate_row")).alias("manual_reviews"),
            "is_dup", "is_dup_cnic",
        )

    def report(self) -> DataFrame:
        """The records in stored form: maps as JSON text, no row index."""
        t = self.tracked
        return t.df.select(
            F.col(keys.RECORD_KEY).alias("uuid"), t.originals_json().alias("original_values"), t.changes_json().alias("cleaned_values"),
            t.reviews_json(F.col("duplicate_row")).alias("manual_reviews"), "is_dup", "is_dup_cnic",
        )

    def summary(self) -> DataFrame:
        return summary.clean_summary(self.rows.df.sparkSession, self.rows, self.pack, self.counts)

    def step_breakdown(self) -> DataFrame:
        return summary.step_breakdown(self.rows.df.sparkSession, self.counts)

    def review_by_column(self) -> DataFrame:
        return summary.review_by_column(self.rows.df.sparkSession, self.rows, self.pack, self.counts)


def first_steps(df: DataFrame, pack: RulePack, row: str = ROW_COLUMN, key_column: str | None = None) -> TrackedFrame:
    """Trim and null steps, with the key texts carried along."""
    t = cells.null_standardize(cells.trim_whitespace(TrackedFrame.begin(df, row)), pack)
    return keys.add_keys(t, pack, key_column)


def run_steps(t: TrackedFrame, pack: RulePack, known: Decisions | None = None) -> tuple[TrackedFrame, Decisions]:
    """The steps after the first ones that look at a row alone, deciding on the way. ``known`` decisions are used as they are."""
    d, source = known or Decisions(), t.df
    t = cells.apply_rules(t, pack)
    if not known:
        d.labels = canonical.decide_labels(t, pack)
    t = canonical.canonicalize(t, pack, d.labels)
    if not known:
        d.date_columns = dates.decide_dates(t, pack, source)
    t = dates.standardize_dates(t, d.date_columns, pack)
    if not known:
        d.banks = banks.decide_banks(t, pack)
    return banks.standardize_banks(t, pack, d.banks), d


def clean_dataset(
    df: DataFrame, pack: RulePack | None = None, row: str = ROW_COLUMN, key_column: str | None = None,
    known: Decisions | None = None,
) -> CleanResult:
    """Clean and audit a table of texts.

    ``row`` is a unique row-order column (``sources.row_index`` makes one). ``key_column`` names the
    record-key column; without it the last unique id column is used, and row labels where there is none.
    ``known`` takes over the decisions of an earlier run instead of asking the data."""
    pack = pack or default_pack()
    if row not in df.columns:
        raise ValueError(f"no row order column {row!r}; add one with sources.row_index")
    t, decisions = run_steps(first_steps(df, pack, row, key_column), pack, known)
    asked = {} if known else quality.number_counts(t, pack, quality.checked_columns(t.names, pack))
    rows, counts = stage_counted(t.df, "rows", asked)
    if not known:
        decisions.types = quality.types_of(t, pack, counts)
    t = quality.flag_type_mismatch(t.with_df(rows), decisions.types, pack)
    flags, counts = keys.decide_flags(t, pack, key_column, summary.row_counts(t))
    flagged = keys.apply_flags(t, pack, flags)
    if flags.count() > lookup.NARROW * lookup.BROADCAST_ROWS:
        # rows move for this join, so it is made once for all outputs
        flagged = flagged.with_df(stage(flagged.df, "flagged"))
    return CleanResult(t, flagged, decisions, pack, counts)
