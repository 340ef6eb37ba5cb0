"""Counts over a cleaned table, without a pass of their own: they are observed while the rows' keys and the flags of repeated rows are
written, and put together here. A task's counts are combined as it ends; nothing is exploded or shuffled."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washboard.operators import keys
from washboard.operators.tracked import RECORD_COLUMN, STEPS, TrackedFrame
from washboard.rules import RulePack


def row_counts(t: TrackedFrame) -> dict[str, Column]:
    """Aggregates of the rows before repeats are flagged: rows, changed rows, rows with flags, cells per step, changed and flagged
    cells per column."""
    changed = [t.mask(n) != 0 for n in t.names]
    counts = {
        "rows": F.count(F.lit(1)), "rows_changed": F.count_if(reduce(or_, changed, F.lit(False))),
        "rows_flagged": F.count_if(reduce(or_, [t.flagged(n) for n in t.names], F.lit(False))),
        "cells_changed": F.sum(reduce(add, [c.cast("bigint") for c in changed], F.lit(0))),
    }
    for bit, _ in enumerate(STEPS):
        counts[f"step{bit}"] = F.sum(reduce(add, [F.getbit(t.mask(n), F.lit(bit)).cast("bigint") for n in t.names], F.lit(0)))
    return counts | {f"flagged{t.slot(n)}": F.count_if(t.flagged(n)) for n in t.names}


def flagged_cells(t: TrackedFrame, pack: RulePack, seen: dict[str, int]) -> dict[str, int]:
    """Flagged cells per column; repeated rows count under the record pseudo-column."""
    ids, cnics = keys.unique_columns(t.names, pack)
    cells = {n: seen[f"flagged{t.slot(n)}"] + (seen[f"added{t.slot(n)}"] if n in ids + cnics else 0) for n in t.names}
    return cells | {RECORD_COLUMN: seen["same_rows"]}


def clean_summary(spark: SparkSession, t: TrackedFrame, pack: RulePack, seen: dict[str, int]) -> DataFrame:
    """One row: rows, rows changed, rows to review, repeated ids, cells changed, cells flagged. A repeated row is one flagged cell."""
    row = (
        seen["rows"], seen["rows_changed"], seen["rows_flagged"] + seen["rows_added"], seen["repeated_ids"], seen["cells_changed"],
        sum(flagged_cells(t, pack, seen).values()),
    )
    names = ("total_rows", "rows_auto_cleaned", "rows_need_review", "duplicate_uuid_rows", "cells_auto_cleaned", "cells_flagged")
    return spark.createDataFrame([row], ", ".join(f"{n} bigint" for n in names))


def _largest_first(spark: SparkSession, counts: dict[str, int], key: str) -> DataFrame:
    """One row per count above zero, largest first, then by name."""
    rows = sorted(((name, n) for name, n in counts.items() if n), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, f"`{key}` string, cells bigint")


def step_breakdown(spark: SparkSession, seen: dict[str, int]) -> DataFrame:
    """Cells per step label, largest first."""
    return _largest_first(spark, {step: seen[f"step{bit}"] for bit, step in enumerate(STEPS)}, "step")


def review_by_column(spark: SparkSession, t: TrackedFrame, pack: RulePack, seen: dict[str, int]) -> DataFrame:
    """Flagged cells per column, largest first."""
    return _largest_first(spark, flagged_cells(t, pack, seen), "column")
