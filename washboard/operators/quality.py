"""Numbers in text columns and text in number columns, for columns without a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard.functions import numbers, text
from washboard.operators.tracked import Edit, TrackedFrame
from washboard.rules import RulePack, normal_name
from washboard.session import stage_counted

MIN_VALUES = 10


def checked_columns(names, pack: RulePack) -> list[str]:
    ruled = {r.name for r in pack.rules}
    return [
        n for n in names if n not in ruled and not any(h in normal_name(n) for h in pack.type_skip_hints)
    ]


def _present(t: TrackedFrame, name: str, pack: RulePack) -> Column:
    return ~text.null_like(t.value(name), pack.null_tokens, stripped=True)


def number_counts(t: TrackedFrame, pack: RulePack, names) -> dict[str, Column]:
    """Aggregates per column: ``present<slot>`` non-null values and ``numeric<slot>`` numbers among them. They are observed
    while the rows are written, or aggregated by themselves."""
    counts = {}
    for n in names:
        present = _present(t, n, pack)
        counts[f"present{t.slot(n)}"] = F.count_if(present)
        counts[f"numeric{t.slot(n)}"] = F.count_if(present & numbers.is_number(F.trim(t.value(n))))
    return counts


def wanted_type(name: str, values: int, numeric: int, pack: RulePack) -> str | None:
    """What the offenders of a column are not: ``number``, ``text``, or None when nothing is flagged."""
    if values < MIN_VALUES:
        return None
    name, share = normal_name(name), numeric / values
    number_like = any(h in name for h in pack.number_hints) or share >= 0.85
    text_like = any(h in name for h in pack.text_hints) or (share <= 0.05 and not number_like)
    if number_like and share < 1.0:
        return "number" if (values - numeric) / values < 0.50 else None
    return "text" if text_like else None


def types_of(t: TrackedFrame, pack: RulePack, counts: dict[str, int]) -> dict[str, str]:
    """Column -> wanted type, from the values of ``number_counts``."""
    names = checked_columns(t.names, pack)
    wanted = {n: wanted_type(n, counts[f"present{t.slot(n)}"], counts[f"numeric{t.slot(n)}"], pack) for n in names}
    return {n: w for n, w in wanted.items() if w}


def decide_types(t: TrackedFrame, pack: RulePack) -> tuple[TrackedFrame, dict[str, str]]:
    """The rows, written, and their types, decided by counts taken while they were written."""
    rows, counts = stage_counted(t.df, "typed", number_counts(t, pack, checked_columns(t.names, pack)))
    return t.with_df(rows), types_of(t, pack, counts)


def flag_type_mismatch(t: TrackedFrame, wanted: dict[str, str], pack: RulePack) -> TrackedFrame:
    edits = {}
    for n, kind in wanted.items():
        numeric = numbers.is_number(F.trim(t.value(n)))
        edits[n] = Edit(review=_present(t, n, pack) & (~numeric if kind == "number" else numeric))
    return t.update({n: Edit(review=F.coalesce(e.review, F.lit(False))) for n, e in edits.items()})
