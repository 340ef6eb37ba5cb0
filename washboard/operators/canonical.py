"""Mapping category and place names to their labels, exactly or by similarity.

Exact matches (ignoring case) are resolved by an expression in the row. Of everything else only the
distinct values are scored, once each, and the resulting map is joined back, by broadcast where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard.functions import text
from washboard.functions.similarity import best_choice_udf
from washboard.operators.lookup import ValueMap, attach_values, decide_values, distinct_cells, drop_values
from washboard.operators.tracked import Edit, TrackedFrame
from washboard.rules import RulePack


def labelled(t: TrackedFrame, pack: RulePack) -> dict[str, tuple]:
    """Column -> (rule, labels) for the rule columns that have labels."""
    found = {}
    for rule in pack.present(t.names):
        labels = pack.labels_for(rule) if rule.kind in ("string", "geo") else ()
        if labels:
            found[rule.name] = (rule, labels)
    return found


def exact_label(v: Column, labels) -> Column:
    return text.literal_lookup({label.lower(): label for label in labels}, F.lower(v))


def _open_values(t: TrackedFrame, pack: RulePack, columns) -> dict[str, Column]:
    return {
        n: ~text.null_like(t.value(n), pack.null_tokens, stripped=True) & exact_label(t.value(n), labels).isNull()
        for n, (_, labels) in columns.items()
    }


def _scorer(t: TrackedFrame, pack: RulePack, columns, at_least: float):
    by_slot = {t.slot(n): tuple({x.lower(): x for x in labels}.values()) for n, (_, labels) in columns.items()}
    return best_choice_udf(by_slot, at_least, fold_case=not pack.case_sensitive)


def score_labels(t: TrackedFrame, pack: RulePack, at_least: float | None = None) -> DataFrame:
    """Best label of each distinct value without an exact match: slot, value, choice, score."""
    columns = labelled(t, pack)
    at_least = pack.review_score if at_least is None else at_least
    udf = _scorer(t, pack, columns, at_least)
    scored = distinct_cells(t, _open_values(t, pack, columns)).withColumn("best", udf("slot", F.lower("value")))
    return scored.where("best.choice is not null").select("slot", "value", "best.choice", "best.score")


def decide_labels(t: TrackedFrame, pack: RulePack) -> ValueMap:
    return decide_values(score_labels(t, pack), "labels") if labelled(t, pack) else ValueMap()


def canonicalize(t: TrackedFrame, pack: RulePack, decided: ValueMap) -> TrackedFrame:
    """Replace by the label from ``auto_score`` up; flag from ``review_score`` up; leave the rest."""
    columns = labelled(t, pack)
    if not columns:
        return t
    opened = _open_values(t, pack, columns)
    t = attach_values(t, decided, columns)
    edits = {}
    for n, (rule, labels) in columns.items():
        v, slot = t.value(n), t.slot(n)
        score = F.when(opened[n], F.col(f"score{slot}"))
        auto = F.coalesce(score >= pack.auto_score, F.lit(False))
        near = F.coalesce((score >= pack.review_score) & (score < pack.auto_score), F.lit(False))
        edits[n] = Edit(
            F.when(auto, F.col(f"choice{slot}")).otherwise(F.coalesce(exact_label(v, labels), v)),
            "GEO_STANDARDIZED" if rule.kind == "geo" else "CATEGORY_STANDARDIZED",
            near,
        )
    return drop_values(t.update(edits), columns)
