"""Bank names: alias lookup in three spellings, then similarity, over distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard.functions import text
from washboard.functions.similarity import best_choice_udf
from washboard.operators.lookup import ValueMap, attach_values, decide_values, distinct_cells, drop_values
from washboard.operators.tracked import Edit, TrackedFrame
from washboard.rules import RulePack, normal_name


def bank_columns(names, pack: RulePack) -> list[str]:
    return [n for n in names if any(h in normal_name(n) for h in pack.bank_hints)]


def alias_maps(pack: RulePack) -> tuple[dict[str, str], dict[str, str]]:
    """Alias -> official name by lower-case text, and by the text reduced to letters, digits and spaces."""
    plain: dict[str, str] = {}
    for official, aliases in pack.banks.items():
        for spelling in (official, *aliases):
            plain[spelling.lower()] = official
    reduced = {" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in k).split()): v for k, v in plain.items()}
    return plain, reduced


def alias_bank(v: Column, pack: RulePack) -> Column:
    """Official name by alias; null when no spelling matches."""
    plain, reduced = alias_maps(pack)
    key = text.alnum_key(v)
    return F.coalesce(
        text.literal_lookup(plain, F.lower(text.strip_ws(v))),
        text.literal_lookup(reduced, key),
        text.literal_lookup(reduced, text.drop_corp_words(key)),
    )


def _scorer(pack: RulePack):
    return best_choice_udf({0: tuple(pack.banks)}, pack.auto_score)


def score_banks(t: TrackedFrame, pack: RulePack) -> DataFrame:
    """Official name of each distinct value that has one: slot, value, choice, score (alias counts as 100)."""
    columns = bank_columns(t.names, pack)
    values = distinct_cells(t, {n: t.value(n).isNotNull() for n in columns})
    values = values.withColumn("alias", alias_bank(F.col("value"), pack))
    open_key = F.when(F.col("alias").isNull(), text.alnum_key("value"))
    scored = values.withColumn("best", _scorer(pack)(F.lit(0), open_key))
    return scored.select(
        "slot", "value", F.coalesce("alias", "best.choice").alias("choice"),
        F.when(F.col("alias").isNotNull(), 100).otherwise(F.col("best.score")).cast("int").alias("score"),
    ).where("choice is not null")


def decide_banks(t: TrackedFrame, pack: RulePack) -> ValueMap:
    if not pack.banks or not bank_columns(t.names, pack):
        return ValueMap()
    return decide_values(score_banks(t, pack), "banks")


def standardize_banks(t: TrackedFrame, pack: RulePack, decided: ValueMap) -> TrackedFrame:
    columns = bank_columns(t.names, pack) if pack.banks else []
    if not columns:
        return t
    t = attach_values(t, decided, columns)
    edits = {
        n: Edit(F.coalesce(F.col(f"choice{t.slot(n)}"), t.value(n)), "BANK_STANDARDIZED") for n in columns
    }
    return drop_values(t.update(edits), columns)
