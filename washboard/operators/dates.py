"""Finding date columns by their content and writing them in one format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions import dates, text
from washboard.operators.tracked import ROW_COLUMN, Edit, TrackedFrame
from washboard.rules import RulePack, normal_name

# Rows read in the first attempt at the sample, and the factor for the next one.
FIRST_STRETCH = 50_000
STRETCH_FACTOR = 50


def date_candidates(names, pack: RulePack) -> list[str]:
    return [n for n in names if not any(h in normal_name(n) for h in pack.date_skip_hints)]


def head_per_column(t: TrackedFrame, pack: RulePack, names, below: int | None = None) -> DataFrame:
    """First ``date_sample`` non-null values of each column in row order: slot, row_idx, value, rank.

    ``below`` limits the rows read. Each task keeps only its own first values before the shuffle, which is
    what bounds the few partitions behind it; Spark does so up to a threshold that ``build_session`` sets."""
    df = t.df if below is None else t.df.where(F.col(ROW_COLUMN) < below)
    cells = [
        F.when(
            ~text.null_like(t.value(n), pack.null_tokens, stripped=True),
            F.struct(F.lit(t.slot(n)).alias("slot"), F.trim(t.value(n)).alias("value")),
        )
        for n in names
    ]
    long = df.select(ROW_COLUMN, F.explode(F.array(*cells)).alias("cell")).where("cell is not null")
    order = Window.partitionBy("slot").orderBy(ROW_COLUMN)
    return (
        long.select("cell.slot", ROW_COLUMN, "cell.value")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= pack.date_sample)
    )


def rates_of(sample: DataFrame, pack: RulePack) -> DataFrame:
    """Per slot: sample size and the shares of lone times, date shapes and parsed dates."""
    parsed = dates.parse_core("core", pack.reference_year)
    return (
        sample.withColumn("core", dates.date_core("value"))
        .groupBy("slot")
        .agg(
            F.count("*").alias("n"),
            F.avg(dates.is_time_only("value").cast("double")).alias("time_rate"),
            F.avg(dates.has_date_signal("value").cast("double")).alias("signal_rate"),
            F.avg(parsed.isNotNull().cast("double")).alias("parse_rate"),
        )
    )


def sampled_rates(t: TrackedFrame, pack: RulePack, source: DataFrame | None = None) -> list[dict]:
    """Rates of every candidate column, one dict each. ``source`` is any table with all row indexes; the one
    at the start of the plan is the cheapest to read them from.

    The sample needs the first rows only, so a short stretch of row indexes is read first (a pushed-down
    filter) and a longer one just for columns that did not fill their sample in it."""
    open_names = {t.slot(n): n for n in date_candidates(t.names, pack)}
    index = t.df if source is None else source
    span = index.agg(F.min(ROW_COLUMN).alias("low"), F.max(ROW_COLUMN).alias("high")).first() if open_names else None
    results, stretch = [], FIRST_STRETCH
    while open_names and span["low"] is not None:
        whole = span["low"] + stretch > span["high"]
        sample = head_per_column(t, pack, open_names.values(), None if whole else span["low"] + stretch)
        for rate in rates_of(sample, pack).collect():
            if whole or rate["n"] >= pack.date_sample:
                results.append({**rate.asDict(), "column": open_names.pop(rate["slot"])})
        if whole:
            break
        stretch *= STRETCH_FACTOR
    return results


def is_date_column(name_hint, time_rate, signal_rate, parse_rate):
    """Acceptance rule; works on Python values and on Columns alike."""
    times = (time_rate >= 0.80) & (signal_rate < 0.20)
    by_content = (signal_rate >= 0.60) & (parse_rate >= 0.70)
    by_name = name_hint & (signal_rate >= 0.25) & (parse_rate >= 0.60)
    return (~times if isinstance(times, Column) else not times) & (by_content | by_name)


def has_date_name(name: str, pack: RulePack) -> bool:
    name = normal_name(name)
    return any(h in name for h in pack.date_name_hints) or name.endswith(domain.DATE_NAME_SUFFIX)


def decide_dates(t: TrackedFrame, pack: RulePack, source: DataFrame | None = None) -> list[str]:
    """Names of the columns to standardise."""
    return [
        r["column"] for r in sampled_rates(t, pack, source)
        if is_date_column(has_date_name(r["column"], pack), r["time_rate"], r["signal_rate"], r["parse_rate"])
    ]


def standardize_dates(t: TrackedFrame, names, pack: RulePack) -> TrackedFrame:
    """Write the dates of the given columns as MM/dd/yyyy; flag other non-null texts."""
    names = list(names)
    if not names:
        return t
    # reduced text and parsed date get their own projections, since later expressions use them repeatedly
    cores = {f"core{t.slot(n)}": dates.date_core(t.value(n)) for n in names}
    parsed = {f"day{t.slot(n)}": dates.parse_core(f"core{t.slot(n)}", pack.reference_year) for n in names}
    t = t.with_df(t.df.withColumns(cores).withColumns(parsed).drop(*cores))
    edits = {}
    for n in names:
        day = F.col(f"day{t.slot(n)}")
        empty = text.null_like(t.value(n), pack.null_tokens, stripped=True)
        edits[n] = Edit(
            F.coalesce(dates.format_mdy(day), t.value(n)), "DATE_STANDARDIZED", ~empty & day.isNull()
        )
    t = t.update(edits)
    return t.with_df(t.df.drop(*parsed))
