"""Joins against small tables whose size is checked, with an exact other way when they are not small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard.operators.tracked import ROW_COLUMN, TrackedFrame
from washboard.session import stage

# A table is only broadcast when a count over the written table shows it is within these limits.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000
# So many times as many rows of a few numbers and booleans, of about 40 bytes in memory, are as good as that.
NARROW = 10
# Keys longer than this are replaced by a digest, which bounds the bytes of a table of keys.
KEY_CHARS = 64


def bounded_key(c: Column) -> Column:
    """A text of at most 65 characters that is equal for equal texts and different for different ones."""
    return F.when(F.length(c) <= KEY_CHARS, F.concat(F.lit("="), c)).otherwise(F.concat(F.lit("#"), F.sha2(c, 256)))


def members_of(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (a written table, one row per key, keys bounded in length).

    When all groups fit the limit they are broadcast. Otherwise those that hold at least 1/limit of all rows in
    groups are broadcast, so their rows never move, and only rows of the lighter groups are shuffled by key."""
    sizes = groups.agg(F.count("*").alias("groups"), F.sum(weight).alias("rows")).first()
    if sizes["groups"] <= limit:
        return rows.join(F.broadcast(groups), on)
    # at most ``limit`` groups can have that share of the rows, so a plain filter finds them
    hot = stage(groups.where(F.col(weight) * limit >= sizes["rows"]), "hot-groups")
    hot_keys = F.broadcast(hot.select(*on))
    light = rows.join(hot_keys, on, "left_anti").join(groups.join(hot_keys, on, "left_anti"), on)
    return rows.join(F.broadcast(hot), on).unionByName(light)


def left_by_row(rows: DataFrame, flags: DataFrame, row: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on the unique row index; ``flags`` is a written table with few or many rows.

    Few flagged rows are broadcast and ``rows`` do not move. Many are joined by a shuffle on the row
    index, which is unique and therefore even."""
    return rows.join(F.broadcast(flags) if flags.count() <= limit else flags, row, "left")


@dataclass(frozen=True)
class ValueMap:
    """Decided replacements: a written table (slot, value, choice, score), and the slots whose part of it is small enough to
    broadcast."""

    table: DataFrame | None = None
    small: frozenset = frozenset()


def distinct_cells(t: TrackedFrame, wanted: dict[str, Column]) -> DataFrame:
    """Distinct (slot, value) over the columns of ``wanted``, for rows where the condition holds."""
    cells = [
        F.when(condition, F.struct(F.lit(t.slot(n)).alias("slot"), t.value(n).alias("value")))
        for n, condition in wanted.items()
    ]
    long = t.df.select(F.explode(F.array(*cells)).alias("cell")).where("cell is not null")
    return long.select("cell.slot", "cell.value").distinct()


def decide_values(scored: DataFrame, label: str) -> ValueMap:
    """Write the (slot, value, choice, score) table and find the slots that can be broadcast."""
    table = stage(scored, label)
    # one row per slot, i.e. per column
    sizes = table.groupBy("slot").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).collect()
    small, rows, chars = set(), 0, 0
    for size in sorted(sizes, key=lambda s: (s["n"], s["slot"])):
        rows, chars = rows + size["n"], chars + size["chars"]
        if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
            small.add(size["slot"])
    return ValueMap(table, frozenset(small))


def attach_values(t: TrackedFrame, decided: ValueMap, names) -> TrackedFrame:
    """Add ``choice<slot>`` and ``score<slot>`` for every column of ``names``; null where nothing fits.

    Every value was scored once, when the map was made. A part of it that is too large to broadcast is joined by a
    shuffle on the value, with null values spread by row; frequent values are left to Spark's skew join."""
    df = t.df
    for name in names:
        slot = t.slot(name)
        if decided.table is None:
            df = df.withColumns({f"choice{slot}": F.lit(None).cast("string"), f"score{slot}": F.lit(None).cast("int")})
            continue
        part = decided.table.where(F.col("slot") == slot).select(
            F.col("value").alias(f"key{slot}"), F.col("choice").alias(f"choice{slot}"), F.col("score").alias(f"score{slot}"),
        )
        if slot in decided.small:
            df = df.join(F.broadcast(part), t.value(name) == F.col(f"key{slot}"), "left").drop(f"key{slot}")
        else:
            spread = F.when(t.value(name).isNull(), F.pmod(F.hash(ROW_COLUMN), F.lit(1000)))
            same = F.coalesce(F.concat(F.lit("="), t.value(name)), F.concat(F.lit("#"), spread.cast("string")))
            df = df.join(part, same == F.concat(F.lit("="), F.col(f"key{slot}")), "left").drop(f"key{slot}")
    return t.with_df(df)


def drop_values(t: TrackedFrame, names) -> TrackedFrame:
    return t.with_df(t.df.drop(*[f"{p}{t.slot(n)}" for n in names for p in ("choice", "score")]))
