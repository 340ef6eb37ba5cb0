"""Dense row numbers, made once and then stored.

Local positions are written together with the rows, so the numbers never depend on a recomputed
partitioning. Turning local positions into global ones needs one running sum over the blocks (file
splits or sort ranges), not over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washboard.operators.lookup import BROADCAST_ROWS
from washboard.operators.tracked import ROW_COLUMN
from washboard.session import stage

BLOCK = ["_file", "_block"]


def file_position() -> list[Column]:
    """Columns saying where a scanned row lies; select them directly on a file read."""
    return [
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
    ]


def in_file_order(df: DataFrame, row: str = ROW_COLUMN) -> DataFrame:
    """Number the rows 0, 1, 2, ... by file path and position in the file.

    ``df`` is a file read, or one that already carries the columns of ``file_position``, and maybe ``_local``, places in a
    block that ascend without gaps."""
    if "_file" not in df.columns:
        df = df.select("*", *file_position())
    return _number(df, row)


def by_order(df: DataFrame, *order, row: str = ROW_COLUMN) -> DataFrame:
    """Number the rows 0, 1, 2, ... in sort order. The order should be total: ties keep no fixed order,
    and it is the extra columns that spread rows with an equal first column over several ranges."""
    ordered = df.orderBy(*order).withColumns({"_file": F.lit(""), "_block": F.spark_partition_id().cast("bigint")})
    return _number(ordered, row)


def _number(df: DataFrame, row: str) -> DataFrame:
    placed = stage(df if "_local" in df.columns else df.withColumn("_local", F.monotonically_increasing_id()), "rows")
    blocks = placed.groupBy(*BLOCK).agg(F.count("*").alias("rows"), F.min("_local").alias("first"))
    before = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file split or sort range, so this window is over a short table
    offsets = blocks.select(
        *BLOCK, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_offset")
    )
    offsets = stage(offsets, "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    numbered = placed.join(offsets, BLOCK).withColumn(row, F.col("_offset") + F.col("_local"))
    return numbered.drop(*BLOCK, "_local", "_offset")
