"""Helpers the operators share: reading tables, passes over texts in Arrow batches, staged tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.session import TABLE, new_path, remember, stage

__all__ = ["documents", "table", "stage", "text_pass", "bucketed", "stage_briefly", "partitions_for", "text_bytes", "WORD", "size_of"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_pass(
    df: DataFrame, column: str, added: T.StructType, make: Callable[[list], Iterable[tuple]], rows: int = 256, keep_column: bool = False
) -> DataFrame:
    """``df`` with the columns ``added``, and without ``column`` unless ``keep_column``.

    ``make`` gets up to ``rows`` values of ``column`` (nulls included) and gives one tuple for each. One pass over
    Arrow batches, cut small so that few long texts are unpacked at once; no shuffle, rows keep their order."""
    keep = [f for f in df.schema.fields if keep_column or f.name != column]
    names = [f.name for f in added.fields]
    clash = {f.name for f in keep} & set(names)
    if clash:
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    schema = T.StructType([*keep, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = list(zip(*make(batch.column(column).to_pylist()), strict=True))
                old = [batch.column(f.name).cast(target.field(f.name).type) for f in keep]
                new = [pa.array(v, type=target.field(n).type) for n, v in zip(names, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=target)

    return df.mapInArrow(run, schema)


def bucketed(df: DataFrame, buckets: int, key: str, label: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key`` and read back, so that later groupings by ``key`` leave it
    in place."""
    name = f"washboard_{uuid.uuid4().hex}"
    path = remember(df.sparkSession, new_path(df.sparkSession, label))
    remember(df.sparkSession, TABLE + name)
    writer = df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def stage_briefly(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder and read back, and what deletes it once nothing reads it any more."""
    spark = df.sparkSession
    path = remember(spark, new_path(spark, label))
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), drop


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def size_of(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and text bytes of ``df``, by one aggregate."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text_bytes(F.col(text)).cast("bigint")), F.lit(0))).first()
    return int(n), int(b)


def partitions_for(spark: SparkSession, amount: float, per_partition: float) -> int:
    """Partitions so that each gets about ``per_partition``, and at least what the session uses for shuffles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / per_partition))
