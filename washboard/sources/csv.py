"""Reading CSV as untyped text, the way the cleaning steps expect it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions.text import na_on_load
from washboard.session import stage
from washboard.sources.records import file_splits, read_lines, read_records
from washboard.sources.row_index import in_file_order

FALLBACK_CHARSET = "ISO-8859-1"
BOM = "\ufeff"
# Column with the text of records whose number of fields is not the header's, and a text that no field holds.
RECORD = "_unread_record"
MARK = "\x1aend\x1a"
END_OF_INPUT = "\uffff"


def file_charsets(spark: SparkSession, path) -> DataFrame:
    """One row per file: path, ``UTF-8`` when every line is valid UTF-8, else ISO-8859-1.

    That is where trying UTF-8 first and Latin-1 second ends up, since Latin-1 accepts any bytes. Line
    breaks are never part of a longer UTF-8 sequence, so lines can be checked in parallel, whatever the
    file size."""
    files = file_splits(spark, path, quotes=False).select("path", "latin").distinct()
    return files.select("path", F.when(F.col("latin"), FALLBACK_CHARSET).otherwise("UTF-8").alias("charset"))


def header_names(raw) -> list[str]:
    """Column names from a header row: repeats become ``a.1``, ``a.2``; blanks ``Unnamed: <position>``."""
    names: list[str] = []
    wanted = [(n or f"Unnamed: {i}").removeprefix(BOM) for i, n in enumerate(raw)]
    for i, name in enumerate(wanted):
        candidate, again = name, 0
        while candidate in names or (again and candidate in wanted[i + 1:]):
            again += 1
            candidate = f"{name}.{again}"
        names.append(candidate)
    return names


def _reader(spark: SparkSession, charset: str, multi_line: bool):
    reader = spark.read.option("escape", '"').option("multiLine", multi_line).option("encoding", charset)
    return reader.option("mode", "PERMISSIVE")


def _extra_fields(record: Column, width: int) -> Column:
    """Whether a record that does not have ``width`` fields has more of them: a mark put behind it is then beyond the
    first ``width`` fields."""
    fields = ", ".join(f"f{i} string" for i in range(width + 1))
    marked = F.concat(F.regexp_replace(record, r"[\r\n]+$", ""), F.lit("," + MARK))
    options = {"escape": '"', "charToEscapeQuoteEscaping": END_OF_INPUT}
    return ~F.array_contains(F.array(*[F.coalesce(F.from_csv(marked, fields, options)[f"f{i}"], F.lit("")) for i in range(width + 1)]), MARK)


def scan_csv_text(
    spark: SparkSession, path, *, na=domain.NA_ON_LOAD, multi_line: bool = True, position: bool = False,
) -> DataFrame:
    """CSV files with a header as a table of strings; the charset is found per file.

    Files are split among tasks, also inside quotes; ``multi_line=False`` saves the search for quotes where no field has line
    breaks, and makes each line a record. ``na`` lists the texts read as null. ``position`` keeps the columns that ``in_file_order``
    needs. Empty fields are null, quoted ones are empty texts, and fields missing at the end of a record are null; a record with more
    fields than the header is an error when its rows are read, as is a file whose header differs from the first one's. Files without
    any line are passed over."""
    lines = read_lines(spark, path)
    splits = file_splits(spark, path, quotes=multi_line, lines=lines)
    first = splits.agg(F.min(F.struct("path", "latin")).alias("file")).first()["file"]
    if first is None:
        raise FileNotFoundError(f"no CSV data under {path}")
    head = _reader(spark, FALLBACK_CHARSET if first["latin"] else "UTF-8", multi_line).csv(first["path"]).first()
    if head is None:
        raise ValueError(f"no header in {first['path']}")
    names = header_names(list(head))
    fields = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{n} string" for n in [*fields, RECORD])
    # only what is not there is null: the parser's own mark for it, an empty text, is that of a quoted empty field too
    absent, end = (f"\x1a{uuid.uuid4().hex}" for _ in range(2))
    # U+FFFF ends the parser's input, so another text stands for it; as the escape of escapes, which is NUL by default, it never occurs
    options = {"escape": '"', "columnNameOfCorruptRecord": RECORD, "nullValue": absent, "charToEscapeQuoteEscaping": END_OF_INPUT}
    parsed = F.from_csv(F.replace("text", F.lit(END_OF_INPUT), F.lit(end)), schema, options)
    rows = read_records(lines, splits, quotes=multi_line).withColumn("fields", parsed)
    own = F.array(*[F.lower(F.regexp_replace(F.coalesce(F.col("fields")[n], F.lit("")), f"^{BOM}", "")) for n in fields])
    wanted = F.array(*[F.lower(F.lit((n or "").removeprefix(BOM))) for n in head])
    same = (own == wanted) & F.col("fields")[RECORD].isNull()
    error = F.raise_error(F.concat(F.lit("the header of "), "path", F.lit(f" is not that of {first['path']}: "), F.substring("text", 1, 200)))
    rows = rows.filter(F.when(~F.col("first"), True).when(same, False).otherwise(error.cast("boolean")))
    record = F.col("fields")[RECORD]
    failed = record.isNotNull() & _extra_fields(record, len(names))
    error = F.raise_error(F.concat(F.lit(f"more than {len(names)} fields: "), F.substring(record, 1, 200)))
    values = [F.replace(F.col("fields")[n], F.lit(end), F.lit(END_OF_INPUT)) for n in fields]
    values[0] = F.when(failed, error.cast("string")).otherwise(values[0])
    place = [F.col("path").alias("_file"), F.col("block").alias("_block"), F.col("seq").alias("_local")] if position else []
    return rows.select(*[(na_on_load(v, na) if na else v).alias(n) for v, n in zip(values, names)], *place)


def load_dataset(spark: SparkSession, path, **options) -> DataFrame:
    """CSV text with a dense file-order row index, stored as a columnar table: filters on the row index reach the scan."""
    return stage(in_file_order(scan_csv_text(spark, path, position=True, **options)), "dataset")


def dataset_profile(df: DataFrame, exclude=()) -> DataFrame:
    """One row: row count, column count, column names."""
    names = [c for c in df.columns if c not in exclude]
    columns = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(names)).alias("column_count"), columns.alias("columns")
    )
