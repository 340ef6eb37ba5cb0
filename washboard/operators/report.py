"""Reading a stored report: defaults, JSON, sort order, pages, counts."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard.functions import numbers
from washboard.sources.row_index import by_order

JSON_COLUMNS = ("original_values", "cleaned_values", "manual_reviews")
# fixed values: what a report holds where nothing was validated, and the texts that count as empty maps
EMPTY_VALIDATION = '{"result": "PASS", "filters": []}'
VALIDATION_TYPE = "struct<result:string,filters:array<string>>"
EMPTY_TEXTS = ("", "null", "None", "{}", "[]")
# Stored with a report, so that a page is a range of places and a cursor a range of keys: the place in sort order, the key as
# a number where it is one, and whether all keys are.
ORDER_COLUMNS = ("place", "key_number", "keys_numeric")
# Rows of a report per row of its index.
INDEX_STEP = 10_000


def report_defaults(report: DataFrame) -> DataFrame:
    """Add missing report columns with their defaults and read the flags as booleans."""

    def column(name: str, default: str) -> Column:
        return F.col(name).cast("string") if name in report.columns else F.lit(default)

    def flag(name: str) -> Column:
        return F.coalesce(column(name, "false").isin("true", "True", "1"), F.lit(False))

    status = column("validation_status", EMPTY_VALIDATION)
    return report.select(
        "uuid", *[column(c, "").alias(c) for c in JSON_COLUMNS],
        flag("is_dup").alias("is_dup"), flag("is_dup_cnic").alias("is_dup_cnic"),
        F.when(status.isNull() | (status == ""), EMPTY_VALIDATION).otherwise(status).alias("validation_status"),
        column("validation_result", "PASS").alias("validation_result"),
    )


def decode_map(text: Column, value_type: str = "string") -> Column:
    """JSON object text as a map; an empty map for null, blank or ``null`` text. Text that cannot be read is an error."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{value_type}>"))
    return F.coalesce(F.from_json(F.when(~F.trim(text).isin("", "null"), text), f"map<string,{value_type}>", {"mode": "FAILFAST"}), empty)


def decode_validation(text: Column) -> Column:
    """Validation JSON as a struct; PASS without filters where it cannot be read."""
    read = F.from_json(text, VALIDATION_TYPE)
    default = F.from_json(F.lit(EMPTY_VALIDATION), VALIDATION_TYPE)
    return F.when(read["result"].isNull(), default).otherwise(read)


def decode_report(report: DataFrame) -> DataFrame:
    """JSON columns of a report (after ``report_defaults``) as maps and structs."""
    return report.withColumns({
        "original_values": decode_map(F.col("original_values")),
        "cleaned_values": decode_map(F.col("cleaned_values"), "array<string>"),
        "manual_reviews": decode_map(F.col("manual_reviews")),
        "validation_status": decode_validation(F.col("validation_status")),
    })


def keys_are_numeric(report: DataFrame) -> bool:
    """True when every key is a number; one other key puts the whole report in text order."""
    if "keys_numeric" in report.columns:
        row = report.select("keys_numeric").first()
        return bool(row and row["keys_numeric"])
    row = report.agg(F.bool_and(numbers.to_number(F.col("uuid").cast("string")).isNotNull()).alias("all")).first()
    return bool(row["all"])


def sort_columns(numeric: bool) -> list[Column]:
    """Sort order of a report: by number and then text, or by text alone."""
    uuid = F.col("uuid").cast("string")
    return [numbers.to_number(uuid), uuid] if numeric else [uuid]


def in_stored_order(report: DataFrame) -> DataFrame:
    """``report`` with ORDER_COLUMNS, sorted once and written. A report that has them is returned as it is."""
    if set(ORDER_COLUMNS) <= set(report.columns):
        return report
    numeric = keys_are_numeric(report)
    number = numbers.to_number(F.col("uuid").cast("string"))
    placed = by_order(report.drop(*ORDER_COLUMNS), *sort_columns(numeric), row="place")
    return placed.withColumns({"key_number": number, "keys_numeric": F.lit(numeric)})


def after_key(key: str, numeric: bool) -> Column:
    """Rows of a report in stored order that come strictly after a key."""
    uuid = F.col("uuid").cast("string")
    if not numeric:
        return uuid > F.lit(key)
    last = F.lit(float(key))
    return (F.col("key_number") > last) | ((F.col("key_number") == last) & (uuid > F.lit(key)))


def sort_report(report: DataFrame) -> DataFrame:
    """The whole report in sort order, by the stored place where there is one."""
    if "place" in report.columns:
        return report.orderBy("place").drop(*ORDER_COLUMNS)
    return report.orderBy(*sort_columns(keys_are_numeric(report)))


def cursor_column(key: Column) -> Column:
    """URL-safe base64 of ``{"k": key}``."""
    text = F.to_json(F.struct(key.alias("k")))
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def cursor_key_column(token: Column) -> Column:
    """Key inside a cursor; null when the token is malformed."""
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    return F.get_json_object(F.try_validate_utf8(raw.cast("string")), "$.k")


def encode_cursor(key: str) -> str:
    # the same text a cursor column holds
    return base64.urlsafe_b64encode(json.dumps({"k": key}, ensure_ascii=False, separators=(",", ":")).encode()).decode()


def decode_cursor(token: str) -> str:
    try:
        return str(json.loads(base64.urlsafe_b64decode(token.encode("ascii")).decode())["k"])
    except (ValueError, KeyError, TypeError, binascii.Error, UnicodeError) as error:
        raise ValueError(f"invalid cursor: {error}") from error


def _check_size(page_size: int) -> None:
    if page_size < 1:
        raise ValueError("page_size must be at least 1")


def _range(report: DataFrame, start: int, size: int) -> DataFrame:
    return report.where((F.col("place") >= start) & (F.col("place") < start + size)).orderBy("place").drop(*ORDER_COLUMNS)


def page_by_offset(report: DataFrame, page: int, page_size: int) -> DataFrame:
    """Page number ``page`` (from 1) in sort order; empty past the end. A report in stored order is read by a filter on the
    place; any other is sorted and written first, for each call."""
    _check_size(page_size)
    if page < 1:
        raise ValueError("page must be at least 1")
    return _range(in_stored_order(report), (page - 1) * page_size, page_size)


@dataclass(frozen=True)
class ReportIndex:
    """What is stored beside a report: the totals of all its rows, and place and key of every ``INDEX_STEP``-th row."""

    keys: DataFrame
    rows: int
    numeric: bool
    summary: dict

    def before(self, key: str) -> int:
        """Place of the last indexed row that does not come after ``key``; the row after ``key`` is less than a step behind it."""
        row = self.keys.where(~after_key(key, self.numeric)).agg(F.max("place")).first()
        return row[0] or 0


def index_rows(stored: DataFrame, totals: dict[str, int]) -> DataFrame:
    """The table of an index: one row of totals (place -1) and one per step of ``stored``, a written report in stored order."""
    keys = stored.where(F.col("place") % INDEX_STEP == 0).select("place", F.col("uuid").cast("string").alias("uuid"), "key_number", "keys_numeric")
    numbers_ = [F.lit(n).cast("bigint").alias(name) for name, n in totals.items()]
    none = stored.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("double").alias("key_number"),
        F.lit(None).cast("boolean").alias("keys_numeric"))
    return keys.unionByName(none).select("*", *numbers_)


def open_index(table: DataFrame) -> ReportIndex:
    first = table.where("place <= 0").orderBy(F.desc("place")).first().asDict()
    summary = {name: first[name] for name in summary_counts(table)}
    return ReportIndex(table.where("place >= 0"), first["rows"], bool(first["keys_numeric"]), summary)


def _from_key(report: DataFrame, key: str, index: ReportIndex | None, more: int = 0) -> DataFrame:
    """Rows that come after ``key``: the first ``more`` of them at least, and all of them where there is no index."""
    if index is None:
        return report.where(after_key(key, keys_are_numeric(report)))
    start = index.before(key)
    return report.where((F.col("place") >= start) & (F.col("place") <= start + INDEX_STEP + more) & after_key(key, index.numeric))


def page_by_cursor(report: DataFrame, cursor: str | None, page_size: int, index: ReportIndex | None = None) -> DataFrame:
    """The next ``page_size`` rows after a cursor; the first ones without a cursor. With the index of the report one short range of
    places is read, wherever the cursor points."""
    _check_size(page_size)
    report = in_stored_order(report)
    if cursor is None:
        return _range(report, 0, page_size)
    rest = _from_key(report, decode_cursor(cursor), index, page_size)
    return rest.orderBy("place").limit(page_size).drop(*ORDER_COLUMNS)


def get_page(report: DataFrame, page_size: int, cursor: str | None = None, page: int | None = None, index: ReportIndex | None = None):
    """One page by number or by cursor (the number wins), the first page without either."""
    if page is None and cursor is not None:
        return page_by_cursor(report, cursor, page_size, index)
    return page_by_offset(report, 1 if page is None else page, page_size)


def page_metadata(
    report: DataFrame, page_size: int, cursor: str | None = None, page: int | None = None, index: ReportIndex | None = None
) -> DataFrame:
    """One row of page counts and the cursor of the next page (null on the last one).

    The counts follow from the number of rows, which the index of the report holds, and the first place of the page; one more row
    is read for the cursor."""
    _check_size(page_size)
    report = in_stored_order(report)
    total = index.rows if index else report.count()
    start = ((page or 1) - 1) * page_size
    if page is None and cursor is not None:
        after = _from_key(report, decode_cursor(cursor), index).agg(F.min("place")).first()[0]
        start = total if after is None else after
    returned = max(0, min(page_size, total - start))
    has_more = start + page_size < total
    current = start // page_size + 1 if total else 1
    last = report.where(F.col("place") == start + returned - 1).agg(F.max(F.col("uuid").cast("string")).alias("last"))
    return last.select(
        F.lit(page_size).alias("page_size"), F.lit(returned).cast("bigint").alias("returned"), F.lit(total).cast("bigint").alias("total_rows"),
        numbers.ceil_pages(F.lit(total), page_size).alias("total_pages"),
        F.lit(current).cast("bigint").alias("current_page"), F.lit(has_more).alias("has_more"),
        F.lit(current > 1).alias("has_prev"),
        F.when(F.lit(has_more) & F.col("last").isNotNull(), cursor_column(F.col("last"))).alias("next_cursor"),
    )


@dataclass(frozen=True)
class Page:
    """Rows of one page with defaults (and maps, if decoded), its counts with the cursor asked for, and the counts of the whole report."""

    rows: DataFrame
    metadata: dict
    summary: dict


def read_page(
    report: DataFrame, page_size: int, cursor: str | None = None, page: int | None = None, decode_json: bool = True, index: ReportIndex | None = None
) -> Page:
    """One page of a report with everything that is shown around it. With the index of the report no count is taken of its rows."""
    report = in_stored_order(report)
    rows = report_defaults(get_page(report, page_size, cursor, page, index))
    counts = page_metadata(report, page_size, cursor, page, index).first().asDict() | {"cursor": cursor}
    summary = index.summary if index else report_summary(report_defaults(report)).first().asDict()
    return Page(decode_report(rows) if decode_json else rows, counts, summary)


def summary_counts(report: DataFrame) -> dict[str, Column]:
    """Aggregates of a report: records with changes, with reviews, with a repeated id, with a repeated identity number."""

    def filled(name: str) -> Column:
        return F.count_if(~F.coalesce(F.trim(name), F.lit("")).isin(*EMPTY_TEXTS)) if name in report.columns else F.sum(F.lit(0)).cast("bigint")

    def flagged(name: str) -> Column:
        return F.count_if(F.col(name)) if name in report.columns else F.sum(F.lit(0)).cast("bigint")

    return {
        "total_cleaned": filled("cleaned_values"), "total_review": filled("manual_reviews"),
        "total_duplicate_uuid": flagged("is_dup"), "total_duplicate_cnic": flagged("is_dup_cnic"),
    }


def report_summary(report: DataFrame) -> DataFrame:
    """One row of ``summary_counts``."""
    return report.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in summary_counts(report).items()])
