from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from washboard.operators import lookup
from washboard.plans.clean import clean_dataset
from washboard.rules import ColumnRule, RulePack
from washboard.sinks import outputs
from washboard.session import TABLE, release, remember, stage, stage_alone, staging
from washboard.sources import csv, row_index


def test_header_names():
    assert csv.header_names(["a", "a", "a", None, "b"]) == ["a", "a.1", "a.2", "Unnamed: 3", "b"]
    assert csv.header_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]


def test_csv_text(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('﻿id,name,name,note\r\n007,"a ""b"", c",x,"two\nlines"\r\n8,NA, NA ,-\r\n9,"",nil,n/a\r\n'.encode())
    df = csv.scan_csv_text(spark, str(path))
    assert df.columns == ["id", "name", "name.1", "note"]
    assert {t for _, t in df.dtypes} == {"string"}
    assert rows(df) == [("007", 'a "b", c', "x", "two\nlines"), ("8", None, " NA ", "-"), ("9", None, "nil", None)]


def test_charset_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,v\n1,café\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,v\n2,café\n".encode("latin-1"))
    charsets = {r["path"][-5:]: r["charset"] for r in csv.file_charsets(spark, str(tmp_path)).collect()}
    assert charsets == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}
    assert sorted(rows(csv.scan_csv_text(spark, str(tmp_path)))) == [("1", "café"), ("2", "café")]


def test_file_order_index(spark, tmp_path):
    lines = 20_000
    path = tmp_path / "big.csv"
    path.write_text("n,pad\n" + "\n".join(f"{i},{'x' * 40}" for i in range(lines)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = csv.load_dataset(spark, str(path), multi_line=False)
        assert df.where("cast(n as bigint) <> row_idx").count() == 0
        assert df.agg(F.count_distinct("row_idx"), F.max("row_idx")).first() == (lines, lines - 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_order_over_files(spark, tmp_path):
    for name, ids in (("a", range(3)), ("b", range(3, 500)), ("c", range(500, 510))):
        (tmp_path / f"{name}.csv").write_text("n\n" + "\n".join(map(str, ids)) + "\n")
    df = csv.load_dataset(spark, str(tmp_path))
    assert df.where("cast(n as bigint) <> row_idx").count() == 0 and df.count() == 510


def test_index_by_order_is_dense_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    found = rows(row_index.by_order(df, "k", "id").orderBy("row_idx"))
    assert [r[2] for r in found] == list(range(1000))
    assert [(r[0], r[1]) for r in found] == sorted((r[0], r[1]) for r in found)


def test_routes():
    target = outputs.route_output("/data/", " Beneficiary ", " North ")
    assert target.path("report") == "/data/beneficiary/North/North_report.parquet"
    assert outputs.route_output("/data", "banks").path("cleaned") == outputs.route_output("/data", "FINANCIALS").path("cleaned")
    for bad in (("planets", None), ("certificates", None), ("banks", "x"), ("beneficiary", "a/b"), ("beneficiary", ".."), ("beneficiary", " "), ("beneficiary", "a\\b")):
        with pytest.raises(outputs.InvalidTarget):
            outputs.route_output("/data", *bad)


def test_round_trip(spark, tmp_path):
    pack = RulePack(rules=(ColumnRule("id", "numeric", non_null=True, unique=True), ColumnRule("ok", "bool")), reference_year=2026)
    df = spark.createDataFrame([(0, "1", "y", "é"), (1, "2", "-", None), (2, "2", "no", "b ")], "row_idx long, id string, ok string, note string")
    root = str(tmp_path)
    target = outputs.write_outputs(clean_dataset(df, pack), root, "beneficiary", "North")
    assert sorted(rows(outputs.read_cleaned(spark, target), "id", "ok", "note")) == [("1", "Yes", "é"), ("2", "", ""), ("2", "No", "b")]
    stored = {r["uuid"]: r for r in outputs.read_report(spark, target).collect()}
    assert stored["1"]["cleaned_values"] == '{"ok":["Yes","BOOL_STANDARDIZED"]}'
    assert stored["2"]["manual_reviews"] == '{"id":"2","ok":"-","note":null}'
    assert stored["2"]["original_values"] == '{"id":"2","ok":"-","note":null}'
    assert stored["2__duplicate_row_4"]["is_dup"] is True
    assert rows(outputs.list_outputs(spark, root), "data_type", "ip_name", "stem", "file") == [
        ("beneficiary", "North", "North", "North_report.parquet")]
    sizes = outputs.output_sizes(spark, target).first()
    assert sizes["total_size_mb"] == pytest.approx(sizes["cleaned_size_mb"] + sizes["report_size_mb"])
    # writing again replaces
    outputs.write_outputs(clean_dataset(df.limit(1), pack), root, "Beneficiary", "North")
    assert outputs.read_report(spark, target).count() == 1


def test_missing_outputs(spark, tmp_path):
    target = outputs.route_output(str(tmp_path), "certificates", "X")
    assert outputs.read_report(spark, target) is None and outputs.read_cleaned(spark, target) is None
    spark.createDataFrame([("1",)], "id string").write.option("header", True).csv(target.path("cleaned", "csv"))
    assert rows(outputs.read_cleaned(spark, target)) == [("1",)]


def test_nulls_can_be_kept(spark, tmp_path):
    target = outputs.route_output(str(tmp_path), "banks")
    df = spark.createDataFrame([(0, None), (1, "x")], "row_idx long, v string")
    outputs.write_cleaned(df, target, null_as_empty=False)
    assert sorted(rows(outputs.read_cleaned(spark, target)), key=str) == [("x",), (None,)]


def test_release_deletes_intermediate_tables(spark):
    release(spark)
    staged = stage(spark.range(3), "test")
    assert staged.count() == 3 and release(spark) == 1 and release(spark) == 0


def test_staging_deletes_its_own_tables_only(spark):
    before = stage(spark.range(4), "test")
    with staging(spark):
        inside = stage(spark.range(3), "test")
        assert inside.count() == 3
    assert before.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inside.select("id").collect()


def _files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


@pytest.mark.parametrize("multi_line", [True, False])
def test_more_fields_than_the_header_are_an_error(spark, tmp_path, multi_line):
    path = _files(tmp_path, a="a,b\n1,2\n3\n\"x, y\",\n")
    found = csv.scan_csv_text(spark, path, multi_line=multi_line, na=()).collect()
    assert sorted(tuple(r) for r in found if r[0]) == [("1", "2"), ("3", None), ("x, y", None)]
    for extra in ("1,2,EXTRA", "1,2,", '1,2,"q, r"'):
        path = _files(tmp_path, a=f"a,b\n0,0\n{extra}\n")
        with pytest.raises(Exception, match="more than 2 fields"):
            csv.load_dataset(spark, path, multi_line=multi_line).collect()


def test_headers_that_differ_are_an_error(spark, tmp_path):
    path = _files(tmp_path, one="a,b\n1,2\n", two="b,a\n9,8\n")
    with pytest.raises(Exception, match="header"):
        csv.scan_csv_text(spark, path).collect()


def test_files_without_lines_are_passed_over(spark, tmp_path):
    path = _files(tmp_path, one="", two="a,b\n1,2\n")
    assert [tuple(r) for r in csv.scan_csv_text(spark, path).collect()] == [("1", "2")]
    with pytest.raises(FileNotFoundError):
        csv.scan_csv_text(spark, str(tmp_path / "one.csv"))


def test_cleaned_keeps_row_order_and_needs_no_flags(spark, tmp_path, monkeypatch):
    data = [(i, "7" if i % 3 else str(i), f"text {i}") for i in range(500)]
    df = spark.createDataFrame(data, "row_idx long, da_uuid string, note string").repartition(5)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    result = clean_dataset(df, RulePack(rules=(ColumnRule("da_uuid", "numeric", unique=True),)))
    assert "Join" not in result.cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in result.report()._jdf.queryExecution().executedPlan().toString()  # made once and written
    target = outputs.route_output(str(tmp_path), "banks")
    outputs.write_cleaned(result.cleaned, target)
    parts = sorted((tmp_path / "Banks_Financials" / "Banks_Financials_cleaned.parquet").glob("part-*"))
    notes = [r["note"] for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert notes == [n for _, _, n in data]


def test_stage_alone_leaves_one_table(spark):
    def make():
        inner = stage(spark.range(5), "inner")
        spark.range(3).write.mode("overwrite").saveAsTable("wb_leak_test")
        remember(spark, TABLE + "wb_leak_test")
        return inner.where("id > 1")

    with staging(spark):
        kept = stage_alone(spark, make, "outer")
        assert kept.count() == 3 and not spark.catalog.tableExists("wb_leak_test")
        folder = Path(kept.inputFiles()[0].removeprefix("file:")).parent.parent
        assert not list(folder.glob("washboard-inner-*"))
    assert not list(folder.glob("washboard-outer-*"))


def test_many_reports_in_one_write(spark, tmp_path):
    """One write replaces just the targets it has rows for; each is read and listed like one written alone."""
    root = str(tmp_path)
    names = ["North", "50% + more", "a=b:c", "é x"]

    def frame(rows):
        return spark.createDataFrame(rows, "data_type string, ip_name string, uuid string, cleaned_values string")

    outputs.write_report(spark.createDataFrame([("old",)], "uuid string"), outputs.route_output(root, "certificates", "North"))
    first = [(" Beneficiary ", f" {n} ", str(k), "{}") for n in names for k in (10, 9, 100)] + [("banks", None, "b", "{}"), ("banks", "", "10", "{}")]
    assert outputs.write_reports(frame(first), root).count() == 5
    for n in names:
        stored = outputs.read_report(spark, outputs.route_output(root, "beneficiary", n))
        assert [r["uuid"] for r in stored.orderBy("place").collect()] == ["9", "10", "100"]
        assert [r["place"] for r in stored.orderBy("place").collect()] == [0, 1, 2]
    banks = outputs.read_report(spark, outputs.route_output(root, "financials"))
    assert [r["uuid"] for r in banks.orderBy("place").collect()] == ["10", "b"]  # a text key: sorted as text
    # the next write has two of the targets, one of which lay alone before
    outputs.write_reports(frame([("certificates", "North", "new", "{}"), ("beneficiary", "North", "7", "{}")]), root)
    read = {n: rows(outputs.read_report(spark, outputs.route_output(root, "beneficiary", n)).orderBy("place"), "uuid") for n in names}
    assert read == {n: [("7",)] if n == "North" else [("9",), ("10",), ("100",)] for n in names}
    assert rows(outputs.read_report(spark, outputs.route_output(root, "certificates", "North")), "uuid") == [("new",)]
    # and a single write takes its target out of the common table
    outputs.write_report(spark.createDataFrame([("alone",)], "uuid string"), outputs.route_output(root, "beneficiary", "a=b:c"))
    assert rows(outputs.read_report(spark, outputs.route_output(root, "beneficiary", "a=b:c")), "uuid") == [("alone",)]
    listed = rows(outputs.list_outputs(spark, root), "data_type", "ip_name", "stem", "file")
    assert sorted(listed, key=str) == sorted(
        [("beneficiary", n, n, f"{n}_report.parquet") for n in names] + [("certificates", "North", "North", "North_report.parquet"),
         ("banks", None, "Banks_Financials", "Banks_Financials_report.parquet")], key=str)
    for bad in (("planets", None), ("beneficiary", None), ("beneficiary", "a/b"), ("banks", "x"), (None, "x")):
        with pytest.raises(Exception, match="no target"):
            outputs.write_reports(frame([(*bad, "1", "{}")]), root)
