"""Files split among tasks give the records that one reader of the whole file finds."""

import csv as plain_csv
import io
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from washboard.plans import queries
from washboard.sources import csv
from washboard.sources.records import ends_inside, file_splits


def plain_state(text: bytes, inside: bool) -> bool:
    """Character by character."""
    state = "quoted" if inside else "start"
    for i, ch in enumerate(text.decode("latin-1")):
        if state == "quoted":
            state = "quote" if ch == '"' else "quoted"
        elif ch == ",":
            state = "start"
        elif state == "quote":
            state = "quoted" if ch == '"' else "bare"
        else:
            state = "quoted" if state == "start" and ch == '"' else "bare"
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='",a\r', max_size=14), st.booleans())
def test_state_at_the_end_of_a_line(text, inside):
    assert ends_inside(text.encode(), inside) == plain_state(text.encode(), inside)


def table(seed: int, rows: int, width: int, end: str = "\n"):
    rng = random.Random(seed)
    words = ["", "x", "plain text", 'say ""hi""', "a,b", "line one\nline two", "\n\n", 'stray " quote', "é ü", "1234567890" * 4, '"', "tail\n,\"\n"]
    data = [[rng.choice(words) for _ in range(width)] for _ in range(rows)]
    for r in data:
        r[0] = r[0] or "k"  # a blank record would be passed over
    out = io.StringIO()
    writer = plain_csv.writer(out, lineterminator=end)
    writer.writerow([f"col {i}" for i in range(width)])
    writer.writerows(data)
    return out.getvalue(), data


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_keep_records_and_order(spark, tmp_path, small_splits, end):
    wanted = []
    for k, name in enumerate(("a", "b", "c")):
        text, data = table(k, 60, 3, end)
        (tmp_path / f"{name}.csv").write_bytes(text.encode("latin-1" if k == 1 else "utf-8"))
        wanted += data
    splits = file_splits(spark, str(tmp_path))
    assert splits.where("inside").count() > 3 and splits.count() > 20
    df = csv.load_dataset(spark, str(tmp_path), na=())
    found = [tuple(r) for r in df.orderBy("row_idx").collect()]
    # an empty field is null unless it is quoted, which the writer does for a lone one only
    assert [tuple(v or "" for v in r[:-1]) for r in found] == [tuple(r) for r in wanted]
    assert [r[-1] for r in found] == list(range(len(wanted)))


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    text, data = table(9, 200, 2)
    path = tmp_path / "one.csv"
    path.write_text(text)
    df = csv.scan_csv_text(spark, str(path), na=())
    assert df.count() == len(data)
    frame = pd.read_csv(path, dtype=str, keep_default_na=False)
    assert sorted(tuple(v or "" for v in r) for r in df.collect()) == sorted(frame.itertuples(index=False, name=None))


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "a.csv").write_text(f'n,t\n1,"{long}"\n2,x\n3,"open to the\nend')
    (tmp_path / "b.csv").write_text('n,"two\nlines"\n4,y\n')
    found = csv.load_dataset(spark, str(tmp_path / "a.csv"), na=()).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [("1", long, 0), ("2", "x", 1), ("3", "open to the\nend", 2)]
    assert csv.scan_csv_text(spark, str(tmp_path / "b.csv")).columns == ["n", "two\nlines"]
    assert [tuple(r) for r in csv.scan_csv_text(spark, str(tmp_path / "b.csv")).collect()] == [("4", "y")]


def test_blank_records_and_stray_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n\r\n1,say "x\r\n\r\n2,5" by 3"\r\n  ,y\r\n')
    assert [tuple(r) for r in csv.scan_csv_text(spark, str(tmp_path), na=()).collect()] == [("1", 'say "x'), ("2", '5" by 3"'), ("  ", "y")]
    assert [tuple(r) for r in csv.scan_csv_text(spark, str(tmp_path), na=(), multi_line=False).collect()] == [("1", 'say "x'), ("2", '5" by 3"'), ("  ", "y")]


def test_mixed_charsets_are_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,v\n1,café\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,v\n2,café\n".encode("latin-1"))
    df = csv.scan_csv_text(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [("1", "café"), ("2", "café")]
    final = str(df._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[0]
    assert final.count("Scan text") == 1 and "Union" not in final


@pytest.mark.parametrize("late", [False, True])
def test_both_passes_find_the_same_splits(spark, tmp_path, monkeypatch, late):
    """Settings change, or executors come and go, between the two passes, or else between the call and the job."""
    text, data = table(5, 80, 2)
    (tmp_path / "a.csv").write_text(text)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def split(size):
        for name, value in zip(names, (size, "1", "1")):
            spark.conf.set(name, value)

    def splits_then_change(*args, found=csv.file_splits, **options):
        splits = found(*args, **options)
        split("300")
        return splits

    if not late:
        monkeypatch.setattr(csv, "file_splits", splits_then_change)
    try:
        split("100000" if late else "700")
        df = csv.scan_csv_text(spark, str(tmp_path), na=())
        split("300")
        assert sorted(tuple(v or "" for v in r) for r in df.collect()) == sorted(map(tuple, data))
        df.createOrReplaceTempView("both_passes")
        assert spark.table("both_passes").count() == len(data)
    finally:
        for name in names:
            spark.conf.unset(name)


def test_quoted_empty_fields_are_empty_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"",\n"",x,""\n2\n')
    found = {tuple(r) for r in csv.scan_csv_text(spark, str(tmp_path), na=()).collect()}
    assert found == {("1", "", None), ("", "x", ""), ("2", None, None)}
    assert csv.scan_csv_text(spark, str(tmp_path)).where("b = '' or c = ''").count() == 0


ODD = ["", None, " ", "\r", "\r\n", "a\r", "\n\n", "\\", '\\"', '"', '""', 'a"', '"a', ",", 'a,"\n"b', "\ufeffx", "\x00", "#c", "\x1aend\x1a", "\xa0", "\x85", "é", "Ã©", "\u2028", " x ", "null", "ï»¿x", 'a\x00"', '\x00"\n', "\uffff", 'a\uffff"']


@pytest.mark.parametrize("name", ["scan_csv_text", "csv_encoding_ladder"])
def test_odd_documents_come_back(spark, tmp_path, name):
    texts = [(lang, "s", text) for lang in ("en", "de") for text in ODD] + [(odd, odd, "text") for odd in ODD]
    docs = [(i, *row) for i, row in enumerate(texts)]
    schema = "doc_id long, lang string, source string, text string"
    spark.createDataFrame(docs, schema).repartition(len(docs)).write.parquet(str(tmp_path / "documents.parquet"))
    # a file for each row, since a charset is found per file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        df = queries.REGISTRY[name](spark, str(tmp_path))
        found = {r["doc_id"]: r.asDict() for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = {str(d[0]): dict(zip(("doc_id", "lang", "source", "text"), (str(d[0]), *d[1:]))) for d in docs}
    assert found == {k: {c: w[c] for c in df.columns} for k, w in wanted.items()}
