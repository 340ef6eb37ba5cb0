import pytest
from conftest import rows
from pyspark.sql import functions as F

from washboard.operators import report as R
from washboard.sinks import outputs


def report_of(spark, keys):
    return spark.createDataFrame([(k, "{}") for k in keys], "uuid string, cleaned_values string")


NUMERIC = [str(i) for i in range(1, 40)] + ["2.2", "2.7", "1e2", "007"]
MIXED = ["10", "9", "b", "A", "é", "9__duplicate_row_3", "ROW_2", ""]


@pytest.mark.parametrize("keys, order", [
    (NUMERIC, sorted(NUMERIC, key=lambda k: (float(k), k))), (MIXED, sorted(MIXED)), (["1", "nan"], ["1", "nan"]), (["12d", "2"], ["12d", "2"]),
])
def test_order_and_paging(spark, keys, order):
    df = report_of(spark, keys)
    df = R.in_stored_order(df)
    assert [r[0] for r in rows(R.sort_report(df), "uuid")] == order
    size, by_page, by_cursor, cursor = 7, [], [], None
    for page in range(1, len(keys) // size + 3):
        by_page += [r[0] for r in rows(R.page_by_offset(df, page, size), "uuid")]
    while True:
        found = [r[0] for r in rows(R.page_by_cursor(df, cursor, size), "uuid")]
        by_cursor += found
        if len(found) < size:
            break
        cursor = R.encode_cursor(found[-1])
    assert by_page == order and by_cursor == order


def test_pages_of_a_written_report_are_filters(spark, tmp_path):
    keys = [str(i) for i in range(500)]
    target = outputs.route_output(str(tmp_path), "banks")
    outputs.write_report(report_of(spark, reversed(keys)), target)
    stored = outputs.read_report(spark, target)
    for page in (1, 7, 25, 30):
        assert [r[0] for r in rows(R.page_by_offset(stored, page, 20), "uuid")] == keys[(page - 1) * 20 : page * 20]
    plan = R.page_by_offset(stored, 25, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place,480)" in plan and "TakeOrderedAndProject" not in plan
    plan = R.page_by_cursor(stored, R.encode_cursor("77"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(key_number,77.0)" in plan and "TakeOrderedAndProject(limit=20" in plan
    page = R.read_page(stored, 20, R.encode_cursor("77"))
    assert [r["uuid"] for r in page.rows.collect()] == keys[78:98] and page.metadata["cursor"] == R.encode_cursor("77")
    assert page.metadata["total_rows"] == 500 and page.summary["total_cleaned"] == 0
    assert set(R.ORDER_COLUMNS).isdisjoint(page.rows.columns)


@pytest.mark.parametrize("keys", [[str(i) for i in range(100)], NUMERIC, MIXED])
def test_pages_by_the_stored_index(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(R, "INDEX_STEP", 7)
    target = outputs.route_output(str(tmp_path), "banks")
    flags = [(k, '{"a": 1}' if i % 3 else "{}", i % 5 == 0, None) for i, k in enumerate(keys)]
    outputs.write_report(spark.createDataFrame(flags, "uuid string, cleaned_values string, is_dup boolean, is_dup_cnic boolean"), target)
    stored, index = outputs.read_report(spark, target), outputs.read_report_index(spark, target)
    assert index.rows == len(keys) and index.keys.count() == -(-len(keys) // 7)
    assert index.summary == R.report_summary(R.report_defaults(stored)).first().asDict()
    for key in [*keys[::2], " ", "~"] if keys is MIXED else [*keys[::9], "0", "50.5", "1000"]:
        cursor = R.encode_cursor(key)
        assert rows(R.page_by_cursor(stored, cursor, 10, index)) == rows(R.page_by_cursor(stored, cursor, 10))
        assert R.page_metadata(stored, 10, cursor, index=index).first() == R.page_metadata(stored, 10, cursor).first()
    plan = R.page_by_cursor(stored, R.encode_cursor("5"), 10, index)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(place" in plan
    page = R.read_page(stored, 10, R.encode_cursor(keys[0]), index=index)
    assert page.metadata["total_rows"] == len(keys) and page.summary == index.summary


def test_index_of_an_empty_report(spark, tmp_path):
    target = outputs.route_output(str(tmp_path), "banks")
    outputs.write_report(report_of(spark, ["1"]).where("false"), target)
    stored, index = outputs.read_report(spark, target), outputs.read_report_index(spark, target)
    assert index.rows == 0 and set(index.summary.values()) == {0}
    page = R.read_page(stored, 10, R.encode_cursor("3"), index=index)
    assert page.rows.count() == 0 and page.metadata["total_pages"] == 1
    assert outputs.read_report_index(spark, outputs.route_output(str(tmp_path), "certificates", "X")) is None


def test_broken_json_is_an_error(spark):
    df = R.report_defaults(spark.createDataFrame([("1", "{broken")], "uuid string, cleaned_values string"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        R.decode_report(df).collect()


def test_metadata(spark):
    df = report_of(spark, [str(i) for i in range(45)])

    def meta(**kw):
        return R.page_metadata(df, 20, **kw).first().asDict()

    first = meta()
    assert (first["returned"], first["total_rows"], first["total_pages"], first["current_page"]) == (20, 45, 3, 1)
    assert first["has_more"] and not first["has_prev"] and R.decode_cursor(first["next_cursor"]) == "19"
    second = meta(cursor=first["next_cursor"])
    assert second["current_page"] == 2 and second["has_prev"] and R.decode_cursor(second["next_cursor"]) == "39"
    last = meta(page=3, cursor=first["next_cursor"])  # the page number wins
    assert (last["returned"], last["has_more"], last["next_cursor"]) == (5, False, None)
    assert meta(page=9)["returned"] == 0 and meta(page=9)["next_cursor"] is None
    empty = R.page_metadata(report_of(spark, []), 20).first()
    assert (empty["total_pages"], empty["current_page"], empty["returned"]) == (1, 1, 0)


def test_bad_requests(spark):
    df = report_of(spark, ["1"])
    with pytest.raises(ValueError):
        R.page_by_offset(df, 0, 10)
    with pytest.raises(ValueError):
        R.page_by_offset(df, 1, 0)
    for token in ("%%%", "eyJ4IjoxfQ==", "é"):
        with pytest.raises(ValueError):
            R.decode_cursor(token)


def test_cursor_columns(spark):
    df = spark.createDataFrame([("é/1",), ("a?>~",)], "k string").select("k", R.cursor_column(F.col("k")).alias("c"))
    for key, token in rows(df):
        assert R.decode_cursor(token) == key and R.encode_cursor(key) == token
    bad = spark.createDataFrame([("!!",)], "t string")
    assert bad.select(R.cursor_key_column(F.col("t"))).first()[0] is None


def test_defaults_and_decoding(spark):
    df = spark.createDataFrame(
        [("1", '{"a":null}', '{"a":["x","TRIM"]}', "", "True", "not json"), ("2", "", None, "{}", "no", '{"result": "FAIL", "filters": []}')],
        "uuid string, original_values string, cleaned_values string, manual_reviews string, is_dup string, validation_status string",
    )
    full = R.report_defaults(df)
    assert [r["is_dup"] for r in full.collect()] == [True, False]
    assert {r["is_dup_cnic"] for r in full.collect()} == {False} and {r["validation_result"] for r in full.collect()} == {"PASS"}
    one, two = R.decode_report(full).collect()
    assert one["original_values"] == {"a": None} and one["cleaned_values"] == {"a": ["x", "TRIM"]} and one["manual_reviews"] == {}
    assert one["validation_status"]["result"] == "PASS" and two["validation_status"]["result"] == "FAIL"
    assert two["original_values"] == {} and two["cleaned_values"] == {}
    assert R.report_summary(full).first()["total_cleaned"] == 1


def test_write_report_makes_each_row_once(spark, tmp_path):
    # a sort makes what it reads twice, once for its ranges, which for a report are the texts of all its rows
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(key):
        made.add(1)
        return key

    report = report_of(spark, [str(k) for k in range(50)]).withColumn("cleaned_values", counted("uuid"))
    outputs.write_report(report, outputs.route_output(str(tmp_path), "certificates", "Once"))
    assert made.value == 50
