"""Hand-derived results of the whole run on one small table with the default rules."""

import pytest
from pyspark.sql import functions as F

from washboard.operators import dates, quality
from washboard.plans.clean import clean_dataset
from washboard.rules import ColumnRule, RulePack, default_pack, normal_name

PACK = default_pack(reference_year=2026)
DEFAULTS = {
    "DA_UUID": None, "DA_CNIC": None, "Cell No": "03001234567", "District": "Badin", "Status of Land": "State Land",
    "Main Source of hh Income": "Farmer", "Address": "Street 1", "Gender": "Male", "Widow": "No", "Lat": "25.5",
    "Unaccompained minors i.e. orphans": "No", "Monthly Income": "100", "visit_date": "01/02/2024", "total_cost": "5",
    "work_status": "fine", "Donor Bank": "UBL",
}
ROWS = [
    {"DA_UUID": " 10 ", "DA_CNIC": "42201-1234567-1", "Cell No": "+92 300 1234567", "District": "hyderbad"},
    {"DA_UUID": "10", "DA_CNIC": "4220112345671", "District": "hyderabad", "Main Source of hh Income": "transportaion"},
    {"DA_UUID": "n/a", "DA_CNIC": "1111111111111", "Gender": "N/A", "Widow": "none", "Lat": "41"},
    {"DA_UUID": "A-4", "DA_CNIC": "4.220112345678E+12", "Status of Land": "Village Land / Community"},
    {"DA_UUID": "5", "DA_CNIC": "4.22E+12x", "Address": "***", "visit_date": "10:30"},
    {"DA_UUID": "6", "DA_CNIC": "123", "Address": "h# 5,  o'neil 3rd", "visit_date": "2024", "Gender": "third-gender"},
    {"DA_UUID": "7", "DA_CNIC": "3520112345671", "visit_date": "13/02/75", "Lat": "25,5", "Gender": "x"},
    {"DA_UUID": "8", "DA_CNIC": "3520112345672", "Unaccompained minors i.e. orphans": "maybe", "work_status": "12"},
    {"DA_UUID": "9", "DA_CNIC": "3520112345673", "total_cost": "abc", "Monthly Income": "12k"},
    {"DA_UUID": "11", "DA_CNIC": "3520112345674", "Donor Bank": "habib-bank"},
    {"DA_UUID": "12", "DA_CNIC": "3520112345675", "Cell No": "021-33", "Donor Bank": "Corner Shop"},
    {"DA_UUID": "13", "DA_CNIC": "3520112345676", "District": "Nil*", "visit_date": "31/31/2024"},
    {"DA_UUID": "14", "DA_CNIC": "3520112345677"},
    {"DA_UUID": "15", "DA_CNIC": "3520112345678"},
]


def table(spark, rows):
    names = list(DEFAULTS)
    data = [(i, *[{**DEFAULTS, **r}[n] for n in names]) for i, r in enumerate(rows)]
    fields = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(data, f"row_idx long, {fields}")


@pytest.fixture(scope="module")
def cleaned(spark):
    result = clean_dataset(table(spark, ROWS), PACK)
    cells = {(c["row_idx"], c["column"]): c for c in result.tracked.cells().collect()}
    records = {r["row_idx"]: r for r in result.records().collect()}
    return result, cells, records


def change(cleaned, row, column):
    cell = cleaned[1].get((row, column))
    return (cell["value"], cell["steps"]) if cell and cell["steps"] else None


def review(cleaned, row, column):
    cell = cleaned[1].get((row, column))
    return (cell["review_value"],) if cell and cell["flagged"] else None


@pytest.mark.parametrize("row, column, expected", [
    (0, "DA_UUID", ("10", "TRIM")),
    (0, "DA_CNIC", ("4220112345671", "CNIC_FORMAT")),
    (0, "Cell No", ("03001234567", "CELL_NO_NORMALIZED")),
    (0, "District", ("Hyderbad", "TITLE_CASED")),
    (1, "District", ("Hyderabad", "TITLE_CASED")),
    (1, "Main Source of hh Income", ("Transportation", "TITLE_CASED | CATEGORY_STANDARDIZED")),
    (2, "DA_UUID", (None, "NULL_STANDARDIZED")),
    (2, "Widow", (None, "NULL_STANDARDIZED")),
    (3, "DA_CNIC", ("4220112345678", "CNIC_FORMAT")),
    (3, "Status of Land", ("Village Land Community", "SPECIAL_CHARS_CLEANED")),
    (4, "Address", ("", "SPECIAL_CHARS_CLEANED")),
    (4, "visit_date", None),
    (5, "Address", ("H# 5, O'Neil 3Rd", "TRIM | TITLE_CASED")),
    (5, "Gender", ("Transgender", "GENDER_STANDARDIZED")),
    (5, "visit_date", ("01/01/2024", "DATE_STANDARDIZED")),
    (6, "visit_date", ("02/13/2075", "DATE_STANDARDIZED")),
    (9, "Donor Bank", ("Habib Bank Limited", "BANK_STANDARDIZED")),
    (10, "Donor Bank", None),  # no alias and nothing similar
    (11, "District", ("Nil", "SPECIAL_CHARS_CLEANED")),
    (12, "Donor Bank", ("United Bank Limited", "BANK_STANDARDIZED")),
])
def test_changes(cleaned, row, column, expected):
    assert change(cleaned, row, column) == expected


@pytest.mark.parametrize("row, column, expected", [
    (0, "DA_UUID", ("10",)),  # repeated after trimming
    (1, "DA_UUID", ("10",)),
    (0, "DA_CNIC", ("42201-1234567-1",)),  # repeated; the text before formatting is kept
    (1, "DA_CNIC", ("4220112345671",)),
    (0, "District", ("Hyderbad",)),  # 82 points: review
    (2, "DA_UUID", (None,)),  # the id step stores null over the token text
    (2, "DA_CNIC", ("1111111111111",)),
    (2, "Gender", ("N/A",)),
    (2, "Widow", ("none",)),  # a token before it could mean no
    (2, "Lat", ("41",)),
    (3, "DA_UUID", ("A-4",)),
    (3, "DA_CNIC", None),
    (3, "Status of Land", ("Village Land Community",)),
    (4, "DA_CNIC", ("4.22E+12x",)),
    (4, "Address", None),  # emptied by cleaning: no longer a null to report
    (4, "visit_date", ("10:30",)),
    (5, "DA_CNIC", ("123",)),
    (6, "Lat", ("25,5",)),
    (6, "Gender", ("x",)),
    (7, "Unaccompained minors i.e. orphans", ("maybe",)),
    (7, "work_status", ("12",)),  # a number among texts
    (8, "total_cost", ("abc",)),  # a text among numbers
    (8, "Monthly Income", ("12k",)),
    (10, "Cell No", ("021-33",)),
    (11, "District", None),
    (11, "visit_date", ("31/31/2024",)),
    (12, "DA_UUID", None),
])
def test_reviews(cleaned, row, column, expected):
    assert review(cleaned, row, column) == expected


def test_records(cleaned):
    records = cleaned[2]
    assert records[0]["uuid"] == "10" and records[1]["uuid"] == "10__duplicate_row_3"
    assert records[2]["uuid"] == "ROW_4"
    assert [i for i, r in records.items() if r["is_dup"]] == [0, 1]
    assert [i for i, r in records.items() if r["is_dup_cnic"]] == [0, 1]
    assert records[0]["original_values"]["DA_UUID"] == " 10 "
    assert set(records[12]["original_values"]) == {"Donor Bank"}
    assert not any("_record" in r["manual_reviews"] for r in records.values())  # ids differ, so no equal rows


def test_counts_agree(cleaned):
    result, cells, records = cleaned
    row = result.summary().first()
    assert row["total_rows"] == len(ROWS)
    assert row["cells_auto_cleaned"] == sum(1 for c in cells.values() if c["steps"])
    assert row["cells_flagged"] == sum(1 for c in cells.values() if c["flagged"])
    assert row["rows_auto_cleaned"] == sum(1 for r in records.values() if r["cleaned_values"])
    assert row["rows_need_review"] == sum(1 for r in records.values() if r["manual_reviews"])
    by_step = {r["step"]: r["cells"] for r in result.step_breakdown().collect()}
    assert sum(by_step.values()) == sum(len(c["steps"].split(" | ")) for c in cells.values() if c["steps"])
    assert result.cleaned.count() == len(ROWS)


def test_key_column_is_honoured(spark):
    pack = RulePack(reference_year=2026)
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "-", "z")], "row_idx long, code string, note string")
    keyed = {r["row_idx"]: (r["uuid"], r["is_dup"]) for r in clean_dataset(df, pack, key_column="code").records().collect()}
    assert keyed == {0: ("a", False), 1: ("a__duplicate_row_3", False), 2: ("ROW_4", False)}
    plain = clean_dataset(df, pack, key_column="absent").records().collect()
    assert sorted(r["uuid"] for r in plain) == ["ROW_2", "ROW_3", "ROW_4"]


def test_empty_input_keeps_columns(spark):
    result = clean_dataset(table(spark, []), PACK)
    assert result.report().columns[0] == "uuid" and result.report().count() == 0
    assert result.summary().first()["total_rows"] == 0 and result.summary().first()["cells_flagged"] == 0


def test_all_default_rules_at_once(spark):
    names = [r.name for r in PACK.rules]
    values = ["y" if r.kind == "bool" else "1" for r in PACK.rules]
    df = spark.createDataFrame([(i, *values) for i in range(2)], "row_idx long, " + ", ".join(f"`{n}` string" for n in names))
    result = clean_dataset(df, PACK)
    first = result.cleaned.first()
    assert all(first[n] == "Yes" for n in names if next(r for r in PACK.rules if r.name == n).kind == "bool")
    assert result.review_by_column().where("column = '_record'").first()["cells"] == 2


@pytest.mark.parametrize("name, values, numeric, expected", [
    ("amount_due", 9, 9, None),  # too few values
    ("amount_due", 100, 0, None),  # all text under a number hint: share of offenders is not below a half
    ("amount_due", 100, 60, "number"), ("amount_due", 100, 50, None), ("x", 100, 85, "number"), ("x", 100, 84, None),
    ("owner", 100, 100, "text"),  # all numbers under a text hint
    ("x", 100, 100, None), ("x", 100, 5, "text"), ("x", 100, 6, None), ("village", 100, 0, None),  # "age" is in village
])
def test_type_intent(name, values, numeric, expected):
    assert quality.wanted_type(name, values, numeric, PACK) == expected


def test_hints_are_substrings():
    assert dates.date_candidates(["description", "population", "visit"], PACK) == ["visit"]
    assert dates.has_date_name("Opened At", PACK) and not dates.has_date_name("attic", PACK)
    assert normal_name("  Payment By - IFIs ") == "payment_by_ifis"


def test_labels_by_column_name():
    assert PACK.labels_for(ColumnRule("JH UC", "geo"))[0] == "Badin"
    assert PACK.labels_for(ColumnRule("Name of District", "geo"))[-1] == "Umerkot"
    assert PACK.labels_for(ColumnRule("planet", "geo")) == ()
    assert PACK.labels_for(ColumnRule("District", "geo", labels=("A",))) == ("A",)


def test_counts_need_no_pass_of_their_own(cleaned):
    result, cells, records = cleaned
    for df in (result.summary(), result.step_breakdown(), result.review_by_column()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" not in plan and "Exchange" not in plan
    by_column = {r["column"]: r["cells"] for r in result.review_by_column().collect()}
    assert by_column == {n: k for n in DEFAULTS if (k := sum(1 for (_, c), v in cells.items() if c == n and v["flagged"]))}


def test_counts_with_repeats_over_many_tasks(spark):
    """Flags of repeats come on top of others: rows flagged for both, or for one alone, count once each."""
    pack = RulePack(rules=(ColumnRule("id", "numeric", non_null=True, unique=True), ColumnRule("ok", "bool")), reference_year=2026)
    data = [(i, str(i // 2) if i % 5 else "x7", "maybe" if i % 3 == 0 else "yes", f"n{i % 40}") for i in range(400)]
    df = spark.createDataFrame(data, "row_idx long, id string, ok string, note string").repartition(7)
    result = clean_dataset(df, pack)
    cells = result.tracked.cells().collect()
    records = result.records().collect()
    row = result.summary().first()
    repeated = sum(1 for r in records if "_record" in r["manual_reviews"])
    assert row["cells_flagged"] == sum(c["flagged"] for c in cells) + repeated
    assert row["rows_need_review"] == sum(1 for r in records if r["manual_reviews"])
    assert row["rows_auto_cleaned"] == sum(1 for r in records if r["cleaned_values"])
    assert row["duplicate_uuid_rows"] == sum(r["is_dup"] for r in records) > 0


def test_report_text_is_that_of_the_maps(spark):
    """JSON put together as text is what the JSON writer makes of the maps, whatever the values hold."""
    odd = ['say "x"', "back\\slash", "tab\tline\nreturn\r\x01\x1f", "é漢😀\u2028/<&>'", "", " ", None, "n/a", "\x7f\x85", "{a: [1]}"]
    names = ["da_uuid", 'a "quoted" name', "näme"]
    df = spark.createDataFrame([(i, str(i % 4), v, f" {v} ") for i, v in enumerate(odd)], ", ".join(["row_idx long", *[f"`{n}` string" for n in names]]))
    result = clean_dataset(df, RulePack(rules=(ColumnRule("da_uuid", "numeric", unique=True),)))
    texts = {r["uuid"]: r for r in result.report().collect()}
    maps = ("original_values", "cleaned_values", "manual_reviews")
    for r in result.records().select("uuid", *[F.to_json(m).alias(m) for m in maps]).collect():
        assert all(texts[r["uuid"]][m] == r[m] for m in maps)
