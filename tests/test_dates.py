import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washboard.functions import dates as D
from washboard.operators import dates as date_ops
from washboard.operators.tracked import TrackedFrame
from washboard.rules import default_pack

TEXTS = """2024-01-15|2024/1/5|2024.01.05|2024-13-01|13/02/2024|02/13/2024|31/31/2024|1/5/2023|1.5.2023|13/2/75
01/2024|13/2024|2024-01|2024/05|2024|99|12|45|20240115|20241315|202401|15 Jan 2010|15 January 2010|15-Jan-2010|15Jan2010
Jan 15, 2010|Jan 15 2010|January 15, 2010|Jan 15th, 2010|15th January 2010|Jan 2010|Sat, 13 Jan 2024
Saturday 13 January 2024|2024-01-15 10:30|2024-01-15T10:30:45|2024-01-15 10:30:45.123|2024-01-15 25:00
1/5/2023 10:30 AM|1/5/2023 10:30PM|13/2/2024 1:02:03|hello|January|Monday|may 5|12k|25,3|25.3960|91.5|-999|1234|12345
123456|1234567|0000|1000|3000|1900|31/12/1899|2024-02-30|30 Feb 2024|29/02/2023|Sept 5 2020|5 Sept 2020|2020 Jan 5
2020-Jan-05|05-2020-01|2024Q1|1Q2024|2001/13/14|2024 01 15|01 15 2024|15 01 2024|15,01,2024|July 4 1776|1/1/0001
12/31/1600|10/10/2300|Sept 5, 2020 3:04 pm""".replace("\n", "|").split("|")


def test_dates_agree_with_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", D.format_mdy(D.parse_mixed("t", 2026)).alias("d"))
    found = {r["t"]: r["d"] for r in df.collect()}
    for text in TEXTS:
        parsed = pd.to_datetime(pd.Series([text], dtype=object), errors="coerce", format="mixed").iloc[0]
        assert found[text] == (None if pd.isna(parsed) else parsed.strftime("%m/%d/%Y")), text


@pytest.mark.parametrize("text, year, day", [
    ("1/5/75", 2026, "01/05/2075"), ("1/5/76", 2026, "01/05/1976"), ("1/5/99", 2026, "01/05/1999"),
    ("1/5/99", 2060, "01/05/2099"), ("10:30", 2026, None), ("10:30 am", 2026, None),
])
def test_short_years_and_times(spark, text, year, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(D.format_mdy(D.parse_mixed("t", year))).first()[0] == day


def test_signals_in_unicode_text(spark):
    # digits of other scripts and spaces beyond ASCII count, as they do in the published patterns
    expected = {
        "\u0661\u0665/\u0660\u0661/\u0662\u0660\u0662\u0664": (True, False), "15\u00a0Jan\u00a02024": (True, False),
        "due 2024-1-5.": (True, False), "x2024-1-5": (False, False), "\u06f1\u06f0:\u06f4\u06f5": (False, True), "\u00a010:45\u2003pm": (False, True),
        "10:45": (False, True), "10:4": (False, False), "\u00e92024-01-05": (False, False),
    }
    df = spark.createDataFrame([(t,) for t in expected], "t string").select("t", D.has_date_signal("t").alias("s"), D.is_time_only("t").alias("o"))
    assert {r["t"]: (r["s"], r["o"]) for r in df.collect()} == expected


def test_date_step_is_small_enough_for_the_jit(spark):
    # methods beyond 8,000 bytes are interpreted
    df = spark.range(3).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("day"))
    step = date_ops.standardize_dates(TrackedFrame.begin(df), ["day"], default_pack(reference_year=2026))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", step.df._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000
