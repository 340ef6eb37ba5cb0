"""Dirty input derived from the given tables, in SQL that Spark and DuckDB read alike, and the rules for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washboard import domain
from washboard.rules import ColumnRule, RulePack, default_pack

DIRTY_SQL = """
SELECT
  c_custkey AS row_idx,
  CASE WHEN c_custkey % 97 = 0 THEN ' - '
       WHEN c_custkey % 41 = 0 THEN CAST(c_custkey + 1 AS STRING)
       WHEN c_custkey % 53 = 0 THEN concat('ID-', CAST(c_custkey AS STRING))
       ELSE concat(' ', CAST(c_custkey AS STRING)) END AS da_uuid,
  CASE WHEN c_custkey % 29 = 0 THEN 'n/a'
       WHEN c_custkey % 31 = 0 THEN '1111111111111'
       WHEN c_custkey % 37 = 0 THEN '4.220112345678E+12'
       WHEN c_custkey % 43 = 0 THEN '42201-123'
       ELSE concat('42201-', lpad(CAST((c_custkey * 7919) % 10000000 AS STRING), 7, '0'), '-', CAST(c_custkey % 10 AS STRING)) END AS da_cnic,
  CASE c_custkey % 6
       WHEN 0 THEN concat('+92 3', lpad(CAST(c_custkey AS STRING), 9, '0'))
       WHEN 1 THEN concat('00923', lpad(CAST(c_custkey AS STRING), 9, '0'))
       WHEN 2 THEN concat('03', lpad(CAST(c_custkey AS STRING), 9, '0'))
       WHEN 3 THEN concat('3', lpad(CAST(c_custkey AS STRING), 9, '0'))
       WHEN 4 THEN concat('021-', CAST(c_custkey AS STRING))
       ELSE concat('0300-', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS cell_no,
  CASE c_custkey % 8
       WHEN 0 THEN 'hyderabad' WHEN 1 THEN '  Hyderbad ' WHEN 2 THEN 'KARACHI   EAST'
       WHEN 3 THEN 'Tando Muhamad Khan' WHEN 4 THEN 'Thatta*' WHEN 5 THEN 'Shaheed Benazirabad'
       WHEN 6 THEN 'Atlantis' ELSE '--' END AS district,
  CASE c_custkey % 5 WHEN 0 THEN concat('house #', CAST(c_nationkey AS STRING), ', o''neil st.')
       WHEN 1 THEN concat(lower(c_mktsegment), '   colony @', CAST(c_nationkey AS STRING))
       ELSE c_name END AS address,
  CASE c_custkey % 7 WHEN 0 THEN 'collapsed' WHEN 1 THEN 'WASHEDAWAY' WHEN 2 THEN 'Colapsed'
       WHEN 3 THEN 'visible' WHEN 4 THEN 'nil' WHEN 5 THEN 'Intact' ELSE 'demolished' END AS damage_category,
  CASE c_custkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'Third-Gender'
       WHEN 3 THEN 'Male' WHEN 4 THEN 'x' ELSE 'N/A' END AS gender,
  CASE c_custkey % 6 WHEN 0 THEN 'y' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'Yes'
       WHEN 3 THEN 'not available' WHEN 4 THEN 'maybe' ELSE 'none' END AS widow,
  CASE WHEN c_custkey % 19 = 0 THEN '91.5' WHEN c_custkey % 23 = 0 THEN '25,3' ELSE '25.3960' END AS lat,
  CASE WHEN c_custkey % 17 = 0 THEN '12k' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END AS monthly_income,
  CASE c_custkey % 8 WHEN 0 THEN 'hbl' WHEN 1 THEN 'Habib Bank Ltd' WHEN 2 THEN 'b.o.p'
       WHEN 3 THEN 'Meezan Bank' WHEN 4 THEN 'Habib Bank Limited' WHEN 5 THEN 'national-bank'
       WHEN 6 THEN 'Allied Ltd' ELSE 'Some Other Bank' END AS payment_by_ifis,
  CASE c_custkey % 5 WHEN 0 THEN concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-15')
       WHEN 1 THEN concat('15 Jan ', CAST(2000 + c_custkey % 20 AS STRING))
       WHEN 2 THEN concat(CAST(1 + c_custkey % 12 AS STRING), '/5/2023')
       WHEN 3 THEN '13/02/2024' ELSE '31/31/2024' END AS created_date,
  CASE WHEN c_custkey % 50 = 0 THEN '777' ELSE c_mktsegment END AS segment_name
FROM customer
"""

# Date texts in several shapes; the day-first ones are ambiguous on purpose.
DATE_TEXT_SQL = """
SELECT o_orderkey AS row_idx,
  CASE o_orderkey % 7
       WHEN 0 THEN substr(d, 1, 10)
       WHEN 1 THEN concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 1, 4))
       WHEN 2 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
       WHEN 3 THEN concat(substr(d, 9, 2), ' Mar ', substr(d, 1, 4))
       WHEN 4 THEN concat(substr(d, 1, 4), substr(d, 6, 2), substr(d, 9, 2))
       WHEN 5 THEN concat(substr(d, 6, 2), '-', substr(d, 9, 2), '-', substr(d, 3, 2), ' 10:45 PM')
       ELSE o_orderpriority END AS order_text
FROM (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS STRING) AS d FROM orders) AS t
"""

# Texts that are times, dates with times, or neither.
TIME_TEXT_SQL = """
SELECT event_id,
  CASE event_id % 4
       WHEN 0 THEN substr(CAST(ts AS STRING), 12, 5)
       WHEN 1 THEN concat(' ', substr(CAST(ts AS STRING), 12, 8), ' pm')
       WHEN 2 THEN substr(CAST(ts AS STRING), 1, 16)
       ELSE event_type END AS time_text
FROM events
"""

# A stored report of an older version: text flags, no validation columns, one record per event.
OLD_REPORT_SQL = """
SELECT CAST(event_id AS STRING) AS uuid, props AS original_values,
  CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN ' ' WHEN 2 THEN 'null' ELSE props END AS cleaned_values,
  CASE event_id % 3 WHEN 0 THEN '' ELSE props END AS manual_reviews,
  CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN '1' ELSE 'false' END AS is_dup
FROM events
"""

LABELS = ("Collapsed", "WashedAway", "Visible", "Intact")


def dirty_pack() -> RulePack:
    """Rules for the columns of ``DIRTY_SQL``; the year is fixed so that results do not move with the clock."""
    return default_pack(reference_year=2026).with_rules(
        ColumnRule("da_uuid", "numeric", non_null=True, unique=True),
        ColumnRule("da_cnic", "cnic", non_null=True, unique=True),
        ColumnRule("cell_no", "cell_no"),
        ColumnRule("district", "geo", casing="title"),
        ColumnRule("address", casing="title", special_chars_ok=True),
        ColumnRule("damage_category", casing="title", labels=LABELS),
        ColumnRule("gender", "gender"),
        ColumnRule("widow", "bool"),
        ColumnRule("lat", "float", bounds=domain.LAT_BOUNDS),
        ColumnRule("monthly_income", "numeric"),
        ColumnRule("payment_by_ifis", casing="upper"),
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_sql(spark: SparkSession, folder: str, sql: str, name: str, deal_by: str | None = None) -> DataFrame:
    """Run one of the texts above over the table it reads, dealt out to all cores by the column ``deal_by``."""
    view = f"washboard_{name}"
    rows = table(spark, folder, name)
    if deal_by:
        rows = rows.repartition(spark.sparkContext.defaultParallelism, deal_by)
    rows.createOrReplaceTempView(view)
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))


def dirty(spark: SparkSession, folder: str, deal: bool = False) -> DataFrame:
    return from_sql(spark, folder, DIRTY_SQL, "customer", "c_custkey" if deal else None)


def dirty_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty rows plus a copy of every hundredth one, under other row numbers."""
    rows = dirty(spark, folder)
    copies = rows.where("row_idx % 100 = 0").withColumn("row_idx", F.col("row_idx") + 1000000)
    return rows.unionByName(copies)
