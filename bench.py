"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder with the Parquet tables, ``BENCH_CPUS`` the number of local threads. The
``*_x100`` queries run over the dirty table widened a hundredfold.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from washboard.operators import canonical, cells, keys, report  # noqa: E402
from washboard.operators.tracked import TrackedFrame  # noqa: E402
from washboard.plans.clean import clean_dataset  # noqa: E402
from washboard.plans.fixtures import dirty, dirty_pack  # noqa: E402
from washboard.plans.queries import REGISTRY  # noqa: E402
from washboard.session import build_session, new_path, stage  # noqa: E402
from washboard.sinks import outputs  # noqa: E402

WIDEN = 100


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def widened(spark, folder: str):
    """The dirty rows a hundred times under new ids, as a stored table."""
    copies = dirty(spark, folder).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(WIDEN - 1))))
    shift = F.col("copy") * 10_000_000
    rows = copies.withColumn("row_idx", F.col("row_idx") + shift).withColumn(
        "da_uuid", F.when(F.trim("da_uuid").rlike("^[0-9]+$"), (F.trim("da_uuid").cast("bigint") + shift).cast("string")).otherwise(F.col("da_uuid"))
    ).drop("copy")
    return stage(rows.repartition(32, "row_idx"), "bench-dirty")


def misspelt(wide):
    """District texts in 100,000 distinct spellings."""
    tail = F.conv((F.col("row_idx") % 100_000).cast("string"), 10, 36)
    return stage(wide.select("row_idx", F.concat(F.coalesce("district", F.lit("x")), F.lower(tail)).alias("district")), "bench-misspelt")


def stored_report(spark, folder):
    """A report of all order lines, written in order."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    uuid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("uuid")
    maps = [F.to_json(F.create_map(F.lit("status"), F.col("l_linestatus"))).alias(c) for c in report.JSON_COLUMNS]
    rows = lines.select(uuid, *maps, F.lit(False).alias("is_dup"), F.lit(False).alias("is_dup_cnic"))
    target = outputs.route_output(new_path(spark, "bench-report"), "banks")
    outputs.write_report(rows, target)
    return outputs.read_report(spark, target), outputs.read_report_index(spark, target)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    pack = dirty_pack()
    wide = widened(spark, folder)

    def trimmed(df):
        return cells.null_standardize(cells.trim_whitespace(TrackedFrame.begin(df)), pack)

    def labels(df):
        t = cells.apply_rules(trimmed(df), pack)
        return canonical.canonicalize(t, pack, canonical.decide_labels(t, pack)).df

    registered = {
        name: (lambda query=REGISTRY[key]: query(spark, folder))
        for name, key in (
            ("clean_dataset", "clean_dataset"), ("clean_summary", "clean_summary"), ("duplicate_keys", "duplicate_keys"),
            ("fuzzy_canonical", "fuzzy_canonical"), ("page_by_offset", "page_by_offset"), ("sort_report", "sort_report"),
            ("trim_whitespace", "trim_whitespace"), ("title_case", "title_case"), ("date_standardize", "date_standardize"),
            ("record_key", "record_key"), ("scan_csv_text", "scan_csv_text"),
        )
    }
    spelt, (paged, index) = misspelt(wide), stored_report(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    line_keys = lines.select(F.monotonically_increasing_id().alias("row_idx"), F.col("l_orderkey").cast("string").alias("key"))
    runs = {
        **registered,
        "clean_report_x100": lambda: clean_dataset(wide, pack).report(),
        "duplicate_keys_x100": lambda: keys.rows_with_repeated_key(wide.select("row_idx", "da_uuid"), ["da_uuid"]),
        "fuzzy_canonical_x100": lambda: labels(wide),
        "row_steps_x100": lambda: cells.apply_rules(trimmed(wide), pack).df,
        "score_100k_distinct": lambda: canonical.score_labels(TrackedFrame.begin(spelt), pack),
        "repeated_keys_many": lambda: keys.rows_with_repeated_key(line_keys, ["key"], limit=1000),
        "page_deep_stored": lambda: report.page_by_offset(paged, 5_000, 100),
        "page_cursor_stored": lambda: report.page_by_cursor(paged, report.encode_cursor("300001"), 100, index),
    }
    consume(registered["clean_dataset"]())  # warm up
    seconds = {}
    for name, run in runs.items():
        start = time.perf_counter()
        consume(run())
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"), "widened_rows": wide.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
