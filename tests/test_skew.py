"""Large or lopsided groups: the ways taken when a table is not small must give the same rows."""

from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from washboard.operators import banks, canonical, cells, keys, lookup
from washboard.operators.tracked import TrackedFrame
from washboard.plans import queries
from washboard.plans.clean import clean_dataset
from washboard.plans.fixtures import dirty, dirty_pack
from washboard.session import stage


def _lopsided(spark, n=3000):
    """A third of the rows share one key, a tenth have none, the rest come in pairs or alone."""
    key = (
        F.when(F.col("row_idx") % 3 == 0, "hot").when(F.col("row_idx") % 10 == 1, None)
        .when(F.col("row_idx") % 2 == 0, F.concat(F.lit("pair"), (F.col("row_idx") % 500).cast("string")))
        .otherwise(F.col("row_idx").cast("string"))
    )
    return spark.range(n).withColumnRenamed("id", "row_idx").withColumn("key", key)


def test_hot_groups_are_complete(spark):
    table = _lopsided(spark)
    data = rows(table)
    counts = Counter(k for _, k in data if k is not None)
    expected = sorted((i, counts[k]) for i, k in data if k is not None and counts[k] > 1)
    for limit in (1, 5, 100_000):
        found = keys.rows_with_repeated_key(table, ["key"], limit=limit)
        assert sorted(rows(found, "row_idx", "n")) == expected, limit


def test_first_rows(spark):
    groups = keys.repeated_keys(_lopsided(spark), ["key"])
    assert {r["key"]: r["first_row"] for r in groups.collect()}["hot"] == 0


def test_flags_join_without_broadcast(spark):
    table = _lopsided(spark)
    flags = stage(table.where("key = 'hot'").select("row_idx", F.lit(True).alias("hot")), "test")
    small = lookup.left_by_row(table, flags, "row_idx")
    large = lookup.left_by_row(table, flags, "row_idx", limit=0)
    assert sorted(rows(small.na.fill(False), "row_idx", "hot")) == sorted(rows(large.na.fill(False), "row_idx", "hot"))


def test_long_keys_stay_distinct(spark):
    values = ["x" * 64, "x" * 65, "x" * 66, "#" + "x" * 10, None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(lookup.bounded_key(F.col("v")).alias("k"))
    found = [r["k"] for r in df.collect()]
    assert found[-1] is None and len(set(found)) == 5 and max(len(k) for k in found if k) <= 65


def test_large_maps_give_the_same_rows(spark, sf_dir, monkeypatch):
    pack = dirty_pack()
    t = cells.apply_rules(cells.null_standardize(cells.trim_whitespace(TrackedFrame.begin(dirty(spark, sf_dir)))), pack)

    def run():
        labels, names = canonical.decide_labels(t, pack), banks.decide_banks(t, pack)
        out = banks.standardize_banks(canonical.canonicalize(t, pack, labels), pack, names)
        return labels, sorted(rows(out.cells()), key=str)

    broadcast, first = run()
    assert broadcast.small
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    shuffled, second = run()
    assert not shuffled.small
    assert first == second


def test_only_distinct_values_are_scored(spark, sf_dir):
    """One scorer in the plan, and above the aggregate that finds the distinct values."""
    pack = dirty_pack()
    t = cells.apply_rules(TrackedFrame.begin(dirty(spark, sf_dir)), pack)
    for scored in (canonical.score_labels(t, pack), banks.score_banks(t, pack)):
        lines = scored._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
        aggregates = [i for i, line in enumerate(lines) if "HashAggregate" in line]
        assert len(depth) == 1 and aggregates and depth[0] < min(aggregates)


def test_hot_groups_are_cut_without_a_sort(spark):
    table = _lopsided(spark)
    plan = keys.rows_with_repeated_key(table, ["key"], limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan


def test_same_row_many_times(spark):
    """Half of the rows are one row; every copy is flagged, in one record each."""
    data = [(i, "7", "same text") if i % 2 else (i, str(i), f"text {i}") for i in range(400)]
    df = spark.createDataFrame(data, "row_idx long, da_uuid string, note string")
    result = clean_dataset(df, dirty_pack())
    records = result.records()
    assert records.where("map_contains_key(manual_reviews, '_record')").count() == 200
    assert records.select("uuid").distinct().count() == 400
    assert records.where("uuid = '7'").count() == 1
    assert result.summary().first()["duplicate_uuid_rows"] == 200


def test_rows_are_dealt_before_they_are_made(spark, sf_dir, monkeypatch):
    # one split makes all rows in one task, and moves fourteen texts where five columns do
    monkeypatch.setattr(queries, "clean_dataset", lambda rows, pack: rows)
    plan = queries._clean(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("Exchange")
