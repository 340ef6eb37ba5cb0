"""One query per operator, over whole tables. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions import dates as D
from washboard.functions import numbers as N
from washboard.functions import similarity as S
from washboard.functions import text as T
from washboard.operators import banks, canonical, cells, keys, quality, report
from washboard.operators import dates as date_ops
from washboard.operators.lookup import distinct_cells, left_by_row
from washboard.operators.tracked import ROW_COLUMN, TrackedFrame, step_array
from washboard.plans.clean import CleanResult, clean_dataset, first_steps
from washboard.plans.fixtures import (
    DATE_TEXT_SQL, OLD_REPORT_SQL, TIME_TEXT_SQL, dirty, dirty_pack, dirty_with_copies, from_sql, table,
)
from washboard.session import new_path, stage
from washboard.sinks import outputs
from washboard.sources import csv, row_index

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

NUMBER_COLUMNS = ("da_uuid", "cell_no", "lat", "monthly_income")
TOKEN_COLUMNS = ("da_uuid", "da_cnic", "district", "damage_category", "gender", "widow")


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# ---- shared starting points ---------------------------------------------------------------------


def _begin(spark, folder) -> TrackedFrame:
    return TrackedFrame.begin(dirty(spark, folder))


def _nulled(spark, folder) -> TrackedFrame:
    """Dirty rows after the trim and null steps, without their history."""
    t = cells.null_standardize(cells.trim_whitespace(_begin(spark, folder)), dirty_pack())
    return TrackedFrame.begin(t.cleaned())


def _documents(spark, folder) -> TrackedFrame:
    return TrackedFrame.begin(table(spark, folder, "documents").select("doc_id", "text"), row="doc_id")


def _rule(name: str):
    return next(r for r in dirty_pack().rules if r.name == name)


def _clean(spark, folder) -> CleanResult:
    # the test tables are one split each; a caller deals rows out to as many tasks as suit the cluster
    return clean_dataset(dirty(spark, folder, deal=True), dirty_pack())


def _column(t: TrackedFrame, name: str) -> DataFrame:
    """Outcome of one column: value, steps, flag and review value."""
    return t.df.select(
        ROW_COLUMN, t.value(name).alias("value"), (t.mask(name) != 0).alias("changed"),
        t.flagged(name).alias("flagged"), t.review_value(name).alias("review_value"),
    )


def _orders_report(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("uuid"), F.col("o_orderstatus").alias("cleaned_values")
    )


def _stored_orders(spark, folder):
    """The report of the orders, written once, and its index."""
    target = outputs.route_output(new_path(spark, "out"), "banks")
    outputs.write_report(_orders_report(spark, folder), target)
    return outputs.read_report(spark, target), outputs.read_report_index(spark, target)


def _events_report(spark, folder) -> DataFrame:
    return from_sql(spark, folder, OLD_REPORT_SQL, "events")


# ---- sources and sinks --------------------------------------------------------------------------


@query
def scan_csv_text(spark, folder):
    path = new_path(spark, "csv")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    (docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return csv.scan_csv_text(spark, path, na=())


@query
def csv_encoding_ladder(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    # what is not English goes to Latin-1 if that holds it in bytes that are not valid UTF-8, so that no file of it is taken for UTF-8;
    # all else goes to UTF-8, nulls included
    beyond = r"[^\x00-\x7F\xA0-\xFF]"
    broken = r"[\xC2-\xF4](?![\xA0-\xBF])|[\xF5-\xFF]|(?<![\xA0-\xFF])[\xA0-\xC1]"
    held = F.col("text").rlike(broken) & ~F.col("text").rlike(beyond) & ~F.coalesce("lang", F.lit("")).rlike(beyond)
    latin = ~F.col("lang").eqNullSafe("en") & F.coalesce(held, F.lit(False))
    paths = []
    for charset, part in (("UTF-8", docs.where(~latin)), ("ISO-8859-1", docs.where(latin))):
        paths.append(new_path(spark, "charset"))
        (part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("encoding", charset).csv(paths[-1]))
    return csv.scan_csv_text(spark, paths, na=())


@query
def csv_na_load(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[T.na_on_load(c).alias(c) for c in TOKEN_COLUMNS])


@query
def read_report(spark, folder):
    target = outputs.write_outputs(_clean(spark, folder), new_path(spark, "out"), "beneficiary", "North")
    return report.report_defaults(outputs.read_report(spark, target)).select(
        "uuid", "is_dup", "is_dup_cnic", "validation_result"
    )


@query
def read_cleaned(spark, folder):
    target = outputs.route_output(new_path(spark, "out"), " Financials ")
    _nulled(spark, folder).cleaned().drop(ROW_COLUMN).write.option("header", True).csv(target.path("cleaned", "csv"))
    return outputs.read_cleaned(spark, target)


@query
def list_outputs(spark, folder):
    root = new_path(spark, "out")
    _write_by_region(spark, folder, root)
    listed = outputs.list_outputs(spark, root)
    megabytes = F.round(F.sum("length") / outputs.MEGABYTE, 2).alias("stored_mb")
    stored = outputs.part_files(spark, root).select(F.regexp_extract("path", r"/stem=([^/]+)/[^/]+$", 1).alias("s"), "length")
    stored = stored.groupBy("s").agg(megabytes)
    joined = listed.join(stored, F.col("stem") == F.col("s"), "left")
    return joined.select("data_type", "ip_name", "stem", "file", (F.col("size_mb") == F.col("stored_mb")).alias("size_right"))


def _write_by_region(spark, folder, root):
    """One small report per region, each under its own ip name, and one for the banks, all in one write."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    uuid = F.col("s_name").alias("uuid")
    by_region = suppliers.select(uuid, F.lit("beneficiary").alias("data_type"), F.col("r_name").alias("ip_name"))
    outputs.write_reports(by_region.unionByName(suppliers.select(uuid, F.lit("Banks").alias("data_type"), F.lit(None).cast("string").alias("ip_name"))), root)


@query
def route_output(spark, folder):
    root = new_path(spark, "out")
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("uuid"), "n_regionkey")
    counts = []
    for data_type, ip_name, rows in (
        ("certificates", "North", nations.where("n_regionkey < 2")),
        (" Beneficiary ", "North", nations.where("n_regionkey >= 2")),
        ("banks", None, nations), ("financials", None, nations.where("n_regionkey = 0")),
    ):
        target = outputs.route_output(root, data_type, ip_name)
        outputs.write_report(rows, target)
        counts.append((target.data_type, target.stem, target.folder, target))
    # banks and financials share one place, so both read what was written last
    parts = [
        outputs.read_report(spark, target).agg(F.count("*").alias("rows")).select(
            F.lit(data_type).alias("data_type"), F.lit(stem).alias("stem"), F.lit(place).alias("folder"), "rows")
        for data_type, stem, place, target in counts
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def dataset_profile(spark, folder):
    profile = csv.dataset_profile(dirty(spark, folder), exclude=(ROW_COLUMN,))
    return profile.withColumn("columns", F.concat_ws(",", "columns"))


@query
def row_index_by_order(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    numbered = row_index.by_order(orders, "o_orderdate", "o_orderkey")
    return numbered.select("o_orderkey", ROW_COLUMN, keys.row_label(F.col(ROW_COLUMN)).alias("label"))


REGISTRY["row_index"] = REGISTRY.pop("row_index_by_order")


@query
def write_cleaned(spark, folder):
    target = outputs.route_output(new_path(spark, "out"), "banks")
    outputs.write_cleaned(_nulled(spark, folder).cleaned(), target)
    return outputs.read_cleaned(spark, target)


@query
def write_report(spark, folder):
    target = outputs.route_output(new_path(spark, "out"), "certificates", "North")
    outputs.write_report(_clean(spark, folder).report(), target)
    stored = report.decode_report(report.report_defaults(outputs.read_report(spark, target)))
    exploded = stored.select("uuid", "is_dup", "is_dup_cnic", F.explode("cleaned_values").alias("column", "change"))
    return exploded.select(
        "uuid", "is_dup", "is_dup_cnic", "column", F.get("change", F.lit(0)).alias("new_value"), F.get("change", F.lit(1)).alias("steps")
    )


@query
def output_sizes(spark, folder):
    target = outputs.route_output(new_path(spark, "out"), "banks")
    outputs.write_cleaned(_begin(spark, folder).cleaned(), target)
    outputs.write_report(_events_report(spark, folder), target)
    sizes = outputs.output_sizes(spark, target)
    # sizes depend on the writer, so they are held against the stored files here
    files = outputs.part_files(spark, f"{target.root}/{target.folder}")

    def stored(kind: str):
        length = F.when(F.contains("path", F.lit(f"_{kind}.parquet/")), F.col("length")).otherwise(0)
        return F.round(F.sum(length) / outputs.MEGABYTE, 2)

    one = files.agg(stored("cleaned").alias("cleaned"), stored("report").alias("report")).first()
    total = F.abs(F.col("total_size_mb") - F.col("cleaned_size_mb") - F.col("report_size_mb")) < 0.001
    return sizes.select(
        (F.col("cleaned_size_mb") == one["cleaned"]).alias("cleaned_size_right"),
        (F.col("report_size_mb") == one["report"]).alias("report_size_right"), total.alias("total_size_right"),
    )


@query
def write_result_json(spark, folder):
    records = _clean(spark, folder).records()
    path = outputs.write_result_json(records, new_path(spark, "json"), "dirty rows", datetime(2024, 1, 1))
    lines = spark.read.text(path)
    record = "struct<original_values:map<string,string>,`IS DUPLICATED UUID`:boolean>"
    parsed = lines.select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("uuid", "record"))
    return parsed.select(
        "uuid", F.size("record.original_values").alias("touched"), F.col("record.`IS DUPLICATED UUID`").alias("is_dup")
    )


@query
def latest_results(spark, folder):
    root = new_path(spark, "json")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("uuid"), "o_orderstatus",
        F.create_map(F.lit("total"), F.col("o_totalprice").cast("string")).alias("original_values"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("cleaned_values"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("manual_reviews"),
        F.lit(False).alias("is_dup"), F.lit(False).alias("is_dup_cnic"),
    )
    # one row per status
    for i, status in enumerate(sorted((r["o_orderstatus"] for r in orders.select("o_orderstatus").distinct().collect()), key=str)):
        part = orders.where(F.col("o_orderstatus").eqNullSafe(status))
        outputs.write_result_json(part, root, f"orders {status}", datetime(2024, 1, 1) + timedelta(days=i))
    newest = outputs.latest_results(spark, root)
    stored = outputs.part_files(spark, root).select(F.regexp_extract("path", r"([^/]+\.json)/[^/]+$", 1).alias("f"), "length")
    stored = stored.groupBy("f").agg(F.round(F.sum("length") / 1024, 1).alias("stored_kb"))
    joined = newest.join(stored, F.col("file_name") == F.col("f"), "left")
    # written one after the other, so the newest has the last place in the order of the names
    place = F.row_number().over(Window.orderBy(F.desc("modified_at"), F.desc("file_name"))).alias("place")
    return joined.select("file_name", (F.col("size_kb") == F.col("stored_kb")).alias("size_right"), place)


# ---- predicates and projections -----------------------------------------------------------------


@query
def null_mask(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[T.null_like(c).alias(c) for c in TOKEN_COLUMNS])


@query
def numeric_signed(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[N.is_number(T.strip_ws(c)).alias(c) for c in NUMBER_COLUMNS])


@query
def numeric_unsigned(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[N.is_unsigned_number(T.strip_ws(c)).alias(c) for c in NUMBER_COLUMNS])


@query
def date_signal(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[D.has_date_signal(c).alias(c) for c in ("created_date", "address", "da_cnic")])


@query
def time_only(spark, folder):
    rows = from_sql(spark, folder, TIME_TEXT_SQL, "events")
    return rows.select("event_id", D.is_time_only("time_text").alias("time_only"))


@query
def sci_notation(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[N.is_scientific(c).alias(c) for c in ("da_cnic", "monthly_income")])


@query
def repeat_digit(spark, folder):
    return dirty(spark, folder).select(ROW_COLUMN, N.is_repeated_digit(T.digits_only("da_cnic")).alias("repeated"))


@query
def fake_id(spark, folder):
    return dirty(spark, folder).select(ROW_COLUMN, N.is_fake_id(T.digits_only("da_cnic")).alias("fake"))


@query
def coord_out_of_bounds(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(
        ROW_COLUMN, N.out_of_bounds("lat", domain.LAT_BOUNDS).alias("lat"),
        N.out_of_bounds("monthly_income", domain.LON_BOUNDS).alias("lon"),
    )


@query
def touched_originals(spark, folder):
    t = first_steps(dirty(spark, folder), dirty_pack())
    return t.df.select(ROW_COLUMN, F.explode(t.touched_originals()).alias("column", "original"))


@query
def report_defaults(spark, folder):
    return report.report_defaults(_events_report(spark, folder)).drop("original_values")


# ---- cleaning steps -----------------------------------------------------------------------------


@query
def trim_whitespace(spark, folder):
    return _column(cells.trim_whitespace(_documents(spark, folder)), "text").select(ROW_COLUMN, "value", "changed")


@query
def null_standardize(spark, folder):
    t = cells.null_standardize(cells.trim_whitespace(_begin(spark, folder)), dirty_pack())
    return t.cells()


@query
def strip_special_chars(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.strip_special("text").alias("strict"), T.strip_special("text", safe=True).alias("safe"))


@query
def title_case(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.title_case(T.strip_special("text", safe=True)).alias("value"))


@query
def upper_case(spark, folder):
    t = cells.apply_casing(_nulled(spark, folder), [_rule("payment_by_ifis")], dirty_pack())
    return _column(t, "payment_by_ifis").select(ROW_COLUMN, "value", "changed")


def _checked(name: str) -> Query:
    def run(spark, folder):
        return _column(cells.check_values(_nulled(spark, folder), [_rule(name)], dirty_pack()), name)
    return run


for _key, _name in (
    ("bool_standardize", "widow"), ("gender_standardize", "gender"), ("phone_normalize", "cell_no"),
    ("numeric_check", "monthly_income"), ("coord_check", "lat"),
):
    REGISTRY[_key] = _checked(_name)


def _with_repeats(spark, folder, name):
    """An id column with its repeats flagged, then checked."""
    rows = dirty(spark, folder).select(ROW_COLUMN, name)
    pack = dirty_pack().with_rules(_rule(name))
    t = first_steps(rows, pack)
    t = cells.check_values(t, [_rule(name)], pack)
    t = keys.apply_flags(t, pack, keys.decide_flags(t, pack)[0])
    return _column(t, name).join(t.df.select(ROW_COLUMN, "is_dup", "is_dup_cnic"), ROW_COLUMN)


@query
def cnic_standardize(spark, folder):
    return _with_repeats(spark, folder, "da_cnic").drop("is_dup")


@query
def id_check(spark, folder):
    return _with_repeats(spark, folder, "da_uuid").drop("is_dup_cnic")


def _canonical(spark, folder, name):
    pack = dirty_pack().with_rules(_rule(name))
    t = cells.apply_rules(TrackedFrame.begin(_nulled(spark, folder).cleaned().select(ROW_COLUMN, name)), pack)
    t = canonical.canonicalize(t, pack, canonical.decide_labels(t, pack))
    return _column(t, name)


@query
def geo_standardize(spark, folder):
    return _canonical(spark, folder, "district")


@query
def category_standardize(spark, folder):
    return _canonical(spark, folder, "damage_category")


@query
def date_detect(spark, folder):
    pack, t = dirty_pack(), _nulled(spark, folder)
    names = date_ops.date_candidates(t.names, pack)
    rates = date_ops.rates_of(date_ops.head_per_column(t, pack, names), pack)
    name = F.try_element_at(F.array(*[F.lit(n) for n in t.names]), F.col("slot") + 1)
    hinted = F.col("column").isin(*[n for n in names if date_ops.has_date_name(n, pack)])
    accepted = date_ops.is_date_column(hinted, F.col("time_rate"), F.col("signal_rate"), F.col("parse_rate"))
    return rates.withColumn("column", name).withColumn("accepted", accepted).drop("slot")


@query
def date_standardize(spark, folder):
    t = TrackedFrame.begin(from_sql(spark, folder, DATE_TEXT_SQL, "orders"))
    pack = dirty_pack()
    return _column(date_ops.standardize_dates(t, date_ops.decide_dates(t, pack), pack), "order_text")


@query
def bank_standardize(spark, folder):
    pack = dirty_pack()
    t = TrackedFrame.begin(_nulled(spark, folder).cleaned().select(ROW_COLUMN, "payment_by_ifis"))
    return _column(banks.standardize_banks(t, pack, banks.decide_banks(t, pack)), "payment_by_ifis").select(
        ROW_COLUMN, "value", "changed"
    )


@query
def duplicate_rows(spark, folder):
    pack = dirty_pack().with_rules()
    t = first_steps(dirty_with_copies(spark, folder), pack)
    t = keys.apply_flags(t, pack, keys.decide_flags(t, pack)[0])
    return t.df.select(ROW_COLUMN, "duplicate_row")


@query
def type_mismatch(spark, folder):
    pack = dirty_pack()
    flagged = quality.flag_type_mismatch(*quality.decide_types(_nulled(spark, folder), pack), pack)
    return flagged.cells().select(ROW_COLUMN, "column", "review_value")


@query
def clean_dataset_cells(spark, folder):
    return _clean(spark, folder).tracked.cells()


REGISTRY["clean_pipeline"] = REGISTRY["clean_dataset"] = REGISTRY.pop("clean_dataset_cells")


# ---- similarity and lookups ---------------------------------------------------------------------


def _place_values(spark, folder) -> DataFrame:
    """Distinct district texts, lower case, as the scorer sees them."""
    t = _nulled(spark, folder)
    return distinct_cells(t, {"district": t.value("district").isNotNull()}).select(F.lower("value").alias("value"))


@query
def fuzzy_best(spark, folder):
    best = S.best_choice_udf({0: domain.DISTRICTS})
    scored = _place_values(spark, folder).withColumn("best", best(F.lit(0), "value"))
    return scored.select("value", "best.choice", "best.score")


@query
def fuzzy_canonical(spark, folder):
    pack = dirty_pack()
    t = cells.apply_rules(_nulled(spark, folder), pack)
    scored = canonical.score_labels(t, pack, at_least=0)
    name = F.try_element_at(F.array(*[F.lit(n) for n in t.names]), F.col("slot") + 1).alias("column")
    tier = F.when(F.col("score") >= pack.auto_score, "auto").when(F.col("score") >= pack.review_score, "review").otherwise("none")
    return scored.select(name, "value", "choice", "score", tier.alias("tier"))


@query
def indel_ratio(spark, folder):
    pairs = _place_values(spark, folder).select("value", F.explode(F.array(*map(F.lit, domain.DISTRICTS))).alias("label"))
    return pairs.select("value", "label", F.round(S.indel_ratio("value", "label"), 6).alias("ratio"))


@query
def map_lookup(spark, folder):
    plain, _ = banks.alias_maps(dirty_pack())
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, T.literal_lookup(plain, F.lower(T.strip_ws("payment_by_ifis"))).alias("bank"))


@query
def value_choice_pairs(spark, folder):
    # the labels are a short list from the rules, so each value is unfolded with them in place
    labels = F.array(*map(F.lit, domain.DISTRICTS))
    return _place_values(spark, folder).select("value", F.explode(labels).alias("label"))


@query
def semi_isin(spark, folder):
    rows = dirty(spark, folder)
    known = (*domain.YES_VALUES, *domain.NO_VALUES)
    return rows.where(F.lower(T.strip_ws("widow")).isin(*known)).select(ROW_COLUMN, "widow")


@query
def align_by_row(spark, folder):
    rows = dirty(spark, folder).select(ROW_COLUMN, T.strip_ws("da_uuid").alias("key"))
    part = stage(keys.rows_with_repeated_key(rows, ["key"]).select(ROW_COLUMN, "n"), "part")
    return left_by_row(rows, part, ROW_COLUMN).select(
        ROW_COLUMN, F.col("n").isNotNull().alias("repeated"), F.coalesce("n", F.lit(1)).alias("n")
    )


@query
def touched_columns(spark, folder):
    t = first_steps(dirty(spark, folder), dirty_pack())
    return t.df.select(ROW_COLUMN, F.explode(t.touched_columns()).alias("column"))


@query
def dup_flag_or(spark, folder):
    pack = dirty_pack()
    t = first_steps(dirty(spark, folder), pack)
    t = keys.apply_flags(t, pack, keys.decide_flags(t, pack)[0])
    return t.df.select(ROW_COLUMN, "is_dup", "is_dup_cnic", (F.col("is_dup") | F.col("is_dup_cnic")).alias("any_dup"))


# ---- aggregates, windows, pages -----------------------------------------------------------------


@query
def duplicate_keys(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return keys.rows_with_repeated_key(lines, ["l_orderkey", "l_linenumber"], row="l_partkey")


@query
def column_rates(spark, folder):
    t, pack = _nulled(spark, folder), dirty_pack()
    rates = []
    for n in t.names:
        present = t.value(n).isNotNull()
        rates.append(F.avg(F.when(present, N.is_number(t.value(n)).cast("double"))).alias(n))
    return t.df.agg(*rates)


@query
def distinct_values(spark, folder):
    t = _nulled(spark, folder)
    names = ("district", "damage_category", "gender", "widow", "payment_by_ifis", "segment_name")
    found = distinct_cells(t, {n: t.value(n).isNotNull() for n in names})
    return found.select(F.try_element_at(F.array(*[F.lit(n) for n in t.names]), F.col("slot") + 1).alias("column"), "value")


@query
def clean_summary(spark, folder):
    return _clean(spark, folder).summary()


@query
def step_breakdown(spark, folder):
    return _clean(spark, folder).step_breakdown()


@query
def review_by_column(spark, folder):
    return _clean(spark, folder).review_by_column()


@query
def report_summary(spark, folder):
    return report.report_summary(report.report_defaults(_events_report(spark, folder)))


@query
def last_write_review(spark, folder):
    pack = dirty_pack()
    t = cells.apply_rules(first_steps(dirty(spark, folder), pack), pack)
    return t.cells().where("flagged").select(ROW_COLUMN, "column", "review_value")


@query
def merge_steps(spark, folder):
    pack = dirty_pack()
    t = cells.apply_rules(first_steps(dirty(spark, folder), pack), pack)
    n = "address"
    return t.df.select(ROW_COLUMN, F.array_join(step_array(t.mask(n)), " | ").alias("steps"))


@query
def record_key(spark, folder):
    pack = dirty_pack()
    t = first_steps(dirty_with_copies(spark, folder), pack)
    return keys.apply_flags(t, pack, keys.decide_flags(t, pack)[0]).df.select(ROW_COLUMN, keys.RECORD_KEY)


@query
def head_per_column(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").alias(ROW_COLUMN), "event_type", "props", F.when(F.col("value") > 10, F.col("value").cast("string")).alias("value")
    )
    t, pack = TrackedFrame.begin(events), dirty_pack()
    head = date_ops.head_per_column(t, pack, t.names)
    return head.select(F.try_element_at(F.array(*[F.lit(n) for n in t.names]), F.col("slot") + 1).alias("column"), ROW_COLUMN, "rank")


@query
def sort_report(spark, folder):
    rows = _orders_report(spark, folder)
    order = report.sort_columns(report.keys_are_numeric(rows))
    return row_index.by_order(rows, *order, row="place").select("uuid", "place")


@query
def page_by_offset(spark, folder):
    return report.page_by_offset(_orders_report(spark, folder), 7, 100)


@query
def page_by_cursor(spark, folder):
    rows, index = _stored_orders(spark, folder)
    page = report.page_by_cursor(rows, report.encode_cursor("599"), 100, index)
    return page.withColumn("cursor", report.cursor_column(F.col("uuid")))


@query
def page_metadata(spark, folder):
    rows, index = _stored_orders(spark, folder)
    by_page = report.page_metadata(rows, 100, page=7, index=index)
    return by_page.unionByName(report.page_metadata(rows, 100, cursor=report.encode_cursor("650"), index=index))


# ---- scalar functions ---------------------------------------------------------------------------


@query
def collapse_ws(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.collapse_ws("html").alias("value"))


@query
def digits_only(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.digits_only("html").alias("value"))


@query
def alnum_key(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.alnum_key("text").alias("value"))


@query
def drop_corp_words(spark, folder):
    return dirty(spark, folder).select(ROW_COLUMN, T.drop_corp_words(T.alnum_key("payment_by_ifis")).alias("value"))


@query
def sci_expand(spark, folder):
    rows = dirty(spark, folder)
    return rows.select(ROW_COLUMN, *[N.expand_scientific(c).alias(c) for c in ("da_cnic", "monthly_income", "lat")])


@query
def parse_mixed(spark, folder):
    rows = from_sql(spark, folder, DATE_TEXT_SQL, "orders")
    parsed = rows.withColumn("core", D.date_core("order_text"))
    return parsed.select(ROW_COLUMN, D.parse_core("core", 2026).alias("day"))


@query
def format_mdy(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", D.format_mdy("l_shipdate").alias("shipped"))


@query
def to_number(spark, folder):
    return dirty(spark, folder).select(ROW_COLUMN, *[N.to_number(c).alias(c) for c in NUMBER_COLUMNS])


@query
def ceil_pages(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("rows"))
    return counts.select("o_custkey", N.ceil_pages(F.col("rows"), 4).alias("pages"))


@query
def audit_maps(spark, folder):
    pack = dirty_pack()
    t = cells.apply_rules(first_steps(dirty(spark, folder), pack), pack)
    exploded = t.df.select(ROW_COLUMN, F.explode(t.changes()).alias("column", "change"))
    return exploded.select(ROW_COLUMN, "column", F.get("change", F.lit(0)).alias("new_value"), F.get("change", F.lit(1)).alias("steps"))


@query
def encode_json(spark, folder):
    pack = dirty_pack()
    t = first_steps(dirty(spark, folder), pack)
    text = t.df.select(ROW_COLUMN, F.to_json(t.reviews()).alias("json"))
    decoded = text.select(ROW_COLUMN, F.explode(F.from_json("json", "map<string,string>")).alias("column", "review_value"))
    return decoded


@query
def decode_json(spark, folder):
    rows = _events_report(spark, folder)
    decoded = rows.select("uuid", *[report.decode_map(F.col(c)).alias(c) for c in ("original_values", "cleaned_values", "manual_reviews")])
    return decoded.select(
        "uuid", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("original_values", "cleaned_values", "manual_reviews")],
        F.try_element_at("original_values", F.lit("k")).alias("k"),
    )


@query
def cursor_codec(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("key"))
    token = docs.withColumn("cursor", report.cursor_column(F.col("key")))
    return token.select("key", "cursor", report.cursor_key_column(F.col("cursor")).alias("decoded"))
