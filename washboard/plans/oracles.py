"""The same queries in SQL for DuckDB, written from the definitions and not from the Spark plans.

The cleaning steps are spelled out over a long table (one row per cell): ``o`` is the original text, ``a``
after trimming, ``b`` after nulls, ``c`` after checks and special characters, ``d`` after casing, ``e`` after
labels, ``f`` after dates, ``g`` after banks.
"""

from __future__ import annotations

from washboard import domain
from washboard.plans.fixtures import DATE_TEXT_SQL, DIRTY_SQL, LABELS, OLD_REPORT_SQL, TIME_TEXT_SQL

COLUMNS = (
    "da_uuid", "da_cnic", "cell_no", "district", "address", "damage_category", "gender", "widow", "lat",
    "monthly_income", "payment_by_ifis", "created_date", "segment_name",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def mapping(pairs) -> str:
    return "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in pairs) + ")"


TOKENS = in_list(domain.NULL_TOKENS)
WS = r"\s\x0B\x1c-\x1f\x{85}\p{Z}"
SIGNED = r"'^[+-]?\p{Nd}+(\.\p{Nd}+)?$'"
UNSIGNED = r"'^\p{Nd}+(\.\p{Nd}+)?$'"
SCI = r"'^[+-]?\p{Nd}+\.?\p{Nd}*[eE][+-]?\p{Nd}+'"
PARSEABLE = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
D, SP = r"\p{Nd}", r"[\s\x0B\x{85}\p{Z}]"
EDGE, END = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"  # word borders, which \b knows for ASCII only
SIGNAL = (
    f"'{EDGE}({D}{{4}}[-/]{D}{{1,2}}[-/]{D}{{1,2}}|{D}{{1,2}}[-/]{D}{{1,2}}[-/]{D}{{2,4}}"
    f"|{D}{{1,2}}{SP}+[A-Za-z]{{3,9}}{SP}+{D}{{2,4}}|[A-Za-z]{{3,9}}{SP}+{D}{{1,2}},?{SP}+{D}{{2,4}}){END}'"
)
TIME_ONLY = f"'^{SP}*{D}{{1,2}}:{D}{{2}}(:{D}{{2}})?{SP}*([AaPp][Mm])?{SP}*$'"
STRICT, SAFE = r"A-Za-z0-9\-.", r"A-Za-z0-9\-.,#/&''()"

BANK_PLAIN = [(k.lower(), v) for v, many in domain.BANKS.items() for k in (v, *many)]
BANK_PLAIN = list(dict(BANK_PLAIN).items())
BANK_REDUCED = list({k.replace(".", " "): v for k, v in BANK_PLAIN}.items())
GENDERS = [(s, label) for label, many in domain.GENDER_SPELLINGS.items() for s in many]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def null_like(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN {TOKENS})"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )


def special(x: str, keep: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^{keep}{WS}]', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {PARSEABLE}) THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def sci_text(x: str) -> str:
    return (
        f"coalesce(CAST(TRY_CAST(trunc({number(x)}) AS BIGINT) AS STRING), "
        f"CAST(TRY_CAST({number(x)} AS DECIMAL(38, 0)) AS STRING), '')"
    )


def id_digits(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, {SCI}) THEN {sci_text(x)} ELSE regexp_replace({x}, '\P{{Nd}}', '', 'g') END"


def phone(x: str) -> str:
    for prefix in (r"^\+92", "^0092", "^92", "^0"):
        x = f"regexp_replace({x}, '{prefix}', '')"
    return rf"regexp_replace({x}, '\P{{Nd}}', '', 'g')"


def lcs(x: str, y: str) -> str:
    """Length of a longest common subsequence: one table row per character of x, over the characters of y."""
    return f"""(CASE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0 ELSE
 list_reduce(list_transform(string_split({x}, ''), lambda ch: [CAST(unicode(ch) AS BIGINT)]),
  lambda prev, ch: list_reduce(list_transform(range(1, length({y}) + 1), lambda j: [j]),
   lambda acc, j: list_append(acc, CASE WHEN unicode({y}[j[1]]) = ch[1] THEN prev[j[1]] + 1
    ELSE greatest(acc[j[1]], prev[j[1] + 1]) END), [CAST(0 AS BIGINT)]),
  list_transform(range(0, length({y}) + 1), lambda k: CAST(0 AS BIGINT)))[-1] END)"""


def ymd(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"


def parse_date(x: str) -> str:
    """Dates in the shapes that occur in the test texts."""
    x = rf"regexp_replace(trim({x}), '[T ]+[0-9]{{1,2}}:[0-9]{{2}}( [AP]M)?$', '')"
    part = [f"split_part(regexp_replace({x}, '[-/ ]', '/', 'g'), '/', {i})" for i in (1, 2, 3)]
    first, second, third = part
    # the reference year is 2026, so two-digit years run from 1976 to 2075
    year = f"CASE WHEN length({third}) = 2 THEN concat(CASE WHEN {third} >= '76' THEN '19' ELSE '20' END, {third}) ELSE {third} END"
    months = "'janfebmaraprmayjunjulaugsepoctnovdec'"
    month = f"CAST((strpos({months}, lower(substr({second}, 1, 3))) + 2) // 3 AS STRING)"
    parsed = f"""CASE
 WHEN regexp_matches({x}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}$') THEN {ymd(first, second, third)}
 WHEN regexp_matches({x}, '^[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/]([0-9]{{2}}|[0-9]{{4}})$')
  THEN coalesce({ymd(year, first, second)}, {ymd(year, second, first)})
 WHEN regexp_matches({x}, '^[0-9]{{1,2}} (Jan|Mar) [0-9]{{4}}$') THEN {ymd(third, month, first)}
 WHEN regexp_matches({x}, '^[0-9]{{8}}$') THEN {ymd(f"substr({x}, 1, 4)", f"substr({x}, 5, 2)", f"substr({x}, 7, 2)")}
 WHEN regexp_matches({x}, '^[0-9]{{4}}$') THEN {ymd(x, "'1'", "'1'")} END"""
    return f"(SELECT CASE WHEN p BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN p END FROM (SELECT {parsed} AS p))"


def long_cells(source: str) -> str:
    return " UNION ALL ".join(f"SELECT row_idx, {i} AS pos, '{c}' AS col, {c} AS o FROM {source}" for i, c in enumerate(COLUMNS))


def label_list() -> str:
    pairs = [("district", x) for x in domain.DISTRICTS] + [("damage_category", x) for x in LABELS]
    return mapping(pairs)


DIRTY = f"dirty AS ({DIRTY_SQL})"
COPIES = f"""{DIRTY}, doubled AS (SELECT * FROM dirty UNION ALL
 SELECT row_idx + 1000000 AS row_idx, * EXCLUDE (row_idx) FROM dirty WHERE row_idx % 100 = 0)"""


def steps(source: str = "dirty") -> str:
    """Steps up to nulls."""
    return f"""cells0 AS ({long_cells(source)}),
 cells1 AS (SELECT *, {squeeze('o')} AS a FROM cells0),
 cells2 AS (SELECT *, CASE WHEN a IS NULL OR lower(a) IN {TOKENS} THEN NULL ELSE a END AS b FROM cells1)"""


CHECKS = rf"""genders(spelling, gender_label) AS (SELECT * FROM {mapping(GENDERS)}),
 helped AS (SELECT *, {id_digits('b')} AS dig, {phone('b')} AS tel,
  trim(regexp_replace(lower(b), '[^a-z{WS}]+', ' ', 'g')) AS gkey, {number('b')} AS num FROM cells2),
 grouped AS (SELECT h.*, g.gender_label,
   col = 'da_uuid' AND b IS NOT NULL AND count(*) OVER (PARTITION BY col, b) > 1 AS dup_id,
   coalesce(col = 'da_cnic' AND length(dig) = 13 AND count(*) OVER (PARTITION BY col, dig) > 1, false) AS dup_cnic
  FROM helped h LEFT JOIN genders g ON g.spelling = h.gkey),
 cells3 AS (SELECT *, CASE
   WHEN b IS NULL THEN NULL
   WHEN col = 'da_cnic' AND length(dig) = 13 THEN dig
   WHEN col = 'cell_no' AND length(tel) = 10 AND starts_with(tel, '3') THEN '0' || tel
   WHEN col = 'widow' AND lower(b) IN {in_list(domain.YES_VALUES)} THEN 'Yes'
   WHEN col = 'widow' AND lower(b) IN {in_list(domain.NO_VALUES)} THEN 'No'
   WHEN col = 'gender' AND gender_label IS NOT NULL THEN gender_label
   WHEN col = 'address' THEN {special('b', SAFE)}
   WHEN col IN ('district', 'damage_category', 'payment_by_ifis') THEN {special('b', STRICT)}
   ELSE b END AS c,
  CASE
   WHEN col IN ('da_uuid', 'da_cnic') AND b IS NULL THEN true
   WHEN b IS NULL THEN false
   WHEN col = 'da_uuid' THEN dup_id OR NOT regexp_matches(b, {UNSIGNED})
   WHEN col = 'da_cnic' THEN dup_cnic OR length(dig) <> 13 OR dig IN {in_list(domain.FAKE_IDS)}
     OR dig = repeat(substr(dig, 1, 1), 13)
   WHEN col = 'cell_no' THEN NOT (length(tel) = 10 AND starts_with(tel, '3'))
   WHEN col = 'widow' THEN lower(b) NOT IN {in_list(domain.YES_VALUES + domain.NO_VALUES)}
   WHEN col = 'gender' THEN gender_label IS NULL
   WHEN col = 'monthly_income' THEN NOT regexp_matches(b, {SIGNED})
   WHEN col = 'lat' THEN NOT regexp_matches(b, {SIGNED}) OR coalesce(num < 20 OR num > 40, false)
   ELSE false END AS check_flag FROM grouped),
 cells4 AS (SELECT *, CASE
   WHEN c IS NULL OR lower(c) IN {TOKENS} THEN c
   WHEN col IN ('address', 'district', 'damage_category') THEN {title('c')}
   WHEN col = 'payment_by_ifis' THEN upper(c) ELSE c END AS d FROM cells3)"""

STEP_FROM_CHECKS = """CASE WHEN a IS DISTINCT FROM o THEN 'TRIM' END, CASE WHEN a IS DISTINCT FROM b THEN 'NULL_STANDARDIZED' END,
 CASE WHEN b IS DISTINCT FROM c THEN CASE col WHEN 'da_cnic' THEN 'CNIC_FORMAT' WHEN 'cell_no' THEN 'CELL_NO_NORMALIZED'
  WHEN 'widow' THEN 'BOOL_STANDARDIZED' WHEN 'gender' THEN 'GENDER_STANDARDIZED' ELSE 'SPECIAL_CHARS_CLEANED' END END,
 CASE WHEN c IS DISTINCT FROM d THEN CASE col WHEN 'payment_by_ifis' THEN 'UPPER_CASED' ELSE 'TITLE_CASED' END END"""


def weighted(pairs: str, cut: bool = False) -> str:
    """CTEs that score every (col, value, label) row of ``pairs`` by the weighted ratio, ending in ``scored``."""
    join = "array_to_string({}, ' ')"
    sorted_words, rest = "list_sort({}, 'ASC')", "list_sort(list_filter(list_distinct({0}), lambda w: NOT list_contains({1}, w)), 'ASC')"
    return f"""words AS (SELECT DISTINCT col, value AS x, label AS y, string_split(value, ' ') AS wx, string_split(label, ' ') AS wy,
  greatest(length(value), length(label)) / least(length(value), length(label)) AS spread
  FROM {pairs} WHERE length(value) > 0),
 parts AS (SELECT *, {join.format(sorted_words.format('wx'))} AS sx, {join.format(sorted_words.format('wy'))} AS sy,
  {join.format(rest.format('wx', 'wy'))} AS rx, {join.format(rest.format('wy', 'wx'))} AS ry,
  {join.format("list_sort(list_distinct(wx), 'ASC')")} AS ux, {join.format("list_sort(list_distinct(wy), 'ASC')")} AS uy,
  list_filter(list_distinct(wx), lambda w: list_contains(wy, w)) AS shared FROM words),
 joint AS (SELECT *, length({join.format('shared')}) AS sect, CASE WHEN len(shared) > 0 THEN 1 ELSE 0 END AS gap FROM parts),
 slides AS (SELECT DISTINCT p, q, greatest(k, 1) AS k1, least(k + least(length(p), length(q)) - 1, greatest(length(p), length(q))) AS k2 FROM (
   SELECT p, q, unnest(range(2 - least(length(p), length(q)), greatest(length(p), length(q)) + 1)) AS k FROM (
    SELECT x AS p, y AS q FROM joint WHERE spread >= 1.5 UNION SELECT sx, sy FROM joint WHERE spread >= 1.5
    UNION SELECT ux, uy FROM joint WHERE spread >= 1.5) AS t WHERE length(p) > 0 AND length(q) > 0)),
 windows AS (SELECT p, q, CASE WHEN length(p) <= length(q) THEN p ELSE q END AS short,
   CASE WHEN length(p) <= length(q) THEN substr(q, k1, k2 - k1 + 1) ELSE substr(p, k1, k2 - k1 + 1) END AS piece FROM slides
  UNION SELECT p, q, q AS short, substr(p, k1, k2 - k1 + 1) AS piece FROM slides WHERE length(p) = length(q)),
 pieces AS (SELECT short, piece, 200.0 * {lcs('short', 'piece')} / (length(short) + length(piece)) AS score
   FROM (SELECT DISTINCT short, piece FROM windows) AS t),
 partials AS (SELECT p, q, max(score) AS partial FROM windows JOIN pieces USING (short, piece) GROUP BY p, q),
 based AS (SELECT j.*, 200.0 * {lcs('x', 'y')} / (length(x) + length(y)) AS plain,
   CASE WHEN spread < 1.5 THEN 200.0 * {lcs('sx', 'sy')} / (length(sx) + length(sy)) END AS token_sort,
   CASE WHEN spread < 1.5 THEN CASE WHEN sect > 0 AND (rx = '' OR ry = '') THEN 100.0 ELSE greatest(
     200.0 * (sect + gap + {lcs('rx', 'ry')}) / (2 * sect + 2 * gap + length(rx) + length(ry)),
     CASE WHEN sect > 0 THEN 200.0 * sect / (2 * sect + gap + length(rx)) ELSE 0 END,
     CASE WHEN sect > 0 THEN 200.0 * sect / (2 * sect + gap + length(ry)) ELSE 0 END) END END AS token_set,
   CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END AS s FROM joint j),
 scored AS (SELECT b.col, b.x AS value, b.y AS label, CASE WHEN spread < 1.5 THEN greatest(plain, 0.95 * greatest(token_sort, token_set))
   ELSE greatest(plain, s * whole.partial, 0.95 * s * CASE WHEN sect > 0 THEN 100.0 ELSE greatest(sorted.partial, uniq.partial) END) END AS score
  FROM based b LEFT JOIN partials whole ON whole.p = b.x AND whole.q = b.y
  LEFT JOIN partials sorted ON sorted.p = b.sx AND sorted.q = b.sy LEFT JOIN partials uniq ON uniq.p = b.ux AND uniq.q = b.uy),
 best AS (SELECT col, value, label AS choice, CAST(floor(score) AS INTEGER) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY col, value ORDER BY score DESC, label) = 1)"""


LABEL_STEPS = f"""labels(lcol, label) AS (SELECT * FROM {label_list()}),
 exact AS (SELECT c.*, l.label AS exact_label FROM cells4 c LEFT JOIN labels l ON l.lcol = c.col AND lower(l.label) = lower(c.d)),
 open_values AS (SELECT DISTINCT col, lower(d) AS value FROM exact WHERE col IN ('district', 'damage_category')
  AND exact_label IS NULL AND d IS NOT NULL AND lower(d) NOT IN {TOKENS}),
 open_pairs AS (SELECT col, value, label FROM open_values JOIN labels ON lcol = col),
 {weighted('open_pairs')},
 cells5 AS (SELECT e.*, best.choice, best.score,
  CASE WHEN exact_label IS NOT NULL THEN exact_label WHEN best.score >= 88 THEN best.choice ELSE d END AS e,
  coalesce(best.score BETWEEN 70 AND 87, false) AS label_flag
  FROM exact e LEFT JOIN best ON best.col = e.col AND best.value = lower(e.d) AND e.exact_label IS NULL)"""

LAST_STEPS = f"""plain_bank(alias, bank) AS (SELECT * FROM {mapping(BANK_PLAIN)}),
 reduced_bank(alias, bank) AS (SELECT * FROM {mapping(BANK_REDUCED)}),
 dated AS (SELECT *, CASE WHEN col = 'created_date' THEN {parse_date('e')} END AS day FROM cells5),
 cells6 AS (SELECT *, coalesce(strftime(day, '%m/%d/%Y'), e) AS f,
  col = 'created_date' AND e IS NOT NULL AND day IS NULL AS date_flag,
  trim(regexp_replace(lower(e), '[^a-z0-9]+', ' ', 'g')) AS bkey FROM dated),
 cells7 AS (SELECT c.*, CASE WHEN col = 'payment_by_ifis' THEN coalesce(b1.bank, b2.bank, b3.bank, f) ELSE f END AS g,
  col = 'segment_name' AND regexp_matches(f, {SIGNED}) AS type_flag
  FROM cells6 c LEFT JOIN plain_bank b1 ON b1.alias = lower(trim(f)) LEFT JOIN reduced_bank b2 ON b2.alias = bkey
  LEFT JOIN reduced_bank b3 ON b3.alias = trim(regexp_replace(bkey, '\\b(ltd|limited|bank)\\b', '', 'g'))),
 final AS (SELECT *, concat_ws(' | ', {STEP_FROM_CHECKS},
   CASE WHEN d IS DISTINCT FROM e THEN CASE col WHEN 'district' THEN 'GEO_STANDARDIZED' ELSE 'CATEGORY_STANDARDIZED' END END,
   CASE WHEN e IS DISTINCT FROM f THEN 'DATE_STANDARDIZED' END, CASE WHEN f IS DISTINCT FROM g THEN 'BANK_STANDARDIZED' END) AS steps,
  b IS NULL OR check_flag OR label_flag OR date_flag OR type_flag AS flagged,
  CASE WHEN type_flag THEN g WHEN date_flag THEN e WHEN label_flag THEN d WHEN check_flag THEN b WHEN b IS NULL THEN a END AS review_value
  FROM cells7),
 named AS (SELECT row_idx, CASE WHEN {null_like('da_uuid')} THEN concat('ROW_', row_idx + 2) ELSE {strip('da_uuid')} END AS base FROM dirty),
 records AS (SELECT n.row_idx, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY n.row_idx) = 1 THEN base
   ELSE concat(base, '__duplicate_row_', n.row_idx + 2) END AS uuid, f.dup_id AS is_dup, f.dup_cnic AS is_dup_cnic FROM named n
   JOIN (SELECT row_idx, bool_or(dup_id) AS dup_id, bool_or(dup_cnic) AS dup_cnic FROM final GROUP BY row_idx) AS f USING (row_idx))"""

NULLED = f"WITH {DIRTY}, {steps()}"
CHECKED = f"{NULLED}, {CHECKS}"
FULL = f"{CHECKED}, {LABEL_STEPS}, {LAST_STEPS}"
EARLY_STEPS = "concat_ws(' | ', CASE WHEN a IS DISTINCT FROM o THEN 'TRIM' END, CASE WHEN a IS DISTINCT FROM b THEN 'NULL_STANDARDIZED' END)"
CHECK_STEPS = f"concat_ws(' | ', {STEP_FROM_CHECKS})"
DISTRICT_VALUES = f"{NULLED}, place AS (SELECT DISTINCT lower(b) AS value FROM cells2 WHERE col = 'district' AND b IS NOT NULL), labels(label) AS (SELECT unnest([{', '.join(map(quoted, domain.DISTRICTS))}]))"
NUMBER_COLUMNS = ("da_uuid", "cell_no", "lat", "monthly_income")
TOKEN_COLUMNS = ("da_uuid", "da_cnic", "district", "damage_category", "gender", "widow")


def each(columns, expression) -> str:
    return ", ".join(f"{expression(c)} AS {c}" for c in columns)


def wide(source: str, value: str, columns=COLUMNS) -> str:
    return ", ".join(f"max(CASE WHEN col = '{c}' THEN {value} END) AS {c}" for c in columns)


def checked(col: str, extra: str = "") -> str:
    return f"{CHECKED} SELECT row_idx, c AS value, c IS DISTINCT FROM b AS changed, check_flag AS flagged, CASE WHEN check_flag THEN b END AS review_value{extra} FROM cells3 WHERE col = '{col}'"


def with_repeats(col: str, flag: str, out: str) -> str:
    return f"""{CHECKED} SELECT row_idx, c AS value, a IS DISTINCT FROM o OR a IS DISTINCT FROM b OR b IS DISTINCT FROM c AS changed,
 check_flag AS flagged, CASE WHEN check_flag THEN b END AS review_value, {flag} AS {out} FROM cells3 WHERE col = '{col}'"""


def labelled(col: str) -> str:
    return f"""{CHECKED}, {LABEL_STEPS} SELECT row_idx, e AS value, b IS DISTINCT FROM c OR c IS DISTINCT FROM d OR d IS DISTINCT FROM e AS changed,
 label_flag AS flagged, CASE WHEN label_flag THEN d END AS review_value FROM cells5 WHERE col = '{col}'"""


ORDER_PAGE = "SELECT CAST(o_orderkey AS STRING) AS uuid, o_orderstatus AS cleaned_values"
META = """SELECT CAST(100 AS INTEGER) AS page_size, CAST(least(100, total - start) AS BIGINT) AS returned, total AS total_rows,
 CAST(greatest(1, ceil(total / 100)) AS BIGINT) AS total_pages, CAST(start // 100 + 1 AS BIGINT) AS current_page,
 start + 100 < total AS has_more, start // 100 + 1 > 1 AS has_prev,
 CASE WHEN start + 100 < total THEN to_base64(encode(concat('{{"k":"', last_key, '"}}'))) END AS next_cursor
 FROM (SELECT count(*) AS total, {start} AS start, max(CASE WHEN rn = {start} + 100 THEN o_orderkey END) AS last_key FROM ranked)"""


def oracle_sql() -> dict[str, str]:
    dates = f"WITH texts AS ({DATE_TEXT_SQL})"
    old = f"WITH report AS ({OLD_REPORT_SQL})"
    flag_text = "coalesce(is_dup IN ('true', 'True', '1'), false)"
    detect_names = [c for c in COLUMNS if c not in ("da_uuid", "da_cnic", "lat")]
    json_count = "CASE WHEN {0} IN ('', '{{}}', ' ', 'null') THEN 0 ELSE CAST(len(json_keys({0})) AS BIGINT) END"
    return {
        "scan_csv_text": "SELECT CAST(doc_id AS STRING) AS doc_id, lang, source, text FROM documents",
        "csv_encoding_ladder": "SELECT CAST(doc_id AS STRING) AS doc_id, lang, text FROM documents",
        "csv_na_load": f"WITH {DIRTY} SELECT row_idx, {each(TOKEN_COLUMNS, lambda c: f'CASE WHEN {c} NOT IN {in_list(domain.NA_ON_LOAD)} THEN {c} END')} FROM dirty",
        "read_report": f"{FULL} SELECT uuid, is_dup, is_dup_cnic, 'PASS' AS validation_result FROM records",
        "read_cleaned": f"{NULLED} SELECT {wide('cells2', 'b')} FROM cells2 GROUP BY row_idx",
        "list_outputs": "SELECT 'beneficiary' AS data_type, r_name AS ip_name, r_name AS stem, concat(r_name, '_report.parquet') AS file, true AS size_right FROM region UNION ALL SELECT 'banks', NULL, 'Banks_Financials', 'Banks_Financials_report.parquet', true",
        "output_sizes": "SELECT true AS cleaned_size_right, true AS report_size_right, true AS total_size_right",
        "route_output": """SELECT 'certificates' AS data_type, 'North' AS stem, 'certificates/North' AS folder, count(*) AS rows FROM nation WHERE n_regionkey < 2
 UNION ALL SELECT 'beneficiary', 'North', 'beneficiary/North', count(*) FROM nation WHERE n_regionkey >= 2
 UNION ALL SELECT 'banks', 'Banks_Financials', 'Banks_Financials', count(*) FROM nation WHERE n_regionkey = 0
 UNION ALL SELECT 'financials', 'Banks_Financials', 'Banks_Financials', count(*) FROM nation WHERE n_regionkey = 0""",
        "dataset_profile": f"SELECT count(*) AS row_count, CAST({len(COLUMNS)} AS INTEGER) AS column_count, '{','.join(COLUMNS)}' AS columns FROM customer",
        "row_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx, concat('ROW_', row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1) AS label FROM orders",
        "write_cleaned": f"{NULLED} SELECT {wide('cells2', '''coalesce(b, '')''')} FROM cells2 GROUP BY row_idx",
        "write_report": f"{FULL} SELECT uuid, is_dup, is_dup_cnic, col AS column, g AS new_value, steps FROM final JOIN records USING (row_idx) WHERE steps <> ''",
        "write_result_json": f"{FULL} SELECT uuid, CAST(count_if(steps <> '' OR flagged) AS INTEGER) AS touched, is_dup FROM final JOIN records USING (row_idx) GROUP BY uuid, is_dup",
        "latest_results": "SELECT concat('cleaning_orders_', o_orderstatus, '_', strftime(DATE '2024-01-01' + CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER), '%Y%m%d'), '_000000.json') AS file_name, true AS size_right, CAST(row_number() OVER (ORDER BY o_orderstatus DESC) AS INTEGER) AS place FROM orders GROUP BY o_orderstatus",
        "null_mask": f"WITH {DIRTY} SELECT row_idx, {each(TOKEN_COLUMNS, null_like)} FROM dirty",
        "numeric_signed": f"WITH {DIRTY} SELECT row_idx, {each(NUMBER_COLUMNS, lambda c: f'regexp_matches({strip(c)}, {SIGNED})')} FROM dirty",
        "numeric_unsigned": f"WITH {DIRTY} SELECT row_idx, {each(NUMBER_COLUMNS, lambda c: f'regexp_matches({strip(c)}, {UNSIGNED})')} FROM dirty",
        "date_signal": f"WITH {DIRTY} SELECT row_idx, {each(('created_date', 'address', 'da_cnic'), lambda c: f'regexp_matches({c}, {SIGNAL})')} FROM dirty",
        "time_only": f"WITH texts AS ({TIME_TEXT_SQL}) SELECT event_id, regexp_matches(time_text, {TIME_ONLY}) AS time_only FROM texts",
        "sci_notation": f"WITH {DIRTY} SELECT row_idx, {each(('da_cnic', 'monthly_income'), lambda c: f'regexp_matches({c}, {SCI})')} FROM dirty",
        "repeat_digit": rf"WITH {DIRTY}, d AS (SELECT row_idx, regexp_replace(da_cnic, '\P{{Nd}}', '', 'g') AS v FROM dirty) SELECT row_idx, length(v) = 13 AND v = repeat(substr(v, 1, 1), 13) AS repeated FROM d",
        "fake_id": rf"WITH {DIRTY} SELECT row_idx, regexp_replace(da_cnic, '\P{{Nd}}', '', 'g') IN {in_list(domain.FAKE_IDS)} AS fake FROM dirty",
        "coord_out_of_bounds": f"WITH {DIRTY} SELECT row_idx, coalesce(NOT ({number('lat')} BETWEEN 20 AND 40), false) AS lat, coalesce(NOT ({number('monthly_income')} BETWEEN 60 AND 80), false) AS lon FROM dirty",
        "touched_originals": f"{NULLED} SELECT row_idx, col AS column, o AS original FROM cells2 WHERE a IS DISTINCT FROM o OR b IS NULL",
        "report_defaults": f"{old} SELECT uuid, cleaned_values, manual_reviews, {flag_text} AS is_dup, false AS is_dup_cnic, '{{\"result\": \"PASS\", \"filters\": []}}' AS validation_status, 'PASS' AS validation_result FROM report",
        "trim_whitespace": f"SELECT doc_id AS row_idx, {squeeze('text')} AS value, {squeeze('text')} <> text AS changed FROM documents",
        "null_standardize": f"{NULLED} SELECT row_idx, col AS column, o AS original, b AS value, {EARLY_STEPS} AS steps, b IS NULL AS flagged, CASE WHEN b IS NULL THEN a END AS review_value FROM cells2 WHERE a IS DISTINCT FROM o OR b IS NULL",
        "strip_special_chars": f"SELECT doc_id, {special('text', STRICT)} AS strict, {special('text', SAFE)} AS safe FROM documents",
        "title_case": f"SELECT doc_id, {title(special('text', SAFE))} AS value FROM documents",
        "upper_case": f"{NULLED} SELECT row_idx, upper(b) AS value, b IS DISTINCT FROM upper(b) AS changed FROM cells2 WHERE col = 'payment_by_ifis'",
        "bool_standardize": checked("widow"),
        "gender_standardize": checked("gender"),
        "phone_normalize": checked("cell_no"),
        "numeric_check": checked("monthly_income"),
        "coord_check": checked("lat"),
        "cnic_standardize": with_repeats("da_cnic", "dup_cnic", "is_dup_cnic"),
        "id_check": with_repeats("da_uuid", "dup_id", "is_dup"),
        "geo_standardize": labelled("district"),
        "category_standardize": labelled("damage_category"),
        "date_detect": f"""{NULLED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY row_idx) AS rank FROM cells2
 WHERE b IS NOT NULL AND col IN {in_list(detect_names)}),
 rates AS (SELECT col AS column, count(*) AS n, avg(CASE WHEN regexp_matches(b, {TIME_ONLY}) THEN 1.0 ELSE 0.0 END) AS time_rate,
  avg(CASE WHEN regexp_matches(b, {SIGNAL}) THEN 1.0 ELSE 0.0 END) AS signal_rate,
  avg(CASE WHEN {parse_date('b')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS parse_rate FROM ranked WHERE rank <= 2000 GROUP BY col)
 SELECT *, NOT (time_rate >= 0.8 AND signal_rate < 0.2) AND ((signal_rate >= 0.6 AND parse_rate >= 0.7)
  OR ("column" = 'created_date' AND signal_rate >= 0.25 AND parse_rate >= 0.6)) AS accepted FROM rates""",
        "date_standardize": f"{dates}, parsed AS (SELECT row_idx, order_text, {parse_date('order_text')} AS day FROM texts) SELECT row_idx, coalesce(strftime(day, '%m/%d/%Y'), order_text) AS value, day IS NOT NULL AND strftime(day, '%m/%d/%Y') <> order_text AS changed, day IS NULL AS flagged, CASE WHEN day IS NULL THEN order_text END AS review_value FROM parsed",
        "bank_standardize": rf"""{NULLED}, plain_bank(alias, bank) AS (SELECT * FROM {mapping(BANK_PLAIN)}), reduced_bank(alias, bank) AS (SELECT * FROM {mapping(BANK_REDUCED)}),
 keyed AS (SELECT row_idx, b, trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) AS k FROM cells2 WHERE col = 'payment_by_ifis')
 SELECT row_idx, coalesce(b1.bank, b2.bank, b3.bank, b) AS value, coalesce(b1.bank, b2.bank, b3.bank, b) IS DISTINCT FROM b AS changed FROM keyed
 LEFT JOIN plain_bank b1 ON b1.alias = lower(b) LEFT JOIN reduced_bank b2 ON b2.alias = k
 LEFT JOIN reduced_bank b3 ON b3.alias = trim(regexp_replace(k, '\b(ltd|limited|bank)\b', '', 'g'))""",
        "duplicate_rows": f"WITH {COPIES}, {steps('doubled')}, rows AS (SELECT row_idx, {wide('cells2', 'b')} FROM cells2 GROUP BY row_idx) SELECT row_idx, count(*) OVER (PARTITION BY {', '.join(COLUMNS)}) > 1 AS duplicate_row FROM rows",
        "type_mismatch": f"{NULLED} SELECT row_idx, col AS column, b AS review_value FROM cells2 WHERE col = 'segment_name' AND regexp_matches(b, {SIGNED})",
        "clean_pipeline": f"{FULL} SELECT row_idx, col AS column, o AS original, g AS value, steps, flagged, review_value FROM final WHERE steps <> '' OR flagged",
        "clean_dataset": f"{FULL} SELECT row_idx, col AS column, o AS original, g AS value, steps, flagged, review_value FROM final WHERE steps <> '' OR flagged",
        "fuzzy_best": f"{DISTRICT_VALUES}, pairs AS (SELECT 'district' AS col, value, label FROM place, labels), {weighted('pairs')} SELECT value, choice, score FROM best",
        "fuzzy_canonical": f"{CHECKED}, {LABEL_STEPS} SELECT DISTINCT e.col AS column, e.d AS value, choice, score, CASE WHEN score >= 88 THEN 'auto' WHEN score >= 70 THEN 'review' ELSE 'none' END AS tier FROM cells5 e WHERE choice IS NOT NULL",
        "indel_ratio": f"{DISTRICT_VALUES} SELECT value, label, round(200.0 * {lcs('value', 'label')} / (length(value) + length(label)), 6) AS ratio FROM place, labels",
        "map_lookup": f"WITH {DIRTY}, plain_bank(alias, bank) AS (SELECT * FROM {mapping(BANK_PLAIN)}) SELECT row_idx, bank FROM dirty LEFT JOIN plain_bank ON alias = lower({strip('payment_by_ifis')})",
        "value_choice_pairs": f"{DISTRICT_VALUES} SELECT value, label FROM place CROSS JOIN labels",
        "semi_isin": f"WITH {DIRTY} SELECT row_idx, widow FROM dirty WHERE lower({strip('widow')}) IN {in_list(domain.YES_VALUES + domain.NO_VALUES)}",
        "align_by_row": f"WITH {DIRTY}, k AS (SELECT row_idx, {strip('da_uuid')} AS key FROM dirty) SELECT row_idx, count(*) OVER (PARTITION BY key) > 1 AS repeated, count(*) OVER (PARTITION BY key) AS n FROM k",
        "touched_columns": f"{NULLED} SELECT row_idx, col AS column FROM cells2 WHERE a IS DISTINCT FROM o OR b IS NULL",
        "dup_flag_or": f"{CHECKED} SELECT row_idx, bool_or(dup_id) AS is_dup, bool_or(dup_cnic) AS is_dup_cnic, bool_or(dup_id OR dup_cnic) AS any_dup FROM cells3 GROUP BY row_idx",
        "duplicate_keys": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) OVER w AS n, min(l_partkey) OVER w AS first_row FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber) QUALIFY n > 1",
        "column_rates": f"{NULLED}, v AS (SELECT row_idx, {wide('cells2', 'b')} FROM cells2 GROUP BY row_idx) SELECT {each(COLUMNS, lambda c: f'avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, {SIGNED}) THEN 1.0 ELSE 0.0 END)')} FROM v",
        "distinct_values": f"{NULLED} SELECT DISTINCT col AS column, b AS value FROM cells2 WHERE b IS NOT NULL AND col IN ('district', 'damage_category', 'gender', 'widow', 'payment_by_ifis', 'segment_name')",
        "clean_summary": f"{FULL}, per_row AS (SELECT row_idx, count_if(steps <> '') AS changed, count_if(flagged) AS flags FROM final GROUP BY row_idx) SELECT count(*) AS total_rows, CAST(count_if(changed > 0) AS BIGINT) AS rows_auto_cleaned, CAST(count_if(flags > 0) AS BIGINT) AS rows_need_review, CAST(count_if(is_dup) AS BIGINT) AS duplicate_uuid_rows, CAST(sum(changed) AS BIGINT) AS cells_auto_cleaned, CAST(sum(flags) AS BIGINT) AS cells_flagged FROM per_row JOIN records USING (row_idx)",
        "step_breakdown": f"{FULL} SELECT step, count(*) AS cells FROM (SELECT unnest(string_split(steps, ' | ')) AS step FROM final WHERE steps <> '') GROUP BY step",
        "review_by_column": f"{FULL} SELECT col AS column, count(*) AS cells FROM final WHERE flagged GROUP BY col",
        "report_summary": f"{old} SELECT CAST(count_if(trim(cleaned_values) NOT IN ('', 'null', 'None', '{{}}', '[]')) AS BIGINT) AS total_cleaned, CAST(count_if(trim(manual_reviews) NOT IN ('', 'null', 'None', '{{}}', '[]')) AS BIGINT) AS total_review, CAST(count_if({flag_text}) AS BIGINT) AS total_duplicate_uuid, CAST(0 AS BIGINT) AS total_duplicate_cnic FROM report",
        "last_write_review": f"{CHECKED} SELECT row_idx, col AS column, CASE WHEN check_no_dup THEN b ELSE a END AS review_value FROM (SELECT *, CASE col WHEN 'da_uuid' THEN b IS NULL OR NOT regexp_matches(b, {UNSIGNED}) WHEN 'da_cnic' THEN b IS NULL OR length(dig) <> 13 OR dig IN {in_list(domain.FAKE_IDS)} ELSE check_flag END AS check_no_dup FROM cells4) WHERE b IS NULL OR check_no_dup",
        "merge_steps": f"{CHECKED} SELECT row_idx, {CHECK_STEPS} AS steps FROM cells4 WHERE col = 'address'",
        "record_key": f"WITH {COPIES}, named AS (SELECT row_idx, CASE WHEN {null_like('da_uuid')} THEN concat('ROW_', row_idx + 2) ELSE {strip('da_uuid')} END AS base FROM doubled) SELECT row_idx, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY row_idx) = 1 THEN base ELSE concat(base, '__duplicate_row_', row_idx + 2) END AS record_key FROM named",
        "head_per_column": """WITH v AS (SELECT event_id AS row_idx, 'event_type' AS column, event_type AS value FROM events UNION ALL SELECT event_id, 'props', props FROM events
 UNION ALL SELECT event_id, 'value', CAST(value AS STRING) FROM events WHERE value > 10)
 SELECT "column", row_idx, CAST(row_number() OVER (PARTITION BY "column" ORDER BY row_idx) AS INTEGER) AS rank FROM v WHERE value IS NOT NULL QUALIFY rank <= 2000""",
        "sort_report": "SELECT CAST(o_orderkey AS STRING) AS uuid, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders",
        "page_by_offset": f"{ORDER_PAGE} FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 600",
        "page_by_cursor": f"{ORDER_PAGE}, to_base64(encode(concat('{{\"k\":\"', o_orderkey, '\"}}'))) AS cursor FROM orders WHERE o_orderkey > 599 ORDER BY o_orderkey LIMIT 100",
        "page_metadata": "WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) "
        + META.format(start="600") + " UNION ALL " + META.format(start="(SELECT count(*) FROM orders WHERE o_orderkey <= 650)"),
        "collapse_ws": f"SELECT page_id, {squeeze('html')} AS value FROM pages",
        "digits_only": r"SELECT page_id, regexp_replace(html, '\P{Nd}', '', 'g') AS value FROM pages",
        "alnum_key": "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS value FROM documents",
        "drop_corp_words": rf"WITH {DIRTY} SELECT row_idx, trim(regexp_replace(trim(regexp_replace(lower(payment_by_ifis), '[^a-z0-9]+', ' ', 'g')), '\b(ltd|limited|bank)\b', '', 'g')) AS value FROM dirty",
        "sci_expand": f"WITH {DIRTY} SELECT row_idx, {each(('da_cnic', 'monthly_income', 'lat'), sci_text)} FROM dirty",
        "parse_mixed": f"{dates} SELECT row_idx, {parse_date('order_text')} AS day FROM texts",
        "format_mdy": "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%m/%d/%Y') AS shipped FROM lineitem",
        "to_number": f"WITH {DIRTY} SELECT row_idx, {each(NUMBER_COLUMNS, number)} FROM dirty",
        "ceil_pages": "SELECT o_custkey, CAST(greatest(1, ceil(count(*) / 4)) AS BIGINT) AS pages FROM orders GROUP BY o_custkey",
        "audit_maps": f"{CHECKED} SELECT row_idx, col AS column, d AS new_value, {CHECK_STEPS} AS steps FROM cells4 WHERE {CHECK_STEPS} <> ''",
        "encode_json": f"{NULLED} SELECT row_idx, col AS column, a AS review_value FROM cells2 WHERE b IS NULL",
        "decode_json": f"{old} SELECT uuid, {', '.join(f'{json_count.format(c)} AS n_{c}' for c in ('original_values', 'cleaned_values', 'manual_reviews'))}, json_extract_string(original_values, '$.k') AS k FROM report",
        "cursor_codec": "WITH k AS (SELECT concat_ws('/', source, lang, doc_id) AS key FROM documents) SELECT key, translate(to_base64(encode(concat('{\"k\":\"', key, '\"}'))), '+/', '-_') AS cursor, key AS decoded FROM k",
    }
