"""SQL of the general data-preparation queries for DuckDB."""

from __future__ import annotations

from .sales_sql import COLUMNS, day, number, text, up

LISTED = "(SELECT string_agg(regexp_escape(promotion_id), '|' ORDER BY length(promotion_id) DESC, promotion_id) FROM promotion_list)"

FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
INTEGER, DECIMAL, DATE = "[+-]?[0-9]+", r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", "[0-9]{2}-[0-9]{2}-[0-9]{2}"


def field(i: int) -> str:
    """Field i of a soundly quoted line, unquoted."""
    raw = f"regexp_extract(raw_line, '(?s)^(?:{FIELD},){{{i}}}({FIELD})(?:,|$)', 1)"
    return f"replace(CASE WHEN starts_with({raw}, '\"') THEN {raw}[2:-2] ELSE {raw} END, '\"\"', '\"')"


def reasons(quantity: str, amount: str, date: str) -> str:
    q = f"CASE WHEN NOT regexp_full_match({text(quantity)}, '{INTEGER}') OR ({text(quantity)} IS NOT NULL AND try_cast({text(quantity)} AS INTEGER) IS NULL) THEN 'quantity_invalid' END"
    a = f"CASE WHEN NOT regexp_full_match({text(amount)}, '{DECIMAL}') THEN 'amount_invalid' END"
    d = f"CASE WHEN {text(date)} IS NOT NULL AND ({day(date)}) IS NULL THEN 'order_date_invalid' END"
    return f"concat_ws(',', {q}, {a}, {d})"


BLANK_LINE = "nullif(regexp_replace(raw_line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '')"
CHECKED = f"""
lines AS (SELECT row_id, raw_line, regexp_full_match(raw_line, '(?s){FIELD}(?:,{FIELD})*') AS sound,
    length(regexp_replace(raw_line, '"[^"]*"', '', 'g')) - length(replace(regexp_replace(raw_line, '"[^"]*"', '', 'g'), ',', '')) + 1 AS fields
  FROM sales_raw WHERE {BLANK_LINE} IS NOT NULL),
read AS (SELECT row_id, {', '.join(f'{field(i)} AS {c}' for i, c in enumerate(COLUMNS))} FROM lines WHERE sound AND fields = 24),
line_reasons AS (
  SELECT row_id, CASE WHEN NOT sound THEN 'quoting_unsound' ELSE 'field_count_' || CAST(fields AS VARCHAR) END AS reasons FROM lines WHERE NOT sound OR fields <> 24
  UNION ALL SELECT row_id, {reasons('quantity', 'amount', 'order_date')} FROM read),
row_reasons AS (SELECT row_id, {reasons('quantity', 'amount', 'order_date')} AS reasons FROM amazon_sales),
bad AS (SELECT * FROM line_reasons WHERE reasons <> '' UNION ALL SELECT * FROM row_reasons WHERE reasons <> '')"""

UNTYPED = [c for c in COLUMNS if c not in ("quantity", "amount", "order_date")]
LOADED = f"row_id, {', '.join(UNTYPED)}, {number('quantity', 'INTEGER')} AS quantity, {number('amount', 'DOUBLE')} AS amount, {day('order_date')} AS order_date"


def rolling(entity: list[str]) -> str:
    e = ", ".join(entity)
    same = " AND ".join(f"g.{c} IS NOT DISTINCT FROM d.{c}" for c in entity)
    units = f"CAST(CASE WHEN regexp_full_match({text('amount')}, '{DECIMAL}') THEN try_cast({text('amount')} AS DECIMAL(22,4)) END * 10000 AS BIGINT)"
    frames = {w: f"OVER (PARTITION BY {e} ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (7, 30)}
    out = ", ".join(
        f"CAST(sum(s) {f} AS DOUBLE) / 10000.0 AS total_{w}, CAST(sum(n) {f} AS BIGINT) AS n_{w}, CASE WHEN sum(n) {f} > 0 THEN CAST(sum(s) {f} AS DOUBLE) / 10000.0 / CAST(sum(n) {f} AS DOUBLE) END AS average_{w}"
        for w, f in frames.items()
    )
    return f"""WITH r AS (SELECT {up('ship_state')} AS ship_state, {up('size')} AS size, {day('order_date')} AS day, {units} AS u FROM amazon_sales),
      daily AS (SELECT {e}, day, coalesce(sum(u), 0) AS s, count(u) AS n FROM r WHERE day IS NOT NULL AND ship_state IS NOT NULL GROUP BY {e}, day),
      days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM r),
      grid AS (SELECT * FROM (SELECT DISTINCT {e} FROM daily), days),
      filled AS (SELECT {', '.join(f'g.{c}' for c in entity)}, g.day, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n FROM grid g LEFT JOIN daily d ON g.day = d.day AND {same})
      SELECT {e}, day, {out} FROM filled"""


def form(v: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({v}, '[0-9]+', '9', 'g'), '\\p{{Lu}}', 'A', 'g'), '\\p{{Ll}}', 'a', 'g')"


def _values(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {text(c)} AS value FROM amazon_sales WHERE load_id IS NOT NULL" for c in columns)


CHANGES = f"""WITH loads AS (SELECT load_id, count(*) AS load_rows FROM amazon_sales WHERE load_id IS NOT NULL GROUP BY 1),
v AS ({_values(['status', 'size'])}),
i AS (SELECT *, {form('value')} AS form FROM ({_values(['order_id', 'source_index'])})),
spread AS (SELECT column_name, value FROM v WHERE value IS NOT NULL GROUP BY 1, 2 HAVING (SELECT count(*) FROM loads) - count(DISTINCT load_id) > (SELECT count(*) FROM loads) / 2.0),
common AS (SELECT column_name, form FROM (SELECT column_name, form, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, form) AS k FROM i WHERE form IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
first AS (SELECT value, min(load_id) AS first_load FROM i WHERE column_name = 'source_index' AND value IS NOT NULL GROUP BY 1),
marked AS (
  SELECT load_id, column_name, CASE WHEN value IS NULL THEN 'blank' ELSE 'value=' || value END AS measure FROM v
  UNION ALL SELECT load_id, v.column_name, 'rare' FROM v JOIN spread s ON v.column_name = s.column_name AND v.value = s.value
  UNION ALL SELECT load_id, column_name, 'blank' FROM i WHERE value IS NULL
  UNION ALL SELECT load_id, i.column_name, 'off_form' FROM i JOIN common c ON i.column_name = c.column_name AND i.form <> c.form
  UNION ALL SELECT load_id, column_name, 'seen_before' FROM i JOIN first f ON i.value = f.value AND i.column_name = 'source_index' WHERE load_id > first_load),
counts AS (SELECT column_name, measure, load_id, count(*) AS n FROM marked GROUP BY 1, 2, 3),
totals AS (SELECT column_name, measure, CAST(sum(n) AS DOUBLE) AS all_n FROM counts GROUP BY 1, 2),
shares AS (SELECT g.column_name, g.measure, l.load_id, CAST(coalesce(n, 0) AS DOUBLE) / l.load_rows AS share,
    (all_n - coalesce(n, 0)) / ((SELECT sum(load_rows) FROM loads) - l.load_rows) AS other
  FROM (SELECT DISTINCT column_name, measure FROM counts) g CROSS JOIN loads l LEFT JOIN counts c ON c.column_name = g.column_name AND c.measure = g.measure AND c.load_id = l.load_id
    JOIN totals t ON t.column_name = g.column_name AND t.measure = g.measure),
cases AS (SELECT * EXCLUDE (other), round(CASE WHEN share = other THEN 0 WHEN share * (1 - share) + other * (1 - other) > 0 THEN (share - other) / sqrt((share * (1 - share) + other * (1 - other)) / 2)
    ELSE sign(share - other) * CAST('inf' AS DOUBLE) END, 6) AS shift, quantile_cont(share, 0.5) OVER (PARTITION BY column_name, measure) AS median_share FROM shares)
"""

#: CHANGES with every column in both lists; blanks are counted from the first.
COLUMN_CHANGES = (
    CHANGES.replace(_values(["status", "size"]), _values(COLUMNS)).replace(_values(["order_id", "source_index"]), _values(COLUMNS))
    .replace("UNION ALL SELECT load_id, column_name, 'blank' FROM i WHERE value IS NULL", "")
)

PROFILE = f"""WITH v AS ({' UNION ALL '.join(f"SELECT load_id, '{c}' AS column_name, {text(c)} AS value FROM amazon_sales" for c in COLUMNS)}),
f AS (SELECT load_id, column_name, CASE WHEN value IS NOT NULL THEN {form('value')} END AS form, count(*) AS n, count(DISTINCT value) AS d, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT load_id, column_name, form AS common_form, n AS common_n, row_number() OVER (PARTITION BY load_id, column_name ORDER BY n DESC, form DESC) AS k FROM f WHERE form IS NOT NULL) WHERE k = 1),
t AS (SELECT load_id, column_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (form IS NULL), 0) AS BIGINT) AS blank_count, CAST(sum(d) AS BIGINT) AS distinct_count, min(lo) AS min_text, max(hi) AS max_text, count(form) AS form_count FROM f GROUP BY 1, 2)
SELECT t.*, common_form, row_count - blank_count - coalesce(common_n, 0) AS off_form_count FROM t LEFT JOIN b USING (load_id, column_name)"""

def _units(c: str) -> str:
    valid = f"regexp_full_match({text(c)}, '{DECIMAL}')"
    return f"SELECT load_id, '{c}' AS column_name, CASE WHEN {valid} THEN CAST(try_cast({text(c)} AS DECIMAL(38,4)) * 10000 AS HUGEINT) END AS u, CASE WHEN {valid} THEN try_cast({text(c)} AS DOUBLE) END AS x FROM amazon_sales"


def _ranged(c: str) -> str:
    return f"SELECT load_id, '{c}' AS column_name, {text(c)} AS value, CASE WHEN regexp_full_match({text(c)}, '{DECIMAL}') THEN try_cast({text(c)} AS DOUBLE) END AS x FROM amazon_sales"


RANGES = f"""SELECT load_id, column_name, count(*) AS row_count, count(*) - count(value) AS blank_count, count(x) AS valid_count, min(x) AS min_value, max(x) AS max_value
FROM ({' UNION ALL '.join(map(_ranged, ('amount', 'quantity', 'source_index')))}) GROUP BY 1, 2"""


def _spread(n: str, s1: str, s2: str) -> str:
    return f"greatest(0.0, CASE WHEN {n} > 0 THEN {s2} / {n} END - pow(CASE WHEN {n} > 0 THEN {s1} / {n} END, 2))"


def shift(columns: tuple[str, ...]) -> str:
    """Sums of whole numbers for means and deviations, those of other loads by subtraction; skewness by two passes over the values. No number is left out."""
    return f"""v AS ({' UNION ALL '.join(map(_units, columns))}),
s AS (SELECT load_id, column_name, count(x) AS valid, CAST(count(u) AS DOUBLE) AS n, coalesce(sum(u), 0) AS i1, coalesce(sum(u * u), 0) AS i2 FROM v GROUP BY 1, 2),
w AS (SELECT *, CAST(i1 AS DOUBLE) AS s1, CAST(i2 AS DOUBLE) AS s2, sum(n) OVER c - n AS rn, CAST(sum(i1) OVER c - i1 AS DOUBLE) AS r1, CAST(sum(i2) OVER c - i2 AS DOUBLE) AS r2
  FROM s WINDOW c AS (PARTITION BY column_name)),
x AS (SELECT *, CASE WHEN n > 0 THEN s1 / n END AS mean, CASE WHEN rn > 0 THEN r1 / rn END AS other, {_spread('n', 's1', 's2')} AS var, sqrt(({_spread('n', 's1', 's2')} + {_spread('rn', 'r1', 'r2')}) / 2) AS pooled FROM w),
third AS (SELECT v.load_id, v.column_name, fsum(pow(v.u - x.mean, 3)) AS t FROM v JOIN x ON v.load_id IS NOT DISTINCT FROM x.load_id AND v.column_name = x.column_name WHERE v.u IS NOT NULL GROUP BY 1, 2),
moved AS (SELECT x.load_id, x.column_name, valid, CAST(valid - n AS BIGINT) AS beyond, round(mean / 10000.0, 6) AS mean, round(CASE WHEN n > 0 THEN sqrt(var) END / 10000.0, 6) AS stddev,
  round(CASE WHEN n >= 2 AND var > 0 THEN t / n / pow(var, 1.5) END, 6) AS skewness, round(CASE WHEN n >= 2 AND rn >= 2 AND pooled > 0 THEN (mean - other) / pooled END, 6) AS shift
  FROM x LEFT JOIN third t ON t.load_id IS NOT DISTINCT FROM x.load_id AND t.column_name = x.column_name)"""


SHIFT = f"WITH {shift(('amount', 'quantity'))} SELECT * FROM moved"
WHOLE_PROFILE = f"""WITH p AS ({PROFILE}), r AS ({RANGES}), {shift(('amount', 'quantity', 'source_index'))}
SELECT p.*, m.valid, m.beyond, r.min_value, r.max_value, m.mean, m.stddev, m.skewness, m.shift FROM p
  LEFT JOIN r ON p.load_id IS NOT DISTINCT FROM r.load_id AND p.column_name = r.column_name LEFT JOIN moved m ON p.load_id IS NOT DISTINCT FROM m.load_id AND p.column_name = m.column_name"""

PATTERNS = {"order_id": "[A-Z][0-9]+-[0-9]+-[0-9]+", "source_index": "[0-9]+", "ship_postal_code": r"[0-9]{6}(\.0)?", "order_date": DATE}

SQL = {
    "p1_found": f"""WITH f AS (SELECT row_id, regexp_extract_all(replace(replace(promotion_ids, '""', '"'), '\\"', '"'), {LISTED}) AS parts FROM amazon_sales WHERE {text('promotion_ids')} IS NOT NULL)
      SELECT row_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS pos, unnest(parts) AS promotion_id FROM f""",
    "p1_summary": f"""WITH f AS MATERIALIZED (SELECT regexp_extract_all(replace(replace(promotion_ids, '""', '"'), '\\"', '"'), {LISTED}) AS parts FROM amazon_sales WHERE {text('promotion_ids')} IS NOT NULL)
      SELECT CAST(NULL AS VARCHAR) AS error, true AS is_listed, CAST(sum(len(parts)) AS BIGINT) AS n_values, count(*) AS n_rows FROM f WHERE len(parts) > 0""",
    "p3_found": f"WITH {CHECKED} SELECT row_id FROM bad",
    "p3_rejects": f"WITH {CHECKED} SELECT row_id, reasons, raw_line AS raw_text FROM bad LEFT JOIN sales_raw USING (row_id)",
    "p3_loaded": f"""WITH {CHECKED}, both_tables AS (SELECT row_id, {', '.join(COLUMNS)} FROM amazon_sales UNION ALL BY NAME SELECT row_id, {', '.join(f"nullif({c}, '') AS {c}" for c in COLUMNS)} FROM read)
      SELECT {LOADED} FROM both_tables ANTI JOIN bad USING (row_id)""",
    "p5_rolling_state_size": rolling(["ship_state", "size"]),
    "p5_rolling_state": rolling(["ship_state"]),
    "p5_late_corrections": rolling(["ship_state"]),
    "p5_left_out": f"""SELECT * FROM (SELECT row_id, CASE WHEN ({day('order_date')}) IS NULL THEN 'no_day' WHEN {text('ship_state')} IS NULL THEN 'no_state' WHEN {text('amount')} IS NULL THEN 'no_amount'
      WHEN NOT regexp_full_match({text('amount')}, '{DECIMAL}') THEN 'amount_invalid' WHEN try_cast({text('amount')} AS DECIMAL(28,8)) IS NULL THEN 'amount_too_large' END AS reason FROM amazon_sales) WHERE reason IS NOT NULL""",
    "p7_found": f"{CHANGES} SELECT DISTINCT load_id, column_name FROM cases WHERE abs(share - median_share) >= 0.1 - 1e-9",
    "p7_changes": f"{CHANGES} SELECT load_id, column_name, measure, share, median_share, shift FROM cases WHERE abs(share - median_share) >= 0.1 - 1e-9",
    "p7_column_changes": f"{COLUMN_CHANGES} SELECT load_id, column_name, measure, share, median_share, shift FROM cases WHERE abs(share - median_share) >= 0.1 - 1e-9",
    "p7_profile": WHOLE_PROFILE,
    "p7_numeric_profile": RANGES,
    "p7_numeric_shift": SHIFT,
    "p7_pattern_violations": " UNION ALL ".join(
        f"SELECT load_id, '{c}' AS column_name, count(*) FILTER ({text(c)} IS NOT NULL) AS checked, count(*) FILTER (NOT regexp_full_match({text(c)}, '{p}')) AS violations FROM amazon_sales GROUP BY 1" for c, p in PATTERNS.items()
    ),
}
