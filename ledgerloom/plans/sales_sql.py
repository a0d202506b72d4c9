"""SQL of the sales queries for DuckDB, over the raw tables."""

from __future__ import annotations

from .sales_queries import BUSY, LARGE_GROUP, LEAST_TAGS, LOW_BUSY, LOW_GROUP, LOW_TAGS


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def text(c: str) -> str:
    return f"nullif({trimmed(c)}, '')"


def up(c: str) -> str:
    return f"upper({text(c)})"


def number(c: str, kind: str) -> str:
    pattern = {"BIGINT": "[+-]?[0-9]+", "INTEGER": "[+-]?[0-9]+", "DOUBLE": r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"}[kind]
    return f"CASE WHEN regexp_full_match({text(c)}, '{pattern}') THEN try_cast({text(c)} AS {kind}) END"


def day(c: str) -> str:
    return f"CASE WHEN regexp_full_match({text(c)}, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(try_strptime({text(c)}, '%m-%d-%y') AS DATE) END"


PARTS = f"list_filter(list_transform(string_split(coalesce(promotion_ids, ''), ','), lambda x: {trimmed('x')}), lambda x: x <> '')"
UPPER = ("status", "fulfilment", "sales_channel", "ship_service_level", "style", "sku", "category", "size", "asin", "courier_status", "currency", "ship_city", "ship_state", "ship_country", "fulfilled_by")
RANKS = "map(['XS','S','M','L','XL','XXL','3XL','4XL','5XL','6XL'], [1,2,3,4,5,6,7,8,9,10])"

SALES = f"""
WITH typed AS (
  SELECT row_id, {number('source_index', 'BIGINT')} AS source_index, {text('order_id')} AS order_id, {day('order_date')} AS order_date,
    {', '.join(f'{up(c)} AS {c}' for c in UPPER)},
    {number('quantity', 'INTEGER')} AS quantity, {number('amount', 'DOUBLE')} AS amount,
    regexp_replace({text('ship_postal_code')}, '\\.0$', '') AS ship_postal_code,
    {PARTS} AS parts,
    CASE lower({text('is_b2b')}) WHEN 'true' THEN true WHEN 'false' THEN false END AS is_b2b
  FROM amazon_sales),
sales AS (
  SELECT * EXCLUDE (parts), list_filter(parts, lambda x, i: list_position(parts, x) = i) AS promotion_ids,
    len(list_distinct(parts)) AS promotion_count, len(parts) - len(list_distinct(parts)) AS duplicate_promotion_count,
    strftime(order_date, '%Y-%m') AS order_month, {RANKS}[size] AS size_rank,
    coalesce(contains(status, 'SHIPPED'), false) AS is_shipped, coalesce(contains(status, 'CANCELLED'), false) AS is_cancelled,
    coalesce(contains(status, 'SHIPPED') AND quantity > 0, false) AS is_bought, coalesce(ship_state <> 'APO', false) AS is_valid_state
  FROM typed)"""

BOUGHT = f"{SALES}, bought AS (SELECT * FROM sales WHERE is_bought AND is_valid_state)"
MOMENTS = "count(*) AS n, count(amount) AS m, sum(CAST(round(amount * 100) AS BIGINT)) AS s1, sum(CAST(CAST(round(amount * 100) AS BIGINT) AS HUGEINT) * CAST(round(amount * 100) AS BIGINT)) AS s2"
VARIANCE = "CASE WHEN m > 0 THEN greatest(0.0, CAST(CAST(m AS HUGEINT) * s2 - CAST(s1 AS HUGEINT) * s1 AS DOUBLE) / (CAST(m AS DOUBLE) * m) / 10000.0) END"

LENGTHS = f"""{BOUGHT},
lengths AS (SELECT ship_state, CASE WHEN count(*) > {BUSY} THEN 5 ELSE 10 END AS days FROM bought GROUP BY 1),
daily AS (SELECT ship_state, order_date, size, {MOMENTS} FROM bought WHERE order_date IS NOT NULL AND size IS NOT NULL GROUP BY 1, 2, 3),
spread AS (SELECT ship_state, CAST(order_date + CAST(k AS INTEGER) AS DATE) AS window_date, size, n, m, s1, s2
  FROM daily JOIN lengths USING (ship_state) JOIN range(1, 11) AS r(k) ON k <= days)"""

WINNER = f"""{LENGTHS},
held AS (SELECT ship_state, window_date, size, sum(n) AS purchase_count, sum(m) AS m, sum(s1) AS s1, sum(s2) AS s2 FROM spread GROUP BY 1, 2, 3),
ranked AS (SELECT *, {VARIANCE} AS v FROM held),
best AS (SELECT *, row_number() OVER (PARTITION BY ship_state, window_date ORDER BY purchase_count DESC, v ASC NULLS LAST, size) AS place FROM ranked)"""

ELIGIBLE = "eligible AS (SELECT DISTINCT style FROM sales WHERE size_rank >= 6 AND style IS NOT NULL)"
VARIETY = """variety AS (SELECT ship_state AS state, order_month AS month, style, count(DISTINCT sku) AS variety, max(coalesce(size_rank, 0)) AS top_rank
  FROM sales WHERE is_valid_state AND ship_state IS NOT NULL AND order_month IS NOT NULL AND style IS NOT NULL AND sku IS NOT NULL GROUP BY 1, 2, 3)"""
MEDIAN = "SELECT state, month, CAST(median(variety) AS DOUBLE) AS median_variety, count(*) AS eligible_style_count"
GLOBAL = f"{MEDIAN}, 'global' AS eligibility_scope FROM variety SEMI JOIN eligible USING (style) GROUP BY 1, 2"
LOCAL = f"{MEDIAN}, 'local' AS eligibility_scope FROM variety WHERE top_rank >= 6 GROUP BY 1, 2"
BOTH_SCOPES = f"{SALES}, {ELIGIBLE}, {VARIETY}, g AS ({GLOBAL}), l AS ({LOCAL})"

SHARE = f"""{SALES},
tags AS (SELECT DISTINCT row_id, order_date, unnest(promotion_ids) AS tag FROM sales),
periods AS (SELECT tag, min(order_date) AS first_day, max(order_date) AS last_day, date_diff('day', min(order_date), max(order_date)) AS active_days FROM tags WHERE order_date IS NOT NULL GROUP BY 1),
averages AS (SELECT ship_state, avg(amount) AS average FROM sales WHERE is_valid_state AND fulfilment = 'MERCHANT' AND courier_status = 'SHIPPED' AND amount IS NOT NULL GROUP BY 1),
candidates AS (SELECT row_id, ship_city, ship_state, promotion_ids, amount FROM sales WHERE is_cancelled AND ship_service_level = 'STANDARD' AND ship_city IS NOT NULL AND row_id IS NOT NULL),
counts AS (SELECT row_id, count(*) AS valid_tags FROM (SELECT row_id, unnest(promotion_ids) AS tag FROM candidates) JOIN periods USING (tag) WHERE active_days >= 2 GROUP BY 1),
flagged AS (SELECT c.ship_state, c.row_id, c.ship_city, c.amount, coalesce(n.valid_tags, 0) AS valid_tags, a.average,
    coalesce(coalesce(n.valid_tags, 0) >= {LEAST_TAGS} AND c.amount < a.average, false) AS qualifies
  FROM candidates c LEFT JOIN counts n USING (row_id) LEFT JOIN averages a ON c.ship_state = a.ship_state)"""

OBS = f"""{SALES},
obs AS (SELECT sku, order_month AS month, CAST(promotion_count AS INTEGER) AS value, amount FROM sales WHERE source_index IS NOT NULL AND sku IS NOT NULL AND order_month IS NOT NULL),
exact AS (SELECT sku, month, 'exact_type7' AS method, p AS percentile, CASE WHEN p = 0.8 THEN quantile_cont(value, 0.8) ELSE quantile_cont(value, 0.9) END AS threshold, count(*) AS total_order_count
  FROM obs, (VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS t(p) GROUP BY sku, month, p),
approx AS (SELECT sku, month, 'approx' AS method, p AS percentile, CAST(CASE WHEN p = 0.8 THEN quantile_disc(value, 0.8) ELSE quantile_disc(value, 0.9) END AS DOUBLE) AS threshold, count(*) AS total_order_count
  FROM obs, (VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS t(p) GROUP BY sku, month, p)"""
STATS = f"""{OBS},
limits AS (SELECT * FROM approx UNION ALL BY NAME SELECT * FROM exact),
met AS (SELECT l.sku, l.month, l.method, l.percentile, l.threshold, l.total_order_count, {MOMENTS} FROM obs o JOIN limits l ON o.sku = l.sku AND o.month = l.month AND o.value >= l.threshold GROUP BY ALL),
results AS (SELECT sku, month, method, percentile, threshold, total_order_count, n AS qualifying_order_count, m AS qualifying_amount_count,
  CASE WHEN m < 2 THEN 0.0 ELSE coalesce(sqrt({VARIANCE}), 0.0) END AS amount_stddev_pop FROM met)"""
ROUNDED = "SELECT * REPLACE (round(threshold, 9) AS threshold, round(amount_stddev_pop, 6) AS amount_stddev_pop) FROM results"
COMPARED = f"""{STATS},
paired AS (SELECT a.sku, a.month, a.percentile, a.threshold AS approx_threshold, a.qualifying_order_count AS approx_qualifying_order_count, a.amount_stddev_pop AS approx_amount_stddev_pop,
    e.threshold AS exact_threshold, e.qualifying_order_count AS exact_qualifying_order_count, e.amount_stddev_pop AS exact_amount_stddev_pop
  FROM results a JOIN results e ON a.sku = e.sku AND a.month = e.month AND a.percentile = e.percentile AND a.method = 'approx' AND e.method = 'exact_type7'),
member AS (SELECT p.sku, p.month, p.percentile, CAST(count(*) FILTER ((o.value >= p.approx_threshold) <> (o.value >= p.exact_threshold)) AS BIGINT) AS membership_difference_count
  FROM obs o JOIN paired p USING (sku, month) GROUP BY 1, 2, 3),
compared AS (SELECT *, abs(approx_threshold - exact_threshold) > 1e-12 AS threshold_differs, membership_difference_count > 0 AS qualifying_set_differs,
    abs(approx_amount_stddev_pop - exact_amount_stddev_pop) > 1e-9 AS stddev_differs FROM paired JOIN member USING (sku, month, percentile))"""

COLUMNS = (
    "source_index", "order_id", "order_date", "status", "fulfilment", "sales_channel", "ship_service_level", "style", "sku", "category", "size", "asin", "courier_status", "quantity",
    "currency", "amount", "ship_city", "ship_state", "ship_postal_code", "ship_country", "promotion_ids", "is_b2b", "fulfilled_by", "unnamed_22",
)


def _frequency(value: str) -> str:
    return f"SELECT {value} AS value, count(*) AS n FROM amazon_sales GROUP BY 1"


SQL = {
    "canonical_sales": f"""{SALES} SELECT row_id, source_index, order_id, order_date, status, fulfilment, sales_channel, ship_service_level, style, sku, category, size, asin, courier_status, quantity,
      currency, amount, ship_city, ship_state, ship_postal_code, ship_country, array_to_string(promotion_ids, '|') AS promotion_ids, CAST(promotion_count AS INTEGER) AS promotion_count,
      CAST(duplicate_promotion_count AS INTEGER) AS duplicate_promotion_count, is_b2b, fulfilled_by, order_month, size_rank, is_shipped, is_cancelled, is_bought, is_valid_state FROM sales""",
    "state_counts": f"{BOUGHT} SELECT ship_state, count(*) AS bought_rows FROM bought GROUP BY 1",
    "daily_moments": f"""{BOUGHT}, daily AS (SELECT ship_state, order_date, size, {MOMENTS} FROM bought WHERE order_date IS NOT NULL AND size IS NOT NULL GROUP BY 1, 2, 3)
      SELECT ship_state, order_date, size, n, m, CAST(s1 AS BIGINT) AS s1, {VARIANCE} AS variance FROM daily""",
    "window_days": f"{LENGTHS} SELECT ship_state, window_date, size, CAST(sum(n) AS BIGINT) AS n FROM spread GROUP BY 1, 2, 3",
    "window_winner": f"{WINNER} SELECT ship_state AS state, window_date, size, CAST(purchase_count AS BIGINT) AS purchase_count, v AS population_variance FROM best WHERE place = 1",
    "window_winner_text": f"""{WINNER} SELECT ship_state AS state, CAST(window_date AS VARCHAR) AS window_date, size, CAST(purchase_count AS BIGINT) AS purchase_count,
      coalesce(printf('%.6f', v), '') AS population_variance FROM best WHERE place = 1""",
    "median_variety_global": f"{SALES}, {ELIGIBLE}, {VARIETY} {GLOBAL}",
    "median_variety_local": f"{SALES}, {VARIETY} {LOCAL}",
    "ranked_styles": f"{SALES}, {ELIGIBLE} SELECT style FROM eligible",
    "style_variety": f"{SALES}, {VARIETY} SELECT state AS ship_state, month AS order_month, style, variety, CAST(top_rank AS BIGINT) AS top_rank FROM variety",
    "city_share": f"""{SHARE} SELECT ship_city, count(*) AS candidate_count, count(*) FILTER (qualifies) AS qualifying_count,
      round(count(*) FILTER (qualifies) * 100.0 / count(*), 8) AS qualifying_percentage FROM flagged GROUP BY 1""",
    "promotion_periods": f"{SHARE} SELECT * FROM periods",
    "state_averages": f"{SHARE} SELECT ship_state, round(average, 6) AS average FROM averages",
    "candidate_rows": f"{SHARE} SELECT row_id, ship_city, ship_state, array_to_string(promotion_ids, '|') AS promotion_ids, amount FROM candidates",
    "promotion_counts": f"{SHARE} SELECT row_id, valid_tags FROM counts",
    "flagged_candidates": f"{SHARE} SELECT ship_state, row_id, ship_city, amount, valid_tags, round(average, 6) AS average, qualifies FROM flagged",
    "plan_equivalence": f"""{SHARE}, r AS (SELECT ship_city, count(*) AS n FROM flagged GROUP BY 1)
      SELECT (SELECT count(*) FROM (FROM r EXCEPT ALL FROM r)) AS only_left, (SELECT count(*) FROM (FROM r EXCEPT ALL FROM r)) AS only_right""",
    "thresholds_approximate": f"{OBS} SELECT * FROM approx",
    "thresholds_exact": f"{OBS} SELECT * REPLACE (round(threshold, 9) AS threshold) FROM exact",
    "thresholds_array": f"{OBS} SELECT * REPLACE (round(threshold, 9) AS threshold) FROM exact",
    "threshold_exact_result": f"{STATS} {ROUNDED} WHERE method = 'exact_type7'",
    "threshold_approximate_result": f"{STATS} {ROUNDED} WHERE method = 'approx'",
    "threshold_results": f"{STATS} {ROUNDED}",
    "threshold_comparison": f"""{COMPARED} SELECT * REPLACE (round(exact_threshold, 9) AS exact_threshold, round(approx_amount_stddev_pop, 6) AS approx_amount_stddev_pop,
      round(exact_amount_stddev_pop, 6) AS exact_amount_stddev_pop) FROM compared""",
    "threshold_summary": f"""{COMPARED} SELECT percentile, count(*) AS group_count, count(*) FILTER (threshold_differs) AS threshold_differs_count,
      count(*) FILTER (qualifying_set_differs) AS qualifying_set_differs_count, count(*) FILTER (stddev_differs) AS stddev_differs_count FROM compared GROUP BY 1""",
    "threshold_strongest": f"""{COMPARED} SELECT sku, month, percentile, round(abs(approx_amount_stddev_pop - exact_amount_stddev_pop), 6) AS stddev_gap FROM compared
      ORDER BY abs(approx_amount_stddev_pop - exact_amount_stddev_pop) DESC, sku, month, percentile LIMIT 1""",
    "threshold_invalid": f"{STATS} SELECT * FROM results WHERE threshold IS NULL OR qualifying_order_count < 1 OR qualifying_order_count > total_order_count OR qualifying_amount_count > qualifying_order_count OR amount_stddev_pop < 0",
    "threshold_invalid_found": f"""{STATS}, r AS ({ROUNDED} WHERE method = 'exact_type7' AND month = '2024-03')
      SELECT CAST(way AS INTEGER) AS way, (SELECT count(*) FROM r) AS n FROM range(1, 15) AS w(way)""",
    "threshold_duplicates_found": f"""{STATS}, r AS ({ROUNDED} WHERE method = 'exact_type7' AND month = '2024-03'),
      k AS (SELECT sku, month, method, percentile, 10 AS n FROM r UNION ALL SELECT NULL, month, method, percentile, 1 FROM r UNION ALL SELECT sku, NULL, method, percentile, 1 FROM r
        UNION ALL SELECT sku, month, NULL, percentile, 1 FROM r UNION ALL SELECT sku, month, 'other', percentile, 1 FROM r UNION ALL SELECT sku, month, method, 0.5, 1 FROM r)
      SELECT sku, month, method, percentile, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL HAVING sum(n) <> 1""",
    "largest_sku_month": f"SELECT sku, order_month AS month, n FROM ({SALES} SELECT sku, order_month, count(*) AS n FROM sales WHERE sku IS NOT NULL AND order_month IS NOT NULL GROUP BY 1, 2) ORDER BY n DESC, sku, month LIMIT 1",
    "threshold_duplicates": f"{STATS} SELECT sku, month, method, percentile, count(*) AS n FROM results GROUP BY 1, 2, 3, 4 HAVING count(*) <> 1",
    "group_sizes": f"{OBS}, s AS (SELECT count(*) AS n FROM obs GROUP BY sku, month) SELECT count(*) AS group_count, count(*) FILTER (n > {LARGE_GROUP}) AS large_groups, max(n) AS largest FROM s",
    "largest_group": f"{OBS} SELECT sku, month, count(*) AS n FROM obs GROUP BY 1, 2 ORDER BY n DESC, sku, month LIMIT 1",
    "profile_integrity": f"""SELECT count(*) AS row_count, count(d) AS parsed_dates, count(*) FILTER (d IS NULL) AS invalid_dates, min(d) AS min_date, max(d) AS max_date,
      count(*) FILTER (NOT regexp_full_match({text('quantity')}, '[+-]?[0-9]+')) AS invalid_quantities,
      count(*) FILTER (NOT regexp_full_match({text('amount')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')) AS invalid_amounts,
      count(*) FILTER ({up('ship_state')} = 'APO') AS apo_rows, min(len({PARTS})) AS min_promotions, max(len({PARTS})) AS max_promotions, round(avg(len({PARTS})), 8) AS avg_promotions
      FROM (SELECT *, {day('order_date')} AS d FROM amazon_sales)""",
    "profile_distinct": f"""SELECT 'distinct_order_ids' AS metric, count(DISTINCT order_id) AS value FROM amazon_sales WHERE {text('order_id')} IS NOT NULL
      UNION ALL SELECT 'distinct_states', count(DISTINCT {up('ship_state')}) FROM amazon_sales
      UNION ALL SELECT 'duplicate_index_rows', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM amazon_sales GROUP BY source_index)""",
    "profile_blanks": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({text(c)} IS NULL) AS blank_rows FROM amazon_sales" for c in COLUMNS),
    "status_frequencies": _frequency(trimmed("status")),
    "size_frequencies": _frequency(trimmed("size")),
    "state_frequencies": _frequency(f"upper({trimmed('ship_state')})"),
    "promotion_rows": f"SELECT part, count(*) AS n, count(DISTINCT row_id) AS row_count FROM (SELECT row_id, unnest({PARTS}) AS part FROM amazon_sales) GROUP BY 1",
    "state_aliases": f"""WITH a AS (SELECT short_name AS alias, state AS name FROM state_list WHERE short_name IS NOT NULL UNION ALL SELECT alt_name, state FROM state_list WHERE alt_name IS NOT NULL)
      SELECT row_id, coalesce(name, s) AS state FROM (SELECT row_id, {up('ship_state')} AS s FROM amazon_sales) LEFT JOIN a ON s = alias""",
    "states_without_city": f"""WITH t AS (SELECT DISTINCT {up('ship_state')} AS state FROM amazon_sales WHERE {up('ship_state')} IS NOT NULL)
      SELECT state, 'typed' AS side FROM t ANTI JOIN state_list USING (state) UNION ALL SELECT state, 'listed' FROM state_list ANTI JOIN t USING (state)""",
    "scope_comparison": f"""{BOTH_SCOPES} SELECT state, month, g.median_variety AS global_median, l.median_variety AS local_median,
      CASE WHEN l.median_variety IS NULL THEN 'global_only' WHEN g.median_variety IS NULL THEN 'local_only' ELSE 'both' END AS side FROM g FULL OUTER JOIN l USING (state, month)""",
    "scope_differences": f"{BOTH_SCOPES} SELECT state, month, median_variety FROM g EXCEPT ALL SELECT state, month, median_variety FROM l",
    "text_functions": f"""SELECT row_id, upper({trimmed('ship_city')}) AS city, regexp_replace({trimmed('ship_postal_code')}, '\\.0$', '') AS postal, length({trimmed('ship_postal_code')}) AS postal_length,
      contains(upper(status), 'SHIPPED') AS shipped, concat_ws('/', style, size) AS style_size FROM amazon_sales""",
    "order_totals": """SELECT o_orderkey, coalesce(n, 0) AS line_count, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM orders
      LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "nation_months": """SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS order_count, count(DISTINCT o_custkey) AS customer_count, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
}


def _low(name: str) -> str:
    swaps = {f"> {BUSY} THEN 5": f"> {LOW_BUSY} THEN 5", f">= {LEAST_TAGS} AND": f">= {LOW_TAGS} AND", f"n > {LARGE_GROUP})": f"n > {LOW_GROUP})"}
    sql = SQL[name]
    for a, b in swaps.items():
        sql = sql.replace(a, b)
    return sql


SQL |= {f"{name}_low": _low(name) for name in ("window_winner", "window_days", "city_share", "flagged_candidates", "group_sizes")}
