"""The analytical questions over the sales table and one query per building block.

Which rows count as bought, candidate or reference is a parameter of the operators; the predicates here are the questions' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed_decimals, list_items, trimmed, upper_text
from ..operators import conditional_share, profile, thresholds, variety, window_winner
from ..sources.sales import SALES_COLUMNS, canonical
from ..sources.tables import table
from .inspect import equivalent

#: Fixed values of the questions: rows of a state above which its window is short, least promotions of a qualifying row, rows of a large group.
BUSY, LEAST_TAGS, LARGE_GROUP = 10_000, 3, 1000
#: The same rules at values that small tables reach, so that both sides of each rule occur there: queries whose names end in _low.
LOW_BUSY, LOW_TAGS, LOW_GROUP = 500, 1, 20
GROUP = ["sku", "month"]


def sales(spark: SparkSession, d: str) -> DataFrame:
    return canonical(table(spark, d, "amazon_sales"), keep=("row_id",))


def canonical_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).withColumn("promotion_ids", F.array_join("promotion_ids", "|"))


def bought(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).where("is_bought AND is_valid_state")


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return bought(spark, d).groupBy("ship_state").agg(F.count(F.lit(1)).alias("bought_rows"))


def daily_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = bought(spark, d).where("order_date IS NOT NULL AND size IS NOT NULL")
    m = window_winner.moments(rows, "ship_state", "order_date", "size", "amount")
    variance = window_winner.variance_of()
    return m.select("ship_state", "order_date", "size", "n", "m", F.col("s1").cast("bigint").alias("s1"), variance.alias("variance"))


def _window_days(spark: SparkSession, d: str, busy: int) -> DataFrame:
    rows = bought(spark, d)
    lengths = state_counts(spark, d).select("ship_state", F.when(F.col("bought_rows") > busy, 5).otherwise(10).alias("days"))
    days = rows.where("order_date IS NOT NULL AND size IS NOT NULL").groupBy("ship_state", "order_date", "size").agg(F.count(F.lit(1)).alias("n"))
    spread = window_winner.spread_days(days.join(lengths, "ship_state"), "order_date", F.col("days"))
    return spread.groupBy("ship_state", "window_date", "size").agg(F.sum("n").alias("n"))


def window_days(spark: SparkSession, d: str) -> DataFrame:
    """Days spread over the dates whose window holds them, joined to the state's length by a join Catalyst picks from measured sizes."""
    return _window_days(spark, d, BUSY)


def window_days_low(spark: SparkSession, d: str) -> DataFrame:
    return _window_days(spark, d, LOW_BUSY)


def _winner(spark: SparkSession, d: str, busy: int) -> DataFrame:
    found = window_winner.window_winner(bought(spark, d), "ship_state", "order_date", "size", "amount", busy_above=busy)
    return found.select(F.col("ship_state").alias("state"), "window_date", "size", "purchase_count", "population_variance")


def winner(spark: SparkSession, d: str) -> DataFrame:
    """Most bought size per state and day over the preceding 5 or 10 days."""
    return _winner(spark, d, BUSY)


def winner_low(spark: SparkSession, d: str) -> DataFrame:
    return _winner(spark, d, LOW_BUSY)


def text_form(found: DataFrame) -> DataFrame:
    """A winner's row as its text file has it: six decimals, undefined variance empty."""
    return found.select("state", F.col("window_date").cast("string").alias("window_date"), "size", "purchase_count", F.coalesce(fixed_decimals("population_variance", 6), F.lit("")).alias("population_variance"))


def winner_text(spark: SparkSession, d: str) -> DataFrame:
    return text_form(winner(spark, d))


def _variety(spark: SparkSession, d: str, scope: str) -> DataFrame:
    rows = sales(spark, d)
    valid = rows.where("is_valid_state").select(F.col("ship_state").alias("state"), F.col("order_month").alias("month"), "style", "sku", "size_rank")
    return variety.median_variety(valid, "state", "month", "style", "sku", "size_rank", scope=scope, universe=rows)


def median_variety_global(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, "global")


def median_variety_local(spark: SparkSession, d: str) -> DataFrame:
    return _variety(spark, d, "local")


def ranked_styles(spark: SparkSession, d: str) -> DataFrame:
    return variety.ranked_families(sales(spark, d), "style", "size_rank", 6)


def style_variety(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d).where("is_valid_state")
    found = variety.family_variety(rows, "ship_state", "order_month", "style", "sku", "size_rank")
    return found.withColumn("top_rank", F.col("top_rank").cast("bigint"))


def _share(spark: SparkSession, d: str, strategy: str = "auto", least_tags: int = LEAST_TAGS) -> conditional_share.Frames:
    rows = sales(spark, d)
    averaged = F.expr("is_valid_state AND fulfilment = 'MERCHANT' AND courier_status = 'SHIPPED'")
    candidate = F.expr("is_cancelled AND ship_service_level = 'STANDARD'")
    return conditional_share.conditional_share(rows, "row_id", "ship_city", "ship_state", "order_date", "promotion_ids", "amount", averaged, candidate, least_tags=least_tags, strategy=strategy)


def city_share(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).result.withColumn("qualifying_percentage", F.round("qualifying_percentage", 8))


def city_share_low(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d, least_tags=LOW_TAGS).result.withColumn("qualifying_percentage", F.round("qualifying_percentage", 8))


def promotion_periods(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).periods


def state_averages(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).averages.withColumn("average", F.round("average", 6))


def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).candidates.withColumn("promotion_ids", F.array_join("promotion_ids", "|"))


def promotion_counts(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).tag_counts


def flagged_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).flagged.withColumn("average", F.round("average", 6))


def flagged_candidates_low(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d, least_tags=LOW_TAGS).flagged.withColumn("average", F.round("average", 6))


def plan_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which the broadcast and the sort-merge plan of city_share differ; (0, 0) is the expected result."""
    return equivalent(_share(spark, d, "broadcast").result, _share(spark, d, "merge").result)


def observations(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d).withColumn("month", F.col("order_month"))
    return thresholds.observations(rows, "source_index", GROUP, "promotion_count", "amount")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"threshold": F.round("threshold", 9), "amount_stddev_pop": F.round("amount_stddev_pop", 6)})


def thresholds_approximate(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.approximate(observations(spark, d), GROUP)


def thresholds_exact(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.exact(observations(spark, d), GROUP).withColumn("threshold", F.round("threshold", 9))


def thresholds_array(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.exact_by_array(observations(spark, d), GROUP).withColumn("threshold", F.round("threshold", 9))


def threshold_exact_result(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.exact_result(observations(spark, d), GROUP))


def threshold_approximate_result(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.approximate_result(observations(spark, d), GROUP))


def threshold_results(spark: SparkSession, d: str) -> DataFrame:
    """Both methods' results in one frame."""
    obs = observations(spark, d)
    return _rounded(thresholds.approximate_result(obs, GROUP).unionByName(thresholds.exact_result(obs, GROUP)))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.compare(observations(spark, d), GROUP)


def threshold_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = _compared(spark, d)
    return c.withColumns({"exact_threshold": F.round("exact_threshold", 9), **{x: F.round(x, 6) for x in ("approx_amount_stddev_pop", "exact_amount_stddev_pop")}})


def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.summary(_compared(spark, d)).orderBy("percentile")


def threshold_strongest(spark: SparkSession, d: str) -> DataFrame:
    top = thresholds.strongest(_compared(spark, d), GROUP)
    return top.select(*GROUP, "percentile", F.round("stddev_gap", 6).alias("stddev_gap"))


def threshold_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Result rows that break an invariant; none is the expected result."""
    return thresholds.invalid_rows(threshold_results(spark, d))


def spoiled_results(spark: SparkSession, d: str) -> DataFrame:
    """Every result row of month `2024-03` once for each way to break it, and once as it is: what invalid rows and repeated keys are found in."""
    r = _rounded(thresholds.exact_result(observations(spark, d), GROUP)).where("month = '2024-03'")
    none, n = F.lit(None), F.col("total_order_count")
    ways: list[dict[str, Column]] = [
        {}, {"sku": none}, {"month": none}, {"method": none}, {"threshold": none}, {"amount_stddev_pop": none}, {"total_order_count": F.lit(0)}, {"qualifying_amount_count": F.col("qualifying_order_count") + 1},
        {"qualifying_order_count": n + 1, "qualifying_amount_count": n}, {"amount_stddev_pop": F.lit(-1.0)}, {"qualifying_amount_count": F.lit(1), "amount_stddev_pop": F.lit(1.0)},
        {"method": F.lit("other")}, {"percentile": F.lit(0.5)}, {"threshold": F.lit(float("nan"))}, {"qualifying_order_count": none},
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("way"), *[w.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in r.schema.fields]) for k, w in enumerate(ways)])
    return r.select(F.explode(rows).alias("_r")).select("_r.*")


def threshold_invalid_found(spark: SparkSession, d: str) -> DataFrame:
    """(way, n): spoiled rows reported, by the way they were spoiled; way 0, rows as they are, has none."""
    return thresholds.invalid_rows(spoiled_results(spark, d)).groupBy("way").agg(F.count(F.lit(1)).alias("n"))


def threshold_duplicates_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that spoiling repeated, with their number of rows."""
    return thresholds.duplicate_keys(spoiled_results(spark, d), [*GROUP, "method", "percentile"]).select(*GROUP, "method", "percentile", "n")


def threshold_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.duplicate_keys(threshold_results(spark, d), [*GROUP, "method", "percentile"])


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return profile.group_sizes(observations(spark, d), GROUP, above=LARGE_GROUP)


def group_sizes_low(spark: SparkSession, d: str) -> DataFrame:
    return profile.group_sizes(observations(spark, d), GROUP, above=LOW_GROUP)


def largest_sku_month(spark: SparkSession, d: str) -> DataFrame:
    """The SKU and month with most rows, over all rows with both, whether or not they have a key."""
    return profile.largest_sku_month(_raw(spark, d))


def largest_group(spark: SparkSession, d: str) -> DataFrame:
    return profile.largest_group(observations(spark, d), GROUP)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "amazon_sales")


def profile_integrity(spark: SparkSession, d: str) -> DataFrame:
    return profile.integrity(_raw(spark, d)).withColumn("avg_promotions", F.round("avg_promotions", 8))


def profile_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_values(_raw(spark, d))


def profile_blanks(spark: SparkSession, d: str) -> DataFrame:
    return profile.blanks(_raw(spark, d), SALES_COLUMNS)


def status_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(_raw(spark, d), "status")


def size_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(_raw(spark, d), "size")


def state_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(_raw(spark, d), "ship_state", upper=True)


def promotion_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per comma-separated part; rows without parts drop out."""
    return _raw(spark, d).select("row_id", F.explode(list_items("promotion_ids")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_count"))


def state_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Optional canonical state by exact alias, through a left join with the list."""
    names = table(spark, d, "state_list")
    pairs = names.select(F.explode(F.array_compact(F.array("short_name", "alt_name"))).alias("alias"), F.col("state").alias("name"))
    rows = _raw(spark, d).select("row_id", upper_text("ship_state").alias("state"))
    return rows.join(pairs, F.col("state") == F.col("alias"), "left").select("row_id", F.coalesce("name", "state").alias("state"))


def states_without_city(spark: SparkSession, d: str) -> DataFrame:
    """Listed states no city belongs to, and typed states outside the list: anti joins in both directions."""
    listed = table(spark, d, "state_list").select("state")
    typed = _raw(spark, d).select(upper_text("ship_state").alias("state")).where("state IS NOT NULL").distinct()
    return typed.join(listed, "state", "left_anti").withColumn("side", F.lit("typed")).unionByName(listed.join(typed, "state", "left_anti").withColumn("side", F.lit("listed")))


def scope_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Global and local medians of every key side by side, with where each key is present (full outer join)."""
    key = ["state", "month"]
    a = median_variety_global(spark, d).select(*key, F.col("median_variety").alias("global_median"))
    b = median_variety_local(spark, d).select(*key, F.col("median_variety").alias("local_median"))
    side = F.when(F.col("local_median").isNull(), "global_only").when(F.col("global_median").isNull(), "local_only").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side)


def scope_differences(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose medians differ between the scopes: EXCEPT ALL."""
    pick = ["state", "month", "median_variety"]
    return median_variety_global(spark, d).select(*pick).exceptAll(median_variety_local(spark, d).select(*pick))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d)
    c = trimmed("ship_postal_code")
    return raw.select("row_id", F.upper(trimmed("ship_city")).alias("city"), F.regexp_replace(c, r"\.0$", "").alias("postal"), F.length(c).cast("bigint").alias("postal_length"), F.contains(F.upper("status"), F.lit("SHIPPED")).alias("shipped"), F.concat_ws("/", "style", "size").alias("style_size"))


def order_totals(spark: SparkSession, d: str) -> DataFrame:
    """Line counts and totals of every order of the star schema; orders without lines stay (left join)."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("cents", F.lit(0)).alias("cents"))


def nation_months(spark: SparkSession, d: str) -> DataFrame:
    """Orders, customers and totals per nation and month of the star schema."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return rows.groupBy("n_name", month).agg(F.count(F.lit(1)).alias("order_count"), F.count_distinct("o_custkey").alias("customer_count"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


QUERIES = {"window_winner": winner, "window_winner_low": winner_low, "window_winner_text": winner_text} | {
    f.__name__: f
    for f in (
        canonical_sales, state_counts, daily_moments, window_days, window_days_low, median_variety_global, median_variety_local, ranked_styles, style_variety, city_share, city_share_low,
        promotion_periods, state_averages, candidate_rows, promotion_counts, flagged_candidates, flagged_candidates_low, plan_equivalence, thresholds_approximate, thresholds_exact,
        thresholds_array, threshold_exact_result, threshold_approximate_result, threshold_results, threshold_comparison, threshold_summary, threshold_strongest, threshold_invalid, threshold_invalid_found, threshold_duplicates, threshold_duplicates_found,
        group_sizes, group_sizes_low, largest_group, largest_sku_month, profile_integrity, profile_distinct, profile_blanks, status_frequencies, size_frequencies, state_frequencies,
        promotion_rows, state_aliases, states_without_city, scope_comparison, scope_differences, text_functions, order_totals, nation_months,
    )
}
