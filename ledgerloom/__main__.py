"""Run the sales questions on a CSV file: python -m ledgerloom <command> ...

    window-winner  <input.csv> <output.csv>                     leading size per state and day
    median-variety <input.csv> <output.csv> [global|local]      median distinct SKUs per style
    city-share     <input.csv> <output.parquet>                 share of qualifying candidates per city
    compare-plans  <input.csv>                                  the same by broadcast and by sort-merge joins
    thresholds     <input.csv> <output.parquet> [runs >= 5]     percentile thresholds, approximate and exact
    profile        <input.csv> <report.md>                      data profile
    lines          <input>                                      physical lines of text files
    round-trip     <input.csv> <folder> [rows]                  CSV and Parquet copies read back

Exit code 0: done; 1: a check of the result failed; 2: wrong arguments. Malformed rows are left out and counted; metrics go to stdout as KEY=VALUE.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.text import fixed_decimals
from .operators import conditional_share, profile, thresholds, variety, window_winner
from .plans import inspect
from .session import session
from .sources import sales, sinks

GROUP = ["sku", "month"]


def say(**values: object) -> None:
    for key, value in values.items():
        print(f"{key.upper()}={value}")


def load(spark: SparkSession, path: str) -> DataFrame:
    good, bad = sales.read_sales(spark, path)
    say(malformed_rows=bad.count())
    return good


def say_counts(seen: Observation, prefix: str = "") -> None:
    say(**{f"{prefix}{k}": v for k, v in seen.get.items()})


def run_window_winner(spark: SparkSession, source: str, target: str) -> bool:
    c = F.col
    used = c("is_bought") & c("is_valid_state")
    fields = c("order_date").isNotNull() & c("size").isNotNull()
    rows, read = inspect.counted(
        load(spark, source), "window_input", bought_rows=used, invalid_states=c("is_bought") & ~c("is_valid_state"), invalid_fields=used & ~fields, null_amounts=used & fields & c("amount").isNull()
    )
    # The states' counts are the side file by which window lengths are known; written once, read back and checked.
    rows = rows.where(used).persist()
    side = f"{target}.states.tsv"
    sinks.write_single_file(rows.where(c("ship_state").isNotNull()).groupBy("ship_state").agg(F.count(F.lit(1)).alias("n")), side, "tsv", ["ship_state"])
    busy = F.when(c("n") > window_winner.BUSY, window_winner.SHORT).otherwise(window_winner.LONG)
    spread = rows.where(fields).join(sinks.read_counts(spark, side).withColumnRenamed("key", "ship_state"), "ship_state").agg(F.sum(busy)).first()[0]
    found = window_winner.window_winner(rows, "ship_state", "order_date", "size", "amount")
    named = found.withColumnRenamed("ship_state", "state").withColumn("population_variance", fixed_decimals("population_variance", 6))
    counted, seen = inspect.counted(named, "window_winner")
    sinks.write_single_file(counted, target, "csv", ["state", "window_date"])
    rows.unpersist()
    say_counts(read, "input_")
    say(buckets_emitted=spread or 0, output_rows=seen.get["row_count"])
    return True


def run_median_variety(spark: SparkSession, source: str, target: str, scope: str = "global") -> bool:
    if scope.lower() not in variety.SCOPES:
        raise ValueError(f"scope is one of {variety.SCOPES}")
    c = F.col
    whole = c("is_valid_state") & c("ship_state").isNotNull() & c("order_month").isNotNull() & c("style").isNotNull() & c("sku").isNotNull()
    rows, read = inspect.counted(load(spark, source), "variety_input", large_size_rows=c("size_rank") >= 6, whole_rows=whole, invalid_rows=~whole)
    rows = rows.persist()
    styles = variety.ranked_families(rows, "style", "size_rank", 6)
    side = f"{target}.styles.tsv"
    sinks.write_single_file(styles, side, "tsv", ["style"])
    eligible = spark.read.text(side).count()
    valid = rows.where("is_valid_state").select(c("ship_state").alias("state"), c("order_month").alias("month"), "style", "sku", "size_rank")
    found = variety.median_variety(valid, "state", "month", "style", "sku", "size_rank", scope=scope, universe=rows)
    counted, seen = inspect.counted(found.withColumn("median_variety", fixed_decimals("median_variety", 1)), "variety", even_groups=c("eligible_style_count") % 2 == 0)
    sinks.write_single_file(counted, target, "csv", ["state", "month"])
    rows.unpersist()
    say_counts(read, "input_")
    say(eligible_styles=eligible, variety_rows=variety.family_variety(valid, "state", "month", "style", "sku", "size_rank").count())
    say_counts(seen, "output_")
    return True


def city_frames(rows: DataFrame, strategy: str = "auto") -> conditional_share.Frames:
    averaged = F.expr("is_valid_state AND fulfilment = 'MERCHANT' AND courier_status = 'SHIPPED'")
    candidate = F.expr("is_cancelled AND ship_service_level = 'STANDARD'")
    return conditional_share.conditional_share(rows, "source_index", "ship_city", "ship_state", "order_date", "promotion_ids", "amount", averaged, candidate, strategy=strategy)


def run_city_share(spark: SparkSession, source: str, target: str) -> bool:
    frames = city_frames(load(spark, source))
    named = frames.result.withColumnsRenamed({"candidate_count": "cancelled_standard_order_count", "qualifying_count": "qualifying_order_count"})
    sinks.write_single_file(named, target, "parquet", ["ship_city"])
    back = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("cities"), F.sum("cancelled_standard_order_count").alias("candidates"), F.min("qualifying_percentage").alias("low"), F.max("qualifying_percentage").alias("high")).first()
    candidates = frames.candidates.count()
    say(cities=back["cities"], candidates=candidates)
    return (back["candidates"] or 0) == candidates and (back["low"] is None or 0 <= back["low"] <= back["high"] <= 100)


def run_compare_plans(spark: SparkSession, source: str) -> bool:
    rows = load(spark, source)
    results = {s: city_frames(rows, s).result for s in ("broadcast", "merge")}
    for name, df in results.items():
        print(f"PLAN_{name.upper()}_BEGIN\n{inspect.plan_text(df)}\nPLAN_{name.upper()}_END")
        say(**{f"{name}_{k}": v for k, v in inspect.plan_counts(df).items()})
    left, right = inspect.equivalent(*results.values()).first()
    say(only_broadcast=left, only_merge=right)
    return left == right == 0


def run_thresholds(spark: SparkSession, source: str, target: str, runs: str = "5") -> bool:
    if not runs.isdigit() or int(runs) < 5:
        raise ValueError("at least 5 runs")
    rows = load(spark, source).withColumn("month", F.col("order_month"))
    obs = thresholds.observations(rows, "source_index", GROUP, "promotion_count", "amount").persist()
    sizes = profile.group_sizes(obs, GROUP).first()
    groups, input_rows = sizes["group_count"], obs.count()
    partition = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    estimate = profile.partition_estimate(sinks.Files(spark, source).size(source), input_rows, sizes["largest"] or 0, partition)
    say(input_rows=input_rows, groups_over_1000=sizes["large_groups"], largest_group_rows=sizes["largest"] or 0, largest_group_bytes=round(estimate["largest_bytes"]), fits_partition=estimate["fits"])
    results = {"approx": thresholds.approximate_result(obs, GROUP), "exact": thresholds.exact_result(obs, GROUP)}
    took = inspect.interleaved({k: (lambda d=d: thresholds.checksum(d).collect()) for k, d in results.items()}, int(runs))
    for name, t in took.items():
        say(**{f"{name}_mean_seconds": round(t["mean"], 6), f"{name}_stddev_seconds": round(t["stddev"], 6)})
    compared = thresholds.compare(obs, GROUP).persist()
    for r in thresholds.summary(compared).orderBy("percentile").collect():
        say(**{f"p{round(r['percentile'] * 100)}_{k}": v for k, v in r.asDict().items() if k != "percentile"})
    for r in thresholds.strongest(compared, GROUP).collect():
        say(strongest_difference=f"{r['sku']} {r['month']} {r['percentile']} {r['stddev_gap']}")
    both = results["approx"].unionByName(results["exact"])
    sinks.write_single_file(both, target, "parquet", [*GROUP, "method", "percentile"])
    back = spark.read.parquet(target)
    invalid, repeated, n = thresholds.invalid_rows(back).count(), thresholds.duplicate_keys(back, [*GROUP, "method", "percentile"]).count(), back.count()
    say(groups=groups, output_rows=n, invalid_rows=invalid, duplicate_keys=repeated)
    compared.unpersist()
    obs.unpersist()
    return invalid == repeated == 0 and n == 4 * groups


def run_profile(spark: SparkSession, source: str, target: str) -> bool:
    raw = sales.read_raw(spark, source).persist()
    try:
        sinks.write_text(target, profile.report(raw, sales.SALES_COLUMNS))
    finally:
        raw.unpersist()
    return True


def run_lines(spark: SparkSession, source: str) -> bool:
    say(lines=sinks.line_count(spark, source).first()["lines"])
    return True


def run_round_trip(spark: SparkSession, source: str, folder: str, rows: str = "100") -> bool:
    counts = sinks.round_trip(spark, load(spark, source).limit(int(rows)), folder)
    say(rows=counts[0], csv_rows=counts[1], parquet_rows=counts[2])
    return counts[0] == counts[1] == counts[2]


COMMANDS: dict[str, tuple[Callable[..., bool], int, int]] = {
    "window-winner": (run_window_winner, 2, 2), "median-variety": (run_median_variety, 2, 3), "city-share": (run_city_share, 2, 2), "compare-plans": (run_compare_plans, 1, 1),
    "thresholds": (run_thresholds, 2, 3), "profile": (run_profile, 2, 2), "lines": (run_lines, 1, 1), "round-trip": (run_round_trip, 2, 3),
}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    command, least, most = COMMANDS.get(args[0] if args else "", (None, 0, 0))
    if command is None or not least <= len(args) - 1 <= most:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        return 0 if command(spark or session("ledgerloom"), *args[1:]) else 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
