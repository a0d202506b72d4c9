"""Queries of the subpackage's operators over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, parse_date, text, trimmed, upper_text
from ..session import bounded_rows, cut
from ..sources.tables import table
from . import canonical, distinct, language, mixing, packing, percentiles, tokens

TARGETS = (0.5, 0.8, 0.9, 0.99)
SETS = (("sku", "month"), ("month",), ("sku",))


def _wide(found: DataFrame, groups: list[str], value: str, name: str = "p") -> DataFrame:
    """One row per group with a column per percentile."""
    pick = lambda p: F.max(F.when(F.col("p") == float(p), F.col(value))).alias(f"{name}{round(p * 100)}")
    return found.groupBy(*groups, "n_values").agg(*[pick(p) for p in TARGETS])


LEVELLED = [percentiles.LEVEL, "sku", "month"]


def _partials(spark: SparkSession, d: str, part: str) -> DataFrame:
    """Partials per `part`, stored, once for each grouping set."""
    return percentiles.spread(cut(percentiles.partials(table(spark, d, "task_2_2"), "threshold", ["sku", "month"], [part])), SETS)


def _exact_values(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles.keyed(table(spark, d, "task_2_2"), "threshold", ["sku", "month"])
    return percentiles.select_ranks(_partials(spark, d, "shard"), rows, LEVELLED, TARGETS, SETS)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of threshold per (sku, month), month and sku from partials per shard; the error bound is 0."""
    wide = _wide(_exact_values(spark, d), LEVELLED, "value")
    return wide.select(F.col(percentiles.LEVEL).alias("grouping"), "sku", "month", "n_values", *[f"p{round(p * 100)}" for p in TARGETS], F.lit(0.0).alias("error_bound"))


def p2_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Bounded estimates from partials per run_date alone."""
    return percentiles.bounded(_partials(spark, d, "run_date"), LEVELLED, TARGETS).withColumnRenamed(percentiles.LEVEL, "grouping")


def p2_bounds_held(spark: SparkSession, d: str) -> DataFrame:
    """Bounds from partials per run_date against the exact values: whether each holds its value and is as narrow as stated."""
    exact = _exact_values(spark, d).withColumnsRenamed({percentiles.LEVEL: "_grouping", "sku": "_sku", "month": "_month", "p": "_p", "n_values": "_n"})
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in ("grouping", "sku", "month", "p")]
    both = p2_bounded(spark, d).join(exact, same, "full_outer")
    held = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")) & (F.abs(F.col("value") - F.col("estimate")) <= F.col("error_bound")) & (F.col("_n") == F.col("n_values"))
    narrow = F.col("error_bound") <= F.abs("value") * 2.0**-12
    return both.select("grouping", "sku", "month", "p", "n_values", "value", F.coalesce(held, F.lit(False)).alias("is_held"), F.coalesce(narrow, F.lit(False)).alias("is_narrow"))


def _matcher(spark: SparkSession, d: str):
    cities = bounded_rows(table(spark, d, "city_list").select("city_id", "city", "alt_name", "state"), canonical.MAX_ENTRIES)
    states = bounded_rows(table(spark, d, "state_list").select("state_id", "state", "short_name", "alt_name"), canonical.MAX_ENTRIES)
    return canonical.spark_matcher(
        [(r["city_id"], r["city"], [r["alt_name"]], r["state"]) for r in cities], [(r["state_id"], r["state"], [r["short_name"], r["alt_name"]], None) for r in states], spark
    )


def _exact(sales: DataFrame, names: DataFrame, field: str, column: str) -> DataFrame:
    """`sales` with exact_<field>: the trimmed, upper-cased value is a name of the list."""
    listed = names.select(F.col(column).alias("_name")).where(F.col("_name").isNotNull()).distinct().withColumn("_exact", F.lit(True))
    joined = sales.join(listed, F.upper(trimmed(field)) == F.col("_name"), "left").drop("_name")
    return joined.withColumn(f"exact_{field}", F.coalesce("_exact", F.lit(False))).drop("_exact")


def _places(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "amazon_sales").select("row_id", "ship_city", "ship_state")
    return _exact(_exact(sales, table(spark, d, "city_list"), "ship_city", "city"), table(spark, d, "state_list"), "ship_state", "state")


def _mapped(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    mapped = _matcher(spark, d)
    return rows.withColumn("_m", mapped(trimmed("ship_city"), trimmed("ship_state"))).select(*rows.columns, "_m.*")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    places = _places(spark, d)
    city_case, state_case = ~is_blank("ship_city") & ~F.col("exact_ship_city"), ~is_blank("ship_state") & ~F.col("exact_ship_state")
    rows = _mapped(spark, d, places.where(city_case | state_case))
    cases = F.array_compact(
        F.array(
            F.when(city_case, F.struct(F.lit("ship_city").alias("field_name"), F.col("city_id").alias("entry_id"))),
            F.when(state_case, F.struct(F.lit("ship_state").alias("field_name"), F.col("state_id").alias("entry_id"))),
        )
    )
    return rows.select("row_id", F.explode(cases).alias("_c")).select("row_id", "_c.*")


def p4_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every row with both entries and how each was found; exact values included."""
    return _mapped(spark, d, _places(spark, d)).select("row_id", "city_id", "city_how", "state_id", "state_how")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that fit no entry, with their number of rows."""
    rows = _mapped(spark, d, _places(spark, d).where(~(F.col("exact_ship_city") & F.col("exact_ship_state"))))
    left = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("city_how") == "none", F.struct(F.lit("ship_city").alias("field_name"), F.upper(trimmed("ship_city")).alias("value"))),
                F.when(F.col("state_how") == "none", F.struct(F.lit("ship_state").alias("field_name"), F.upper(trimmed("ship_state")).alias("value"))),
            )
        )
    )
    return rows.select(left.alias("_v")).select("_v.*").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


DIMENSIONS = ("order_day", "ship_state", "category")
IDENTIFIERS = ("sku", "style", "order_id")
COMBINATIONS = (("order_day",), ("ship_state",), ("category",), ("order_day", "ship_state"), ("order_day", "category"), ("ship_state", "category"), DIMENSIONS)


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "amazon_sales").select(
        "load_id", parse_date("order_date").alias("order_day"), upper_text("ship_state").alias("ship_state"), upper_text("category").alias("category"), *[text(c).alias(c) for c in IDENTIFIERS]
    )


def _sketched(spark: SparkSession, d: str, parts: list[str]) -> DataFrame:
    return distinct.partial_sketches(_identified(spark, d), parts, DIMENSIONS, {c: F.col(c) for c in IDENTIFIERS}, COMBINATIONS)


def p6_load_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Partial sketches per load, as they would be stored: those of any loads add up."""
    return _sketched(spark, d, ["load_id"])


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sku, style and order_id per order day, state, category and their combinations, from partial sketches of the table's partitions."""
    return distinct.counts(cut(_sketched(spark, d, [])), DIMENSIONS)


def p6_by_load(spark: SparkSession, d: str) -> DataFrame:
    """The same per load and identifier alone, all loads' sketches added up for the counts of the table (load_id null): additive load by load."""
    stored = cut(distinct.partial_sketches(_identified(spark, d), ["load_id"], [], {c: F.col(c) for c in IDENTIFIERS}, [()]))
    per, whole = distinct.counts(stored, ["load_id"]), distinct.counts(stored, [])
    return per.unionByName(whole.withColumn("load_id", F.lit(None).cast("bigint"))).drop("grouping")


def p6_held(spark: SparkSession, d: str) -> DataFrame:
    """Estimates against exact counts, per grouping and identifier: groups and their exact counts added up, whether every listed count is exact, and whether the
    bounds hold about as many as they claim (at least the confidence less three standard errors of that share, for groups of one identifier too)."""
    rows = _identified(spark, d)
    level = F.array(*[F.struct(F.lit(",".join(s)).alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in DIMENSIONS]) for s in COMBINATIONS])
    pair = F.array(*[F.struct(F.lit(c).alias("identifier"), F.col(c).alias("v")) for c in IDENTIFIERS])
    pairs = rows.select(*DIMENSIONS, F.explode(pair).alias("_v")).select(*DIMENSIONS, "_v.*").where("v IS NOT NULL").distinct()
    exact = pairs.select("identifier", "v", F.explode(level).alias("_g")).select("identifier", "v", "_g.*").distinct().groupBy("grouping", *DIMENSIONS, "identifier").agg(F.count(F.lit(1)).alias("n"))
    keys = ["grouping", *DIMENSIONS, "identifier"]
    both = p6_distinct(spark, d).withColumnsRenamed({k: f"_{k}" for k in keys}).join(exact, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys], "full_outer")
    held = F.avg(F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(False)).cast("double"))
    groups = F.count(F.lit(1))
    least = distinct.CONFIDENCE - 3 * F.sqrt(F.lit(distinct.CONFIDENCE * (1 - distinct.CONFIDENCE)) / groups)
    return both.groupBy("grouping", "identifier").agg(
        groups.alias("n_groups"), F.sum("n").alias("exact_total"), F.bool_and(F.col("listed_count").isNull() | (F.col("listed_count") == F.col("n"))).alias("listed_is_exact"), (held >= least).alias("bounds_hold")
    )


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the tokens of their whole text, counted once."""
    return cut(table(spark, d, "documents").select("doc_id", "source", tokens.token_counter()("text").alias("n_tokens")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container, for each capacity of pack_sizes."""
    kinds = [(r["pack_name"], r["capacity_tokens"]) for r in bounded_rows(table(spark, d, "pack_sizes").dropna(), 1000)]
    return packing.pack(_sized(spark, d), "doc_id", "n_tokens", kinds)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, unused share and the least possible number of containers of each kind."""
    return packing.fill(p8_containers(spark, d))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether every text is placed whole, containers hold no more than they may, and only texts beyond a capacity are split."""
    return packing.checked(p8_containers(spark, d), "doc_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of each mix and how often each is used."""
    return mixing.mix(_sized(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in each mix."""
    return mixing.shares(*mixing.mix(_sized(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_targets")))


def p9_shares_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached where each mix is to be as large as all documents together: sources whose records may not be repeated often enough fall short."""
    sized = _sized(spark, d)
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.shares(*mixing.mix(sized, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"), total=total))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Targets with whether the budget is reached as nearly as whole records allow, with less than its source's longest record missing and nothing too much,
    and no record is used more often than allowed."""
    sized = _sized(spark, d)
    s = mixing.shares(*mixing.mix(sized, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets")))
    longest = sized.groupBy(F.col("source").alias("_source")).agg(F.max("n_tokens").alias("_longest"))
    s = s.join(longest, F.col("source") == F.col("_source"), "left")
    missing = F.col("budget") - F.col("tokens")
    return s.select("mix_name", "source", "target_share", "max_repeats", ((missing >= 0) & (missing < F.coalesce("_longest", F.lit(1)))).alias("is_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, label, stretches): what each whole text is written in and the language its label names."""
    documents = table(spark, d, "documents")
    found = language.analyser(spark, language.fit(documents, "text", "lang"))
    return documents.select("doc_id", language.label_language(F.col("lang")).alias("label"), found("text").alias("stretches"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _stretches(spark, d).select("doc_id", "label", language.document_languages(F.col("stretches")).alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("label") != F.col("langs")[0])
    return docs.where((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of one language with its place in the text and confidence."""
    rows = _stretches(spark, d).select("doc_id", F.posexplode("stretches").alias("segment", "_s"))
    return rows.select("doc_id", "segment", "_s.lang", F.round("_s.confidence", 4).alias("confidence"), "_s.start", "_s.length", "_s.ambiguous", "_s.whole")


def _text(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '')"


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_bounded, p2_bounds_held, p4_found, p4_mapped, p4_unmatched, p6_distinct, p6_load_sketches, p6_by_load, p6_held, p8_containers, p8_fill, p8_checked, p9_mix, p9_shares, p9_shares_of_all, p9_checked, p10_found, p10_segments)}

_DIMENSIONS = {
    "order_day": f"CASE WHEN regexp_full_match({_text('order_date')}, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(try_strptime({_text('order_date')}, '%m-%d-%y') AS DATE) END",
    "ship_state": f"upper({_text('ship_state')})", "category": f"upper({_text('category')})",
}
_QUANTILES = ", ".join(f"quantile_disc(threshold, {p}) AS p{round(p * 100)}" for p in TARGETS)
SQL: dict[str, str] = {
    "p2_percentiles": f"""SELECT CASE WHEN GROUPING(month) = 1 THEN 'sku' WHEN GROUPING(sku) = 1 THEN 'month' ELSE 'sku,month' END AS grouping, sku, month, count(threshold) AS n_values,
      {_QUANTILES}, CAST(0.0 AS DOUBLE) AS error_bound FROM task_2_2 WHERE threshold IS NOT NULL GROUP BY GROUPING SETS ((sku, month), (month), (sku))""",
    "p2_bounds_held": " UNION ALL ".join(
        f"""SELECT CASE WHEN GROUPING(month) = 1 THEN 'sku' WHEN GROUPING(sku) = 1 THEN 'month' ELSE 'sku,month' END AS grouping, sku, month, CAST({p} AS DOUBLE) AS p, count(threshold) AS n_values,
      quantile_disc(threshold, {p}) AS value, true AS is_held, true AS is_narrow FROM task_2_2 WHERE threshold IS NOT NULL GROUP BY GROUPING SETS ((sku, month), (month), (sku))""" for p in TARGETS
    ),
    "p8_checked": """SELECT pack_name, CAST(capacity_tokens AS BIGINT) AS capacity, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS items, 0 AS overfull, 0 AS broken, 0 AS split_needlessly
      FROM pack_sizes WHERE pack_name IS NOT NULL AND capacity_tokens IS NOT NULL""",
    "p9_checked": """SELECT mix_name, source, target_share, CAST(max_repeats AS BIGINT) AS max_repeats, true AS is_reached, true AS repeats_kept FROM mix_targets""",
    "p6_held": " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS grouping, '{c}' AS identifier, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS exact_total, true AS listed_is_exact, true AS bounds_hold "
        f"FROM (SELECT count(DISTINCT {_text(c)}) AS n FROM amazon_sales WHERE {_text(c)} IS NOT NULL GROUP BY {', '.join(_DIMENSIONS[x] for x in s)})"
        for s in COMBINATIONS for c in IDENTIFIERS
    ),
}
