"""Country panel comparisons.

The panel is long (country, year, indicator, value). Everything matches exact calendar years; a missing
endpoint gives NULL, and the denominators are returned with every rank. A window or grouping by indicator and
year never exceeds the number of economies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["year", "indicator_code"]


def indicator_series(macro: DataFrame, countries: list[str], indicator: str) -> DataFrame:
    return macro.filter(
        F.col("country_code").isin(countries) & (F.col("indicator_code") == indicator) & F.col("value").isNotNull()
    ).select("country_code", "country_name", "year", "value")


def midrank(value: str, keys: list[str]) -> Column:
    """100 * (below + equal / 2) / observed, NULL for missing values.

    ``rank`` counts the lower ones, the tie count comes from a window over the same rows.
    """
    group = Window.partitionBy(*keys)
    observed = F.count(value).over(group)
    below = F.rank().over(group.orderBy(F.col(value).asc_nulls_last())) - 1
    equal = F.count(value).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), 100.0 * (below + 0.5 * equal) / observed)


def rank_desc(value: str, keys: list[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(window))


def with_positions(macro: DataFrame) -> DataFrame:
    return macro.withColumns({
        "percentile": midrank("value", CELL), "rank_desc": rank_desc("value", CELL),
        "observed": F.count("value").over(Window.partitionBy(*CELL)),
    })


def peer_summary(macro: DataFrame) -> DataFrame:
    """Position of every economy within all economies, its region and its income group."""
    cohorts = F.array(
        F.struct(F.lit("all").alias("cohort"), F.lit("all economies").alias("group_value")),
        F.struct(F.lit("region").alias("cohort"), F.col("region").alias("group_value")),
        F.struct(F.lit("income").alias("cohort"), F.col("income_level").alias("group_value")),
    )
    rows = macro.select("country_code", *CELL, "value", F.explode(cohorts).alias("c")).select(
        "country_code", *CELL, "value", "c.cohort", "c.group_value"
    )
    keys = [*CELL, "cohort", "group_value"]
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("total_economies"), F.count("value").alias("observed_economies"),
        F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.25).alias("q1"),
        F.percentile("value", 0.75).alias("q3"),
    )
    placed = rows.withColumns({"percentile": midrank("value", keys), "rank_desc": rank_desc("value", keys)})
    return placed.join(stats, keys)


def indicator_coverage(macro: DataFrame) -> DataFrame:
    totals = macro.groupBy("year").agg(F.countDistinct("country_code").alias("economies"))
    cells = macro.groupBy(*CELL).agg(F.count("value").alias("observed"), F.percentile("value", 0.5).alias("median"))
    return cells.join(totals, "year").withColumn("coverage_pct", 100 * F.col("observed") / F.col("economies"))


def observation_status(macro: DataFrame, indicators: list[str]) -> DataFrame:
    """Every economy, year and catalogued indicator: has it a value, when was the last one, how stale is it."""
    spine = economy_years(macro).withColumn("indicator_code", F.explode(F.array(*[F.lit(i) for i in indicators])))
    joined = spine.join(macro.select("country_code", *CELL, "value"), ["country_code", *CELL], "left")
    past = Window.partitionBy("country_code", "indicator_code").orderBy("year").rangeBetween(
        Window.unboundedPreceding, 0
    )
    latest = F.max(F.when(F.col("value").isNotNull(), F.col("year"))).over(past)
    return joined.select(
        "country_code", *CELL, F.col("value").isNotNull().alias("has_observation"),
        latest.alias("latest_observed_year"), (F.col("year") - latest).alias("years_since"),
    )


def economy_years(macro: DataFrame) -> DataFrame:
    return macro.select("country_code", "year").distinct()


def grid(keys: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Attach a fixed list of members to every key row (a bounded explode, no cross join)."""
    return keys.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def selection_grid(macro: DataFrame, indicators: list[str]) -> DataFrame:
    """Countries x indicators of every year; absent cells appear as NULL."""
    return grid(economy_years(macro), "indicator_code", indicators).join(
        macro.select("country_code", *CELL, "value"), ["country_code", *CELL], "left"
    )


def shifted(macro: DataFrame, years: int, name: str) -> DataFrame:
    """Values keyed by the year they are compared with."""
    return macro.select(
        "country_code", "indicator_code", (F.col("year") + years).alias("year"), F.col("value").alias(name)
    )


def prior_years(macro: DataFrame) -> DataFrame:
    """First lag by outer join (the next year appears even without data), second lag by left join."""
    keys = ["country_code", *CELL]
    return (
        macro.select(*keys, "value").join(shifted(macro, 1, "lag1"), keys, "full").join(
            shifted(macro, 2, "lag2"), keys, "left")
    )


def endpoint_change(macro: DataFrame, years: int) -> DataFrame:
    keys = ["country_code", *CELL]
    return macro.select(*keys, "value").join(shifted(macro, years, "past_value"), keys, "left").withColumn(
        "delta", F.col("value") - F.col("past_value")
    )


def panel_pivot(macro: DataFrame, indicators: list[str]) -> DataFrame:
    return macro.groupBy("country_code", "country_name", "region", "income_level", "year").pivot(
        "indicator_code", indicators).agg(F.first("value"))


def regimes(macro: DataFrame, growth: str, prices: str, lookback: int, minimum: int) -> DataFrame:
    """Current value against the median of the preceding years, four labels, only with enough history."""
    series = Window.partitionBy("country_code", "indicator_code").orderBy("year").rangeBetween(-lookback, -1)
    rated = macro.filter(F.col("indicator_code").isin(growth, prices)).withColumns({
        "reference": F.percentile("value", 0.5).over(series), "n": F.count("value").over(series),
    })

    def of(code: str, name: str) -> Column:
        return F.max(F.when(F.col("indicator_code") == code, F.col(name)))

    wide = rated.groupBy("country_code", "year").agg(
        of(growth, "value").alias("growth"), of(growth, "reference").alias("growth_reference"),
        of(growth, "n").alias("growth_n"), of(prices, "value").alias("prices"),
        of(prices, "reference").alias("prices_reference"), of(prices, "n").alias("prices_n"),
    ).filter(
        F.col("growth").isNotNull() & F.col("prices").isNotNull()
        & (F.col("growth_n") >= minimum) & (F.col("prices_n") >= minimum)
    )

    def side(name: str) -> Column:
        return F.when(F.col(name) >= F.col(f"{name}_reference"), "above").otherwise("below")

    return wide.withColumns({
        "label": F.concat(F.lit("growth "), side("growth"), F.lit(", prices "), side("prices")),
        "reference_start": F.col("year") - lookback, "reference_end": F.col("year") - 1,
    })


def trailing_median(macro: DataFrame, indicator: str, years: int = 5, minimum: int = 3) -> DataFrame:
    """Median of the preceding calendar years when enough are observed, else the previous year's value."""
    own = macro.filter(F.col("indicator_code") == indicator)
    window = Window.partitionBy("country_code").orderBy("year")
    frame = window.rangeBetween(-years, -1)
    rated = own.select(
        "country_code", "year", "value",
        F.percentile("value", 0.5).over(frame).alias("m"), F.count("value").over(frame).alias("n"),
        F.max("value").over(window.rangeBetween(-1, -1)).alias("previous"),
    )
    return rated.select(
        "country_code", "year", "value", "n",
        F.when(F.col("n") >= minimum, F.col("m")).otherwise(F.col("previous")).alias("center"),
    )


def triplet(macro: DataFrame, x: str, y: str, size: str) -> DataFrame:
    wide = macro.groupBy("country_code", "country_name", "year").pivot("indicator_code", [x, y, size]).agg(F.max("value"))
    return wide.select("country_code", "country_name", "year", F.col(x).alias("x"), F.col(y).alias("y"),
                       F.col(size).alias("size"))


def top_and_named(frame: DataFrame, limit: int, named: str) -> DataFrame:
    """Largest complete members of each year plus one named member wherever it stands."""
    complete = frame.filter("x IS NOT NULL AND y IS NOT NULL AND size IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("size"), "country_code"))
    return complete.withColumn("place", place).filter(
        (F.col("place") <= limit) | (F.col("country_code") == named)
    )


def fixed_bins(column: Column, edges: list[float]) -> Column:
    """Class number with open ends: 0 below the first edge, ``len(edges)`` from the last edge on."""
    out = F.lit(0)
    for edge in edges:
        out = out + (column >= edge).cast("int")
    return out.cast("int")


def magnitude(value: Column, kind: Column) -> Column:
    """Scaled label: 1e12 / 1e8 tiers for money, 1e8 / 1e4 tiers for counts, one decimal for percent."""
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value), "no data")
        .when(kind == "percent", F.concat(F.format_number(value, 1), F.lit("%")))
        .when((kind == "usd") & (size >= 1e12), F.concat(F.format_number(value / 1e12, 1), F.lit(" tn")))
        .when((kind == "usd") & (size >= 1e8), F.concat(F.format_number(value / 1e8, 1), F.lit(" hm")))
        .when(kind == "usd", F.concat(F.format_number(value, 0), F.lit(" USD")))
        .when((kind == "count") & (size >= 1e8), F.concat(F.format_number(value / 1e8, 2), F.lit(" hm people")))
        .when((kind == "count") & (size >= 1e4), F.concat(F.format_number(value / 1e4, 1), F.lit(" x10k people")))
        .otherwise(F.format_number(value, 2))
    )


def hash_holdout(code: Column) -> Column:
    """sha256(code) mod 5 = 0. Since 16 = 1 (mod 5) the digest is congruent to the sum of its hex digits."""
    digits = F.transform(F.split(F.sha2(code, 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    total = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)
    return (total % 5) == 0


def label_lookup(codes: DataFrame, names: DataFrame) -> DataFrame:
    """Preferred name, else the fallback name, else the code itself."""
    return codes.join(names, "country_code", "left").withColumn(
        "label", F.coalesce("preferred_name", "country_name", "country_code")
    )


def macro_profile(macro: DataFrame, years: int) -> DataFrame:
    """Value, global mid-rank and exact-endpoint change of every country and indicator, in every year."""
    indicators = sorted(r[0] for r in macro.select("indicator_code").filter("indicator_code IS NOT NULL").distinct().collect())
    cells = selection_grid(macro, indicators).filter(F.col("country_code").isNotNull())
    placed = cells.withColumns({
        "global_percentile": midrank("value", CELL), "global_observed": F.count("value").over(Window.partitionBy(*CELL)),
        "global_total": F.count("*").over(Window.partitionBy(*CELL)),
    })
    past = shifted(macro, years, "past_value")
    return placed.join(
        past, ["country_code", *CELL], "left"
    ).withColumns({"past_year": F.col("year") - years, "delta_pp": F.col("value") - F.col("past_value")})
