"""Leakage-checked panel features, labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import ratio
from panelwright.operators.graph import weights

# Indicator codes of the test panel and the feature each one feeds.
OWN_FEATURES = {
    "GROWTH": "own_gdp", "PRICES": "own_inflation", "URGENT_SHARE": "own_unemployment",
    "OPEN_SHARE": "own_investment", "BALANCE": "own_current_account",
}
KEYS = ["year", "country_code", "hs2"]
TRADE_FEATURES = ["log_export", "previous_growth", "partner_hhi", "top5_share", "partner_gdp_coverage"]
MACRO_FEATURES = ["partner_gdp", *OWN_FEATURES.values()]
NUMERIC_FEATURES = TRADE_FEATURES + MACRO_FEATURES


def own_macro(macro: DataFrame) -> DataFrame:
    """Wide own-country indicators; one row per country and year."""
    wide = macro.groupBy("country_code", "year").pivot("indicator_code", list(OWN_FEATURES)).agg(F.max("value"))
    return wide.withColumnsRenamed(OWN_FEATURES)


def weighted_partner_macro(weighted: DataFrame, macro: DataFrame, indicator: str = "GROWTH") -> DataFrame:
    """Share of partners with a known value and their mean normalised by that coverage; NULL when it is zero."""
    values = macro.filter(F.col("indicator_code") == indicator).select(
        F.col("country_code").alias("partner_code"), "year", F.col("value").alias("_m")
    )
    known = F.when(F.col("_m").isNotNull(), F.col("weight"))
    return (
        weighted.join(values, ["partner_code", "year"], "left")
        .groupBy(*KEYS)
        .agg(F.coalesce(F.sum(known), F.lit(0.0)).alias("partner_gdp_coverage"),
             F.sum(F.col("weight") * F.col("_m")).alias("_s"))
        .withColumn("partner_gdp", ratio(F.col("_s"), F.col("partner_gdp_coverage")))
        .drop("_s")
    )


def sector_base(edges: DataFrame, macro: DataFrame) -> DataFrame:
    """Size, concentration and partner conditions of every exporter and chapter in one aggregation."""
    values = macro.filter("indicator_code = 'GROWTH'").select(
        F.col("country_code").alias("partner_code"), "year", F.col("value").alias("_m")
    )
    joined = weights(edges).join(values, ["partner_code", "year"], "left")
    ranked = joined.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("weight"), "partner_code"))
    )
    return (
        ranked.groupBy(*KEYS)
        .agg(
            F.sum("trade_usd").alias("export_usd"),
            F.sum(F.col("weight") * F.col("weight")).alias("partner_hhi"),
            F.sum(F.when(F.col("_n") <= 5, F.col("weight")).otherwise(0.0)).alias("top5_share"),
            F.coalesce(F.sum(F.when(F.col("_m").isNotNull(), F.col("weight"))), F.lit(0.0)).alias(
                "partner_gdp_coverage"),
            F.sum(F.col("weight") * F.col("_m")).alias("_s"),
            F.count("*").alias("partner_count"),
        )
        .withColumn("partner_gdp", ratio(F.col("_s"), F.col("partner_gdp_coverage")))
        .drop("_s")
    )


def sector_candidates(edges: DataFrame, macro: DataFrame, floor: float = 2000.0, coverage: float = 0.8) -> DataFrame:
    """Feature year y-1, target year y; neighbours are matched by exact year through shifted keys.

    Exact-year neighbours come from one window per country and chapter over a handful of years: the shifted
    amount is taken only if the adjacent row really is the adjacent year.
    """
    base = sector_base(edges, macro)
    series = Window.partitionBy("country_code", "hs2").orderBy("year")

    def exact(offset: int):
        other = F.lag("year", offset).over(series) if offset > 0 else F.lead("year", -offset).over(series)
        amount = F.lag("export_usd", offset).over(series) if offset > 0 else F.lead("export_usd", -offset).over(series)
        return F.when(other == F.col("year") - offset, amount)

    linked = base.withColumns({"previous_export_usd": exact(1), "_next": exact(-1)})
    reporters = base.select((F.col("year") - 1).alias("year"), "country_code").distinct().withColumn("_r", F.lit(True))
    joined = linked.join(own_macro(macro), ["country_code", "year"], "left").join(
        reporters, ["year", "country_code"], "left"
    )
    there = F.col("_r").isNotNull()
    amount = F.coalesce("_next", F.lit(0.0))
    return joined.select(
        (F.col("year") + 1).alias("year"), "country_code", "hs2",
        F.col("export_usd").alias("lag_export_usd"), "previous_export_usd",
        (100 * (ratio(F.col("export_usd"), F.col("previous_export_usd")) - 1)).alias("previous_growth"),
        "partner_hhi", "top5_share", "partner_gdp_coverage", "partner_gdp", *OWN_FEATURES.values(),
        there.alias("target_country_reported"), (there & F.col("_next").isNull()).alias("target_sector_unreported"),
        F.when(there, amount).alias("export_usd"),
        F.when(there, (amount <= F.col("export_usd") * 0.9).cast("int")).alias("outcome"),
        ((F.col("export_usd") >= floor) & F.col("previous_export_usd").isNotNull()
         & (F.col("partner_gdp_coverage") >= coverage)).alias("eligible"),
        F.col("year").alias("feature_year"), F.col("year").alias("weight_year"), F.col("year").alias("macro_year"),
    )


def sector_features(edges: DataFrame, macro: DataFrame, **rules) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in OWN_FEATURES.values()), F.lit(0))
    return sector_candidates(edges, macro, **rules).filter("eligible").withColumns(
        {"log_export": F.log1p("lag_export_usd"), "missing_own_features": missing}
    )


def quality_report(candidates: DataFrame) -> DataFrame:
    missing = F.greatest(*[F.col(c).isNull() for c in OWN_FEATURES.values()])
    eligible = F.col("eligible")
    return candidates.groupBy("year").agg(
        F.count("*").alias("candidate_rows"), F.count_if(eligible).alias("eligible_rows"),
        F.count_if(~eligible).alias("excluded_rows"),
        F.count_if(F.col("lag_export_usd") < 2000).alias("below_floor"),
        F.count_if(F.col("previous_export_usd").isNull()).alias("no_previous_year"),
        F.count_if(F.col("partner_gdp_coverage") < 0.8).alias("low_coverage"),
        F.count_if(eligible & F.col("target_sector_unreported")).alias("unreported_targets"),
        F.count_if(eligible & missing).alias("own_macro_missing_rows"),
        F.avg(F.when(eligible, F.col("partner_gdp_coverage"))).alias("mean_coverage"),
    )


def panel_lags(macro: DataFrame) -> DataFrame:
    """Target growth with five first lags and a second growth lag; the first growth lag is required."""
    wide = own_macro(macro)
    names = list(OWN_FEATURES.values())
    lag1 = wide.select("country_code", (F.col("year") + 1).alias("year"), *[F.col(c).alias(f"lag_{c}") for c in names])
    lag2 = wide.select("country_code", (F.col("year") + 2).alias("year"), F.col("own_gdp").alias("lag2_own_gdp"))
    target = wide.select("country_code", "year", F.col("own_gdp").alias("actual"))
    data = target.join(lag1, ["country_code", "year"], "full").join(lag2, ["country_code", "year"], "left")
    features = [f"lag_{c}" for c in names] + ["lag2_own_gdp"]
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return data.filter(F.col("lag_own_gdp").isNotNull()).withColumn("missing_features", missing)


def leakage_violations(scored: DataFrame, probabilities: list[str]) -> DataFrame:
    """Rows breaking the time boundary, class, label or probability rules, one row per reason."""
    bad = [
        F.when(F.col("feature_year") != F.col("year") - 1, "feature year"),
        F.when(F.col("weight_year") != F.col("year") - 1, "weight year"),
        F.when(F.col("macro_year") != F.col("year") - 1, "macro year"),
        F.when(F.col("train_end") >= F.col("year"), "training label in the predicted year"),
        F.when(~F.coalesce(F.col("hs2").try_cast("int").between(1, 97), F.lit(False)), "chapter"),
        F.when(F.col("outcome").isNotNull() & ~F.col("outcome").isin(0, 1), "label"),
        *[F.when(F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1), f"probability {p}") for p in probabilities],
    ]
    return scored.select(*KEYS, F.explode(F.array_compact(F.array(*bad))).alias("reason"))


def perturbation_check(edges: DataFrame, macro: DataFrame, cutoff: int) -> DataFrame:
    """Rows up to ``cutoff`` that change when every macro value from ``cutoff`` on is replaced: must be none."""
    poisoned = macro.withColumn("value", F.when(F.col("year") >= cutoff, F.lit(99999.0)).otherwise(F.col("value")))
    columns = [*KEYS, *NUMERIC_FEATURES, "outcome"]

    def past(panel: DataFrame) -> DataFrame:
        # floats are compared after rounding because the two plans may add in a different order
        return sector_features(edges, panel).filter(F.col("year") <= cutoff).select(
            *KEYS, *[F.round(c, 6).alias(c) for c in NUMERIC_FEATURES], "outcome"
        ).select(*columns)

    before, after = past(macro), past(poisoned)
    one, none = F.lit(1), F.lit(0)
    return (
        before.select(one.alias("past"), none.alias("changed"))
        .unionByName(before.exceptAll(after).select(none.alias("past"), one.alias("changed")))
        .agg(F.sum("past").alias("past_rows"), F.sum("changed").alias("changed_rows"))
    )


def training_boundaries(features: DataFrame, first_target: int) -> DataFrame:
    """Per target year the span and size of the training labels (strictly earlier years)."""
    by_year = features.filter(F.col("outcome").isNotNull()).groupBy("year").agg(F.count("*").alias("eval_n"))
    # one row per year from here on
    earlier = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return by_year.select(
        "year", F.min("year").over(earlier).alias("first_label_year"), F.max("year").over(earlier).alias("train_end"),
        F.sum("eval_n").over(earlier).alias("train_n"), "eval_n",
    ).filter(F.col("year") >= first_target)


def expanding_event_rates(features: DataFrame) -> DataFrame:
    """Smoothed event rates from strictly earlier years: Beta(1,1) overall, Beta(2,2) per chapter."""
    cells = features.groupBy("year", "hs2").agg(
        F.sum("outcome").alias("e"), F.count("outcome").alias("n")
    )
    before = Window.partitionBy("hs2").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    sector = cells.withColumns({"se": F.sum("e").over(before), "sn": F.sum("n").over(before)})
    years = cells.groupBy("year").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))  # one row per year
    past = Window.orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    overall = years.select("year", F.sum("e").over(past).alias("ge"), F.sum("n").over(past).alias("gn"))
    global_rate = (F.col("ge") + 1) / (F.col("gn") + 2)
    sector_rate = F.when(F.coalesce("sn", F.lit(0)) > 0, (F.col("se") + 2) / (F.col("sn") + 4)).otherwise(global_rate)
    return sector.join(overall, "year").filter(F.col("gn") > 0).select(
        "year", "hs2", global_rate.alias("global_rate"), sector_rate.alias("sector_rate"),
        F.col("gn").alias("train_n"),
    )


def next_year_availability(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """Is there a scored record of the following year for each graph node."""
    have = scored.select((F.col("year") - 1).alias("year"), "country_code", "hs2").distinct().withColumn(
        "_s", F.lit(True)
    )
    return nodes.join(have, KEYS, "left").select(
        *KEYS, (F.col("year") + 1).alias("target_year"), F.col("_s").isNotNull().alias("available")
    )
