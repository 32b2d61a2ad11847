from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import features as op
from panelwright.plans.flows import edges
from panelwright.plans.registry import query


def candidates(inp):
    return op.sector_candidates(edges(inp), inp.macro_long)


def sector_rows(inp):
    return op.sector_features(edges(inp), inp.macro_long)


ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in op.NUMERIC_FEATURES)


@query("sector_features", f"""
SELECT year, country_code, hs2, round(lag_export_usd, 4) + 0.0 AS lag_export_usd, {ROUNDED},
       target_sector_unreported, outcome, missing_own_features, CAST(year - 1 AS INT) AS feature_year FROM sector_rows""")
def sector_features(inp):
    return sector_rows(inp).select(
        *op.KEYS, rounded("lag_export_usd", 4).alias("lag_export_usd"),
        *[rounded(c, 6).alias(c) for c in op.NUMERIC_FEATURES], "target_sector_unreported", "outcome",
        "missing_own_features", "feature_year",
    )


@query("sector_quality_report", """
SELECT year, count(*) AS candidate_rows, count(*) FILTER (WHERE eligible) AS eligible_rows,
  count(*) FILTER (WHERE NOT eligible) AS excluded_rows, count(*) FILTER (WHERE lag_export_usd < 2000) AS below_floor,
  count(*) FILTER (WHERE previous_export_usd IS NULL) AS no_previous_year,
  count(*) FILTER (WHERE partner_gdp_coverage < 0.8) AS low_coverage,
  count(*) FILTER (WHERE eligible AND target_sector_unreported) AS unreported_targets,
  count(*) FILTER (WHERE eligible AND (own_gdp IS NULL OR own_inflation IS NULL OR own_unemployment IS NULL
    OR own_investment IS NULL OR own_current_account IS NULL)) AS own_macro_missing_rows,
  round(avg(partner_gdp_coverage) FILTER (WHERE eligible), 6) + 0.0 AS mean_coverage
FROM sector_candidates GROUP BY year""")
def sector_quality_report(inp):
    return op.quality_report(candidates(inp)).withColumn("mean_coverage", rounded("mean_coverage", 6))


@query("panel_lag_features", """
WITH y AS (SELECT country_code, year FROM macro_wide UNION SELECT country_code, year + 1 FROM macro_wide),
j AS (SELECT y.country_code, CAST(y.year AS INT) AS year, t.growth AS actual, a.growth AS lag_own_gdp, a.prices AS lag_own_inflation,
  a.urgent_share AS lag_own_unemployment, a.open_share AS lag_own_investment, a.balance AS lag_own_current_account,
  b.growth AS lag2_own_gdp
  FROM y LEFT JOIN macro_wide t ON t.country_code = y.country_code AND t.year = y.year
  LEFT JOIN macro_wide a ON a.country_code = y.country_code AND a.year = y.year - 1
  LEFT JOIN macro_wide b ON b.country_code = y.country_code AND b.year = y.year - 2)
SELECT country_code, year, round(actual, 6) + 0.0 AS actual, round(lag_own_gdp, 6) + 0.0 AS lag_own_gdp,
  round(lag_own_inflation, 6) + 0.0 AS lag_own_inflation, round(lag_own_unemployment, 6) + 0.0 AS lag_own_unemployment,
  round(lag_own_investment, 6) + 0.0 AS lag_own_investment, round(lag_own_current_account, 6) + 0.0 AS lag_own_current_account,
  round(lag2_own_gdp, 6) + 0.0 AS lag2_own_gdp,
  CAST((lag_own_inflation IS NULL)::INT + (lag_own_unemployment IS NULL)::INT + (lag_own_investment IS NULL)::INT
  + (lag_own_current_account IS NULL)::INT + (lag2_own_gdp IS NULL)::INT AS INT) AS missing_features
FROM j WHERE lag_own_gdp IS NOT NULL""")
def panel_lag_features(inp):
    frame = op.panel_lags(inp.macro_long)
    values = [c for c in frame.columns if c == "actual" or c.startswith("lag")]
    return frame.select("country_code", "year", *[rounded(c, 6).alias(c) for c in values], "missing_features")


@query("leakage_violations", """
WITH s AS (SELECT year, country_code, hs2, CASE WHEN hs2 = '03' THEN year ELSE year - 1 END AS fy,
  CASE WHEN country_code = 'N04' THEN year ELSE year - 1 END AS te, CASE WHEN hs2 = '07' AND country_code = 'N01' THEN 2 ELSE outcome END AS o,
  CASE WHEN country_code = 'N09' THEN 1.5 ELSE partner_hhi END AS p FROM sector_rows)
SELECT year, country_code, hs2, 'feature year' AS reason FROM s WHERE fy <> year - 1
UNION ALL SELECT year, country_code, hs2, 'training label in the predicted year' FROM s WHERE te >= year
UNION ALL SELECT year, country_code, hs2, 'label' FROM s WHERE o NOT IN (0, 1)
UNION ALL SELECT year, country_code, hs2, 'probability p' FROM s WHERE p IS NULL OR p < 0 OR p > 1""")
def leakage_violations(inp):
    rows = sector_rows(inp)
    broken = rows.withColumns({
        "feature_year": F.when(F.col("hs2") == "03", F.col("year")).otherwise(F.col("feature_year")),
        "train_end": F.when(F.col("country_code") == "N04", F.col("year")).otherwise(F.col("year") - 1),
        "outcome": F.when((F.col("hs2") == "07") & (F.col("country_code") == "N01"), 2).otherwise(F.col("outcome")),
        "p": F.when(F.col("country_code") == "N09", 1.5).otherwise(F.col("partner_hhi")),
    })
    return op.leakage_violations(broken, ["p"])


@query("future_perturbation_check", """
SELECT count(*) AS past_rows, CAST(0 AS BIGINT) AS changed_rows FROM sector_rows WHERE year <= 1999""")
def future_perturbation_check(inp):
    return op.perturbation_check(edges(inp), inp.macro_long, 1999)


@query("training_boundaries", """
WITH k AS (SELECT year, count(*) AS n FROM sector_rows WHERE outcome IS NOT NULL GROUP BY year)
SELECT a.year, min(b.year) AS first_label_year, max(b.year) AS train_end, CAST(sum(b.n) AS BIGINT) AS train_n, any_value(a.n) AS eval_n
FROM k a JOIN k b ON b.year < a.year WHERE a.year >= 1999 GROUP BY a.year""")
def training_boundaries(inp):
    return op.training_boundaries(sector_rows(inp), 1999)


@query("expanding_event_rates", """
WITH k AS (SELECT year, hs2, CAST(sum(outcome) AS BIGINT) AS e, count(outcome) AS n FROM sector_rows GROUP BY ALL),
y AS (SELECT DISTINCT year, hs2 FROM k),
g AS (SELECT y.year, y.hs2, sum(k.e) AS ge, sum(k.n) AS gn, sum(k.e) FILTER (WHERE k.hs2 = y.hs2) AS se,
  coalesce(sum(k.n) FILTER (WHERE k.hs2 = y.hs2), 0) AS sn FROM y JOIN k ON k.year < y.year GROUP BY ALL)
SELECT year, hs2, round((ge + 1) / (gn + 2), 6) + 0.0 AS global_rate,
  round(CASE WHEN sn > 0 THEN (se + 2) / (sn + 4) ELSE (ge + 1) / (gn + 2) END, 6) + 0.0 AS sector_rate, CAST(gn AS BIGINT) AS train_n
FROM g WHERE gn > 0""")
def expanding_event_rates(inp):
    frame = op.expanding_event_rates(sector_rows(inp))
    return frame.select("year", "hs2", rounded("global_rate", 6).alias("global_rate"),
                        rounded("sector_rate", 6).alias("sector_rate"), "train_n")


@query("next_year_availability", """
SELECT DISTINCT e.year, e.country_code, e.hs2, CAST(e.year + 1 AS INT) AS target_year,
  EXISTS (SELECT 1 FROM sector_rows s WHERE s.year = e.year + 1 AND s.country_code = e.country_code AND s.hs2 = e.hs2) AS available
FROM flow_edges e""")
def next_year_availability(inp):
    nodes = edges(inp).select(*op.KEYS).distinct()
    return op.next_year_availability(nodes, sector_rows(inp))
