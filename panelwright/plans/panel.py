from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import flows as flow_op
from panelwright.operators import panel as op
from panelwright.plans.registry import query

INDICATORS = ["SIZE", "GROWTH", "PRICES", "OPEN_SHARE", "URGENT_SHARE", "BALANCE"]
LISTED = "(SELECT unnest(['SIZE', 'GROWTH', 'PRICES', 'OPEN_SHARE', 'URGENT_SHARE', 'BALANCE', 'UNUSED']) AS indicator_code)"
V = "round(value, 6) + 0.0 AS value"


@query("indicator_series", f"""
SELECT country_code, country_name, year, {V} FROM macro_long
WHERE indicator_code = 'GROWTH' AND country_code IN ('N00', 'N01', 'N02', 'N13') AND value IS NOT NULL""")
def indicator_series(inp):
    return op.indicator_series(inp.macro_long, ["N00", "N01", "N02", "N13"], "GROWTH").withColumn(
        "value", rounded("value", 6))


@query("fixed_bins", """
SELECT country_code, year, indicator_code, CAST((value >= -10)::INT + (value >= -2)::INT + (value >= 0)::INT + (value >= 2)::INT
  + (value >= 5)::INT + (value >= 10)::INT AS INT) AS bin FROM macro_long WHERE indicator_code IN ('GROWTH', 'PRICES') AND value IS NOT NULL""")
def fixed_bins(inp):
    rows = inp.macro_long.filter("indicator_code IN ('GROWTH', 'PRICES') AND value IS NOT NULL")
    return rows.select("country_code", "year", "indicator_code",
                       op.fixed_bins(F.col("value"), [-10, -2, 0, 2, 5, 10]).alias("bin"))


@query("magnitude_format", """
WITH r AS (SELECT country_code, year, indicator_code, CASE indicator_code WHEN 'SIZE' THEN 'usd' WHEN 'GROWTH' THEN 'percent'
  WHEN 'OPEN_SHARE' THEN 'count' ELSE 'plain' END AS kind,
  CASE indicator_code WHEN 'OPEN_SHARE' THEN value * 1e5 WHEN 'SIZE' THEN value * 100 ELSE value END AS v FROM macro_long)
SELECT country_code, year, indicator_code, CASE WHEN v IS NULL THEN 'no data'
  WHEN kind = 'percent' THEN format('{:,.1f}', v) || '%'
  WHEN kind = 'usd' AND abs(v) >= 1e12 THEN format('{:,.1f}', v / 1e12) || ' tn'
  WHEN kind = 'usd' AND abs(v) >= 1e8 THEN format('{:,.1f}', v / 1e8) || ' hm'
  WHEN kind = 'usd' THEN format('{:,.0f}', v) || ' USD'
  WHEN kind = 'count' AND abs(v) >= 1e8 THEN format('{:,.2f}', v / 1e8) || ' hm people'
  WHEN kind = 'count' AND abs(v) >= 1e4 THEN format('{:,.1f}', v / 1e4) || ' x10k people'
  ELSE format('{:,.2f}', v) END AS label FROM r""")
def magnitude_format(inp):
    code, value = F.col("indicator_code"), F.col("value")
    kind = F.when(code == "SIZE", "usd").when(code == "GROWTH", "percent").when(code == "OPEN_SHARE", "count").otherwise("plain")
    scaled = F.when(code == "OPEN_SHARE", value * 1e5).when(code == "SIZE", value * 100).otherwise(value)
    return inp.macro_long.select("country_code", "year", "indicator_code", op.magnitude(scaled, kind).alias("label"))


@query("label_lookup", """
WITH n AS (SELECT iso3, name, CASE WHEN numeric_code % 3 = 0 THEN 'Pref ' || name END AS p FROM country_dim WHERE numeric_code % 5 <> 1)
SELECT DISTINCT year, country_code, coalesce(p, name, country_code) AS label FROM macro_long LEFT JOIN n ON country_code = iso3""")
def label_lookup(inp):
    names = inp.country_dim.filter("numeric_code % 5 <> 1").select(
        F.col("iso3").alias("country_code"), F.col("name").alias("country_name"),
        F.when(F.col("numeric_code") % 3 == 0, F.concat(F.lit("Pref "), "name")).alias("preferred_name"))
    return op.label_lookup(op.economy_years(inp.macro_long), names).select("year", "country_code", "label")


@query("hash_holdout", """
SELECT DISTINCT country_code, list_sum([CAST(('0x' || d) AS INT) for d in string_split(sha256(country_code), '') if d <> '']) % 5 = 0 AS held
FROM macro_long""")
def hash_holdout(inp):
    return inp.macro_long.select("country_code").distinct().withColumn("held", op.hash_holdout(F.col("country_code")))


@query("selection_grid", f"""
SELECT k.country_code, k.year, i.indicator_code, {V} FROM (SELECT DISTINCT country_code, year FROM macro_long) k CROSS JOIN {LISTED} i
LEFT JOIN macro_long m ON m.country_code = k.country_code AND m.year = k.year AND m.indicator_code = i.indicator_code""")
def selection_grid(inp):
    return op.selection_grid(inp.macro_long, [*INDICATORS, "UNUSED"]).withColumn("value", rounded("value", 6))


@query("prior_year_join", """
WITH y AS (SELECT country_code, indicator_code, year FROM macro_long UNION SELECT country_code, indicator_code, year + 1 FROM macro_long)
SELECT y.country_code, y.indicator_code, CAST(y.year AS INT) AS year, round(a.value, 6) + 0.0 AS value, round(b.value, 6) + 0.0 AS lag1,
  round(c.value, 6) + 0.0 AS lag2 FROM y
LEFT JOIN macro_long a ON (a.country_code, a.indicator_code, a.year) = (y.country_code, y.indicator_code, y.year)
LEFT JOIN macro_long b ON (b.country_code, b.indicator_code, b.year + 1) = (y.country_code, y.indicator_code, y.year)
LEFT JOIN macro_long c ON (c.country_code, c.indicator_code, c.year + 2) = (y.country_code, y.indicator_code, y.year)""")
def prior_year_join(inp):
    frame = op.prior_years(inp.macro_long)
    return frame.withColumns({c: rounded(c, 6) for c in ("value", "lag1", "lag2")})


@query("endpoint_change", """
SELECT a.country_code, a.indicator_code, a.year, round(a.value, 6) + 0.0 AS value, round(b.value, 6) + 0.0 AS past_value,
  round(a.value - b.value, 6) + 0.0 AS delta FROM macro_long a LEFT JOIN macro_long b
ON b.country_code = a.country_code AND b.indicator_code = a.indicator_code AND b.year = a.year - 3""")
def endpoint_change(inp):
    return op.endpoint_change(inp.macro_long, 3).withColumns(
        {c: rounded(c, 6) for c in ("value", "past_value", "delta")})


@query("indicator_coverage", """
SELECT m.year, indicator_code, count(value) AS observed, round(median(value), 6) + 0.0 AS median, any_value(n) AS economies,
  round(100.0 * count(value) / any_value(n), 6) + 0.0 AS coverage_pct
FROM macro_long m JOIN (SELECT year, count(DISTINCT country_code) AS n FROM macro_long GROUP BY year) t USING (year)
GROUP BY m.year, indicator_code""")
def indicator_coverage(inp):
    return op.indicator_coverage(inp.macro_long).withColumns({c: rounded(c, 6) for c in ("median", "coverage_pct")})


@query("observation_status", f"""
WITH g AS (SELECT * FROM (SELECT DISTINCT country_code, year FROM macro_long) CROSS JOIN {LISTED})
SELECT g.country_code, g.year, g.indicator_code, coalesce(bool_or(m.year = g.year), false) AS has_observation,
  CAST(max(m.year) AS INT) AS latest_observed_year, CAST(g.year - max(m.year) AS INT) AS years_since
FROM g LEFT JOIN macro_long m ON m.country_code = g.country_code AND m.indicator_code = g.indicator_code AND m.year <= g.year
  AND m.value IS NOT NULL GROUP BY g.country_code, g.year, g.indicator_code""")
def observation_status(inp):
    return op.observation_status(inp.macro_long, [*INDICATORS, "UNUSED"])


PEERS = """peer AS (SELECT country_code, year, indicator_code, value, 'all' AS cohort, 'all economies' AS group_value FROM macro_long
  UNION ALL SELECT country_code, year, indicator_code, value, 'region', region FROM macro_long
  UNION ALL SELECT country_code, year, indicator_code, value, 'income', income_level FROM macro_long)"""


@query("peer_summary", f"""
WITH {PEERS},
s AS (SELECT year, indicator_code, cohort, group_value, count(*) AS total_economies, count(value) AS observed_economies, median(value) AS median,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM peer GROUP BY ALL)
SELECT p.country_code, p.year, p.indicator_code, p.cohort, p.group_value, round(p.value, 6) + 0.0 AS value, total_economies, observed_economies,
  round(median, 6) + 0.0 AS median, round(q1, 6) + 0.0 AS q1, round(q3, 6) + 0.0 AS q3,
  CASE WHEN p.value IS NOT NULL THEN CAST((SELECT count(*) + 1 FROM peer x WHERE x.year = p.year AND x.indicator_code = p.indicator_code AND x.cohort = p.cohort
    AND x.group_value = p.group_value AND x.value > p.value) AS INT) END AS rank_desc,
  CASE WHEN p.value IS NOT NULL THEN round(100.0 * (SELECT count(*) FILTER (WHERE x.value < p.value) + 0.5 * count(*) FILTER (WHERE x.value = p.value)
    FROM peer x WHERE x.year = p.year AND x.indicator_code = p.indicator_code AND x.cohort = p.cohort AND x.group_value = p.group_value)
    / observed_economies, 6) + 0.0 END AS percentile
FROM peer p JOIN s USING (year, indicator_code, cohort, group_value)""")
def peer_summary(inp):
    return op.peer_summary(inp.macro_long).withColumns(
        {c: rounded(c, 6) for c in ("value", "median", "q1", "q3", "percentile")})


@query("panel_pivot", """
SELECT country_code, country_name, region, income_level, year, round(m_size, 4) + 0.0 AS SIZE, round(growth, 6) + 0.0 AS GROWTH,
  round(prices, 6) + 0.0 AS PRICES, round(open_share, 6) + 0.0 AS OPEN_SHARE, round(urgent_share, 6) + 0.0 AS URGENT_SHARE,
  round(balance, 6) + 0.0 AS BALANCE FROM macro_wide""")
def panel_pivot(inp):
    return op.panel_pivot(inp.macro_long, INDICATORS).withColumns(
        {c: rounded(c, 4 if c == "SIZE" else 6) for c in INDICATORS})


@query("midrank_percentile", """
SELECT a.country_code, a.year, a.indicator_code, round(100.0 * (count(*) FILTER (WHERE b.value < a.value) + 0.5 * count(*) FILTER (WHERE b.value = a.value))
  / count(*), 6) + 0.0 AS percentile, count(*) AS observed
FROM macro_long a JOIN macro_long b ON a.year = b.year AND a.indicator_code = b.indicator_code
WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""")
def midrank_percentile(inp):
    return op.with_positions(inp.macro_long).filter("value IS NOT NULL").select(
        "country_code", "year", "indicator_code", rounded("percentile", 6).alias("percentile"), "observed")


@query("rank_desc_ties", """
SELECT a.country_code, a.year, a.indicator_code, CAST(1 + count(*) FILTER (WHERE round(b.value) > round(a.value)) AS INT) AS rank_desc
FROM macro_long a JOIN macro_long b ON a.year = b.year AND a.indicator_code = b.indicator_code
WHERE a.value IS NOT NULL GROUP BY ALL""")
def rank_desc_ties(inp):
    coarse = inp.macro_long.withColumn("value", F.round("value", 0))
    return op.with_positions(coarse).filter("value IS NOT NULL").select(
        "country_code", "year", "indicator_code", "rank_desc")


REGIME = """regime AS (
SELECT country_code, year, max(value) FILTER (WHERE indicator_code = 'GROWTH') AS growth, max(r) FILTER (WHERE indicator_code = 'GROWTH') AS gr,
  max(n) FILTER (WHERE indicator_code = 'GROWTH') AS gn, max(value) FILTER (WHERE indicator_code = 'PRICES') AS prices,
  max(r) FILTER (WHERE indicator_code = 'PRICES') AS pr, max(n) FILTER (WHERE indicator_code = 'PRICES') AS pn
FROM (SELECT a.country_code, a.year, a.indicator_code, any_value(a.value) AS value, median(b.value) AS r, count(b.value) AS n
  FROM macro_long a LEFT JOIN macro_long b ON b.country_code = a.country_code AND b.indicator_code = a.indicator_code
    AND b.year BETWEEN a.year - 5 AND a.year - 1 WHERE a.indicator_code IN ('GROWTH', 'PRICES') GROUP BY a.country_code, a.year, a.indicator_code)
GROUP BY ALL)"""


@query("regime_classification", f"""
WITH {REGIME}
SELECT country_code, year, round(growth, 6) + 0.0 AS growth, round(gr, 6) + 0.0 AS growth_reference, gn AS growth_n,
  round(prices, 6) + 0.0 AS prices, round(pr, 6) + 0.0 AS prices_reference, pn AS prices_n,
  'growth ' || CASE WHEN growth >= gr THEN 'above' ELSE 'below' END || ', prices ' || CASE WHEN prices >= pr THEN 'above' ELSE 'below' END AS label,
  CAST(year - 5 AS INT) AS reference_start, CAST(year - 1 AS INT) AS reference_end
FROM regime WHERE growth IS NOT NULL AND prices IS NOT NULL AND gn >= 3 AND pn >= 3""")
def regime_classification(inp):
    frame = op.regimes(inp.macro_long, "GROWTH", "PRICES", 5, 3)
    return frame.withColumns({c: rounded(c, 6) for c in ("growth", "growth_reference", "prices", "prices_reference")})


@query("trailing_median5", """
SELECT a.country_code, a.year, round(any_value(a.value), 6) + 0.0 AS value, count(b.value) AS n,
  round(CASE WHEN count(b.value) >= 3 THEN median(b.value) ELSE max(b.value) FILTER (WHERE b.year = a.year - 1) END, 6) + 0.0 AS center
FROM macro_long a LEFT JOIN macro_long b ON b.country_code = a.country_code AND b.indicator_code = 'GROWTH' AND b.year BETWEEN a.year - 5 AND a.year - 1
WHERE a.indicator_code = 'GROWTH' GROUP BY a.country_code, a.year""")
def trailing_median5(inp):
    return op.trailing_median(inp.macro_long, "GROWTH").withColumns({c: rounded(c, 6) for c in ("value", "center")})


@query("forecast_cross_section", """
SELECT year, country_code, round(value, 6) + 0.0 AS value, CAST(row_number() OVER (PARTITION BY year ORDER BY value DESC, country_code) AS INT) AS place
FROM macro_long WHERE indicator_code = 'BALANCE' AND value IS NOT NULL""")
def forecast_cross_section(inp):
    rows = inp.macro_long.filter("indicator_code = 'BALANCE' AND value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("value"), "country_code"))
    return rows.select("year", "country_code", rounded("value", 6).alias("value"), place.alias("place"))


@query("topn_plus_highlight", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY m_size DESC, country_code) AS n FROM macro_wide
  WHERE growth IS NOT NULL AND prices IS NOT NULL AND m_size IS NOT NULL)
SELECT country_code, country_name, year, round(growth, 6) + 0.0 AS x, round(prices, 6) + 0.0 AS y, round(m_size, 4) + 0.0 AS size, CAST(n AS INT) AS place
FROM p WHERE n <= 8 OR country_code = 'N17'""")
def topn_plus_highlight(inp):
    frame = op.top_and_named(op.triplet(inp.macro_long, "GROWTH", "PRICES", "SIZE"), 8, "N17")
    return frame.withColumns({"x": rounded("x", 6), "y": rounded("y", 6), "size": rounded("size", 4)})


@query("population_distinct", """
SELECT year, count(DISTINCT country_code) AS economies, count(DISTINCT country_code) FILTER (WHERE value IS NOT NULL AND indicator_code = 'GROWTH') AS with_growth
FROM macro_long GROUP BY year""")
def population_distinct(inp):
    rows = inp.macro_long.groupBy("year", "country_code").agg(
        F.max(F.when(F.col("indicator_code") == "GROWTH", F.col("value"))).alias("g"))
    return rows.groupBy("year").agg(F.count("*").alias("economies"), F.count("g").alias("with_growth"))


@query("annual_indicator_sheet", f"""
SELECT k.country_code, k.year, i.indicator_code, {V}, CASE WHEN m.value IS NULL THEN 'not observed' ELSE 'observed' END AS status
FROM (SELECT DISTINCT country_code, year FROM macro_long) k CROSS JOIN {LISTED} i
LEFT JOIN macro_long m ON m.country_code = k.country_code AND m.year = k.year AND m.indicator_code = i.indicator_code""")
def annual_indicator_sheet(inp):
    frame = op.selection_grid(inp.macro_long, [*INDICATORS, "UNUSED"])
    status = F.when(F.col("value").isNull(), "not observed").otherwise("observed")
    return frame.withColumns({"status": status, "value": rounded("value", 6)})


@query("growth_inflation_history", f"""
SELECT s.country_code, s.year AS selected_year, m.year, m.indicator_code, {V}
FROM (SELECT DISTINCT country_code, year FROM macro_long) s JOIN macro_long m ON m.country_code = s.country_code
  AND m.year BETWEEN s.year - 14 AND s.year AND m.indicator_code IN ('GROWTH', 'PRICES')""")
def growth_inflation_history(inp):
    rows = inp.macro_long.filter("indicator_code IN ('GROWTH', 'PRICES')")
    # every observation belongs to the histories that end in the 15 years from its own year on
    ends = rows.withColumn("selected_year", F.explode(F.sequence(F.col("year"), F.col("year") + 14)))
    selected = op.economy_years(inp.macro_long).withColumnRenamed("year", "selected_year")
    return ends.join(selected, ["country_code", "selected_year"], "left_semi").select(
        "country_code", "selected_year", "year", "indicator_code", rounded("value", 6).alias("value"))


@query("forecast_extract", f"""
SELECT country_code, indicator_code, year, {V}, '2001-04' AS vintage, 'projection' AS status FROM macro_long
WHERE indicator_code IN ('GROWTH', 'PRICES', 'BALANCE') AND year IN (1999, 2000, 2001) AND value IS NOT NULL""")
def forecast_extract(inp):
    rows = inp.macro_long.filter(
        F.col("indicator_code").isin("GROWTH", "PRICES", "BALANCE") & F.col("year").isin(1999, 2000, 2001)
        & F.col("value").isNotNull())
    return rows.select("country_code", "indicator_code", "year", rounded("value", 6).alias("value"),
                       F.lit("2001-04").alias("vintage"), F.lit("projection").alias("status"))


@query("macro_profile", """
WITH o AS (SELECT a.country_code, a.year, a.indicator_code, a.value, count(b.value) AS global_observed,
  100.0 * (count(*) FILTER (WHERE b.value < a.value) + 0.5 * count(*) FILTER (WHERE b.value = a.value)) / nullif(count(b.value), 0) AS p,
  count(*) AS global_total FROM macro_long a JOIN macro_long b ON a.year = b.year AND a.indicator_code = b.indicator_code GROUP BY ALL)
SELECT o.country_code, o.year, o.indicator_code, round(o.value, 6) + 0.0 AS value,
  CASE WHEN o.value IS NOT NULL THEN round(p, 6) + 0.0 END AS global_percentile, global_observed, global_total,
  CAST(o.year - 5 AS INT) AS past_year, round(q.value, 6) + 0.0 AS past_value, round(o.value - q.value, 6) + 0.0 AS delta_pp
FROM o LEFT JOIN macro_long q ON q.country_code = o.country_code AND q.indicator_code = o.indicator_code AND q.year = o.year - 5""")
def macro_profile(inp):
    frame = op.macro_profile(inp.macro_long, 5)
    return frame.withColumns({c: rounded(c, 6) for c in ("value", "global_percentile", "past_value", "delta_pp")})


@query("research_facts", f"""
WITH {REGIME},
c AS (SELECT year, country_code, sum(s * s) AS hhi, count(*) AS n FROM (SELECT t AS year, e.iso3 AS country_code,
  sum(v) / sum(sum(v)) OVER (PARTITION BY t, e.iso3) AS s FROM flows_raw JOIN country_dim e ON i = e.numeric_code GROUP BY t, e.iso3, j) GROUP BY ALL),
m AS (SELECT country_code, year, string_agg(indicator_code || '=' || CAST(CAST(round(value, 3) AS DECIMAL(18, 3)) AS VARCHAR), ';' ORDER BY indicator_code) AS indicators
  FROM macro_long WHERE value IS NOT NULL GROUP BY ALL),
o AS (SELECT country_code, year - 1 AS year, max(value) AS outlook FROM macro_long WHERE indicator_code = 'BALANCE' GROUP BY ALL)
SELECT k.country_code, k.year, indicators, CASE WHEN growth IS NOT NULL AND prices IS NOT NULL AND gn >= 3 AND pn >= 3 THEN
  'growth ' || CASE WHEN growth >= gr THEN 'above' ELSE 'below' END || ', prices ' || CASE WHEN prices >= pr THEN 'above' ELSE 'below' END END AS regime,
  round(hhi, 6) + 0.0 AS hhi, n AS partner_count, round(outlook, 6) + 0.0 AS outlook_balance
FROM (SELECT DISTINCT country_code, year FROM macro_long) k LEFT JOIN m USING (country_code, year) LEFT JOIN regime USING (country_code, year)
LEFT JOIN c USING (country_code, year) LEFT JOIN o USING (country_code, year)""")
def research_facts(inp):
    macro = inp.macro_long
    observed = macro.filter("value IS NOT NULL").groupBy("country_code", "year").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "indicator_code", F.round("value", 3).cast("decimal(18,3)")))).alias("m"))
    # the map has one entry per catalogued indicator
    text = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(
        k, F.lit("="), F.col("m")[k].cast("string"))), ";")
    pairs = flow_op.bilateral_totals(inp.flows_raw, inp.country_dim).select(
        "year", F.col("exporter_code").alias("country_code"), F.col("importer_code").alias("partner_code"), "trade_usd")
    concentration = flow_op.concentration(pairs, ["year", "country_code"]).select(
        "year", "country_code", rounded("hhi", 6).alias("hhi"), "partner_count")
    regime = op.regimes(macro, "GROWTH", "PRICES", 5, 3).select("country_code", "year", F.col("label").alias("regime"))
    outlook = macro.filter("indicator_code = 'BALANCE'").select(
        "country_code", (F.col("year") - 1).alias("year"), rounded("value", 6).alias("outlook_balance"))
    keys = ["country_code", "year"]
    return op.economy_years(macro).join(observed.select(*keys, text.alias("indicators")), keys, "left").join(
        regime, keys, "left").join(concentration, keys, "left").join(outlook, keys, "left")
