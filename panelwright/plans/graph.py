from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import features as feat
from panelwright.operators import graph as op
from panelwright.plans.flows import edges
from panelwright.plans.registry import query


def weighted(inp):
    return op.weights(edges(inp))


def exposed(inp):
    return op.exposures(weighted(inp), inp.shocks).withColumnRenamed("country_code", "origin")


NODE = ["year", "hs2", "origin"]


@query("edge_violations", """
WITH e AS (SELECT year, hs2, country_code, CASE WHEN hs2 = '03' AND country_code = 'N05' THEN 'N05' ELSE partner_code END AS partner_code,
  CASE WHEN hs2 = '04' AND country_code = 'N01' THEN 0 WHEN hs2 = '04' AND country_code = 'N02' THEN -trade_usd
       WHEN hs2 = '04' AND country_code = 'N03' THEN NULL ELSE trade_usd END AS trade_usd FROM flow_edges
  UNION ALL SELECT year, hs2, country_code, 'x9', trade_usd FROM flow_edges WHERE hs2 = '05' AND country_code = 'N07'),
c AS (SELECT *, count(*) OVER (PARTITION BY year, hs2, country_code, partner_code) AS n FROM e)
SELECT reason, count(*) AS rows FROM (
  SELECT 'missing or mixed key' AS reason FROM c WHERE trade_usd IS NULL
  UNION ALL SELECT 'bad code' FROM c WHERE NOT regexp_full_match(partner_code, '[A-Z]{3}|[A-Z][0-9]{2}')
  UNION ALL SELECT 'duplicate' FROM c WHERE n > 1
  UNION ALL SELECT 'self loop' FROM c WHERE country_code = partner_code
  UNION ALL SELECT 'negative or non-finite' FROM c WHERE trade_usd < 0
  UNION ALL SELECT 'zero' FROM c WHERE trade_usd = 0) GROUP BY reason""")
def edge_violations(inp):
    e = edges(inp)
    extra = e.filter("hs2 = '05' AND country_code = 'N07'").withColumn("partner_code", F.lit("x9"))
    here = (F.col("hs2") == "04")
    broken = e.withColumns({
        "partner_code": F.when((F.col("hs2") == "03") & (F.col("country_code") == "N05"), "N05").otherwise(
            F.col("partner_code")),
        "trade_usd": F.when(here & (F.col("country_code") == "N01"), 0.0)
        .when(here & (F.col("country_code") == "N02"), -F.col("trade_usd"))
        .when(here & (F.col("country_code") == "N03"), None).otherwise(F.col("trade_usd")),
    }).unionByName(extra)
    return op.edge_violations(broken)


@query("edge_weights", """
SELECT year, hs2, country_code, partner_code, round(trade_usd, 4) + 0.0 AS trade_usd, round(w, 8) + 0.0 AS weight FROM wts""")
def edge_weights(inp):
    return weighted(inp).select("year", "hs2", "country_code", "partner_code",
                                rounded("trade_usd", 4).alias("trade_usd"), rounded("weight", 8).alias("weight"))


@query("direct_exposure", "SELECT year, hs2, origin, round(direct, 6) + 0.0 AS direct FROM expo")
def direct_exposure(inp):
    return op.node_vectors(weighted(inp), inp.shocks).select(
        "year", "hs2", F.col("country_code").alias("origin"), rounded("direct", 6).alias("direct")
    )


@query("two_hop_exposure", "SELECT year, hs2, origin, round(indirect, 6) + 0.0 AS indirect FROM expo")
def two_hop_exposure(inp):
    return exposed(inp).select(*NODE, rounded("indirect", 6).alias("indirect"))


@query("blended_exposure", """
SELECT year, hs2, origin, round(direct, 6) + 0.0 AS direct, round(indirect, 6) + 0.0 AS indirect,
       round((direct + 0.5 * indirect) / 1.5, 6) + 0.0 AS blended FROM expo""")
def blended_exposure(inp):
    return exposed(inp).withColumn("blended", op.blended(0.5)).select(
        *NODE, *[rounded(c, 6).alias(c) for c in ("direct", "indirect", "blended")]
    )


@query("two_hop_join", """
SELECT year, hs2, origin, via, endpoint, round(w1, 8) + 0.0 AS first_share, round(w2, 8) + 0.0 AS second_share,
       round(coef, 8) + 0.0 AS coefficient FROM hop2""")
def two_hop_join(inp):
    return op.two_hop_paths(weighted(inp)).select(
        *NODE, "via", "endpoint", *[rounded(c, 8).alias(c) for c in ("first_share", "second_share", "coefficient")]
    )


@query("path_contributions", """
SELECT year, hs2, origin, via, endpoint, round(w1, 8) + 0.0 AS first_share, round(w2, 8) + 0.0 AS second_share,
       round(coef, 8) + 0.0 AS coefficient, shock AS shock_pct, round(coef * shock, 8) + 0.0 AS contribution,
       round(0.5 * (coef * shock) / 1.5, 8) + 0.0 AS blended_contribution,
       'flow:' || year || ':' || hs2 || ':' || origin || ':' || via || ',' ||
       'flow:' || year || ':' || hs2 || ':' || via || ':' || endpoint AS edge_ids
FROM hop2""")
def path_contributions(inp):
    paths = op.two_hop_paths(weighted(inp), inp.shocks)
    return paths.select(
        *NODE, "via", "endpoint", rounded("first_share", 8).alias("first_share"),
        rounded("second_share", 8).alias("second_share"), rounded("coefficient", 8).alias("coefficient"), "shock_pct",
        rounded("contribution", 8).alias("contribution"),
        rounded("blended_contribution", 8).alias("blended_contribution"),
        F.array_join("edge_ids", ",").alias("edge_ids"),
    )


@query("retained_mass", """
SELECT e.year, e.hs2, e.origin, round(mass, 8) + 0.0 AS retained_mass, round(greatest(0, 1 - mass), 8) + 0.0 AS unreported_onward_mass,
       d.n AS dead_end_partners
FROM expo e JOIN (SELECT year, hs2, country_code, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM flow_edges f WHERE f.year = a.year
  AND f.hs2 = a.hs2 AND f.country_code = a.partner_code)) AS n FROM flow_edges a GROUP BY ALL) d
ON d.year = e.year AND d.hs2 = e.hs2 AND d.country_code = e.origin""")
def retained_mass(inp):
    return exposed(inp).select(*NODE, rounded("retained_mass", 8).alias("retained_mass"),
                               rounded("unreported_onward_mass", 8).alias("unreported_onward_mass"),
                               "dead_end_partners")


@query("cycle_return", "SELECT year, hs2, origin, round(cyc, 8) + 0.0 AS cycle_return FROM expo")
def cycle_return(inp):
    return op.cycle_return(weighted(inp)).select("year", "hs2", F.col("country_code").alias("origin"), rounded("cycle_return", 8).alias("cycle_return"))


@query("alpha_sensitivity", """
SELECT year, hs2, origin, CAST(a AS DOUBLE) AS alpha, round((direct + a * indirect) / (1 + a), 6) + 0.0 AS blended
FROM expo, (SELECT unnest([0.0, 0.25, 0.4, 0.5, 0.75, 1.0]::DOUBLE[]) AS a)""")
def alpha_sensitivity(inp):
    frame = op.alpha_sensitivity(exposed(inp), (0, 0.25, 0.5, 0.75, 1, 0.4))
    return frame.select(*NODE, "alpha", rounded("blended", 6).alias("blended"))


@query("scenario_decomposition", """
WITH d AS (SELECT year, hs2, wts.country_code AS origin, partner_code AS market, w * shock_pct AS d FROM wts
           JOIN shocks ON partner_code = shocks.country_code WHERE shock_pct > 0),
i AS (SELECT year, hs2, origin, endpoint AS market, sum(coef * shock) AS i FROM hop2 WHERE shock > 0 GROUP BY ALL),
m AS (SELECT year, hs2, origin, market, coalesce(d, 0) AS d, coalesce(i, 0) AS i FROM d FULL JOIN i USING (year, hs2, origin, market)),
a AS (SELECT year, hs2, origin, market AS scenario, d, i FROM m
  UNION ALL SELECT year, hs2, origin, 'combined', sum(d), sum(i) FROM m GROUP BY ALL
  UNION ALL SELECT year, hs2, origin, 'zero', 0, 0 FROM expo)
SELECT year, hs2, origin, scenario, round(d, 6) + 0.0 AS direct, round(i, 6) + 0.0 AS indirect,
       round((d + 0.5 * i) / 1.5, 6) + 0.0 AS blended FROM a""")
def scenario_decomposition(inp):
    frame = op.scenario_decomposition(weighted(inp), inp.shocks).withColumnRenamed("country_code", "origin")
    return frame.select(*NODE, "scenario", *[rounded(c, 6).alias(c) for c in ("direct", "indirect", "blended")])


@query("graph_quality", """
WITH n AS (SELECT year, hs2, country_code AS node FROM wts UNION SELECT year, hs2, partner_code FROM wts)
SELECT year, hs2, count(*) AS nodes, (SELECT count(*) FROM wts w WHERE w.year = n.year AND w.hs2 = n.hs2) AS edges,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM wts w WHERE w.year = n.year AND w.hs2 = n.hs2 AND w.country_code = node)) AS dead_ends
FROM n GROUP BY year, hs2""")
def graph_quality(inp):
    return op.graph_quality(weighted(inp))


@query("gdp_shock_exposure", """
WITH t AS (SELECT year, hs2, wts.country_code AS origin, partner_code, w, -0.6 * coalesce(shock_pct, 0) AS s FROM wts
  LEFT JOIN shocks ON partner_code = shocks.country_code), m AS (SELECT *, CASE WHEN abs(s) <= 10 THEN w * s END AS e, CASE WHEN abs(s) <= 10 THEN 0 ELSE 1 END AS bad FROM t)
SELECT year, hs2, origin, partner_code, round(w, 8) + 0.0 AS weight, round(e, 8) + 0.0 AS exposure_pp, CAST(bad AS BIGINT) AS refused FROM m
UNION ALL SELECT year, hs2, origin, 'TOTAL', round(sum(w), 8) + 0.0, CASE WHEN sum(bad) = 0 THEN round(sum(e), 8) + 0.0 END, CAST(sum(bad) AS BIGINT) FROM m GROUP BY ALL""")
def gdp_shock_exposure(inp):
    # the largest of these shocks is 12 points and must be refused
    shocks = inp.shocks.select("country_code", (-0.6 * F.col("shock_pct")).alias("shock_pp"))
    frame = op.gdp_shock_exposure(edges(inp), shocks).withColumnRenamed("country_code", "origin")
    return frame.select(*NODE, "partner_code", rounded("weight", 8).alias("weight"),
                        rounded("exposure_pp", 8).alias("exposure_pp"), "refused")


@query("shocked_weight", """
SELECT year, hs2, origin, round(dw, 8) + 0.0 AS direct_shocked_weight, round(iw, 8) + 0.0 AS two_hop_shocked_weight FROM expo""")
def shocked_weight(inp):
    return exposed(inp).select(*NODE, *[rounded(c, 8).alias(c)
                                        for c in ("direct_shocked_weight", "two_hop_shocked_weight")])


@query("ranked_paths", """
WITH r AS (SELECT *, coef * shock AS c, row_number() OVER (PARTITION BY year, hs2, origin
  ORDER BY coef * shock DESC, coef DESC, via, endpoint) AS n FROM hop2)
SELECT year, hs2, origin, CAST(least(n, 31) AS INT) AS place, CASE WHEN n <= 30 THEN via ELSE 'OTHER' END AS via,
  CASE WHEN n <= 30 THEN endpoint ELSE 'OTHER' END AS endpoint, round(sum(c), 8) + 0.0 AS contribution, count(*) AS paths
FROM r GROUP BY ALL""")
def ranked_paths(inp):
    frame = op.ranked_paths(op.two_hop_paths(weighted(inp), inp.shocks), 30)
    return frame.withColumn("contribution", rounded("contribution", 8))


@query("sankey_links", """
WITH r AS (SELECT *, coef * shock AS c, row_number() OVER (PARTITION BY year, hs2, origin
  ORDER BY coef * shock DESC, coef DESC, via, endpoint) AS n FROM hop2 WHERE coef * shock > 0),
l AS (SELECT year, hs2, origin, 1 AS level, origin AS source, via AS target, c FROM r WHERE n <= 20
  UNION ALL SELECT year, hs2, origin, 2, via, endpoint, c FROM r WHERE n <= 20)
SELECT year, hs2, origin, CAST(level AS INT) AS level, source, target, round(sum(c), 8) + 0.0 AS value FROM l GROUP BY ALL""")
def sankey_links(inp):
    frame = op.flow_links(op.two_hop_paths(weighted(inp), inp.shocks))
    return frame.withColumn("value", rounded("value", 8))


@query("weighted_partner_macro", """
SELECT year, country_code, hs2, round(partner_gdp_coverage, 6) + 0.0 AS partner_gdp_coverage,
       round(partner_gdp, 6) + 0.0 AS partner_gdp FROM sector_base""")
def weighted_partner_macro(inp):
    frame = feat.weighted_partner_macro(weighted(inp), inp.macro_long)
    return frame.select(*feat.KEYS, rounded("partner_gdp_coverage", 6).alias("partner_gdp_coverage"),
                        rounded("partner_gdp", 6).alias("partner_gdp"))
