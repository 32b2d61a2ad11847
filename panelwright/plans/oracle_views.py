"""Intermediate SQL results used only on the SQL side (the Spark side derives its own)."""

ORACLE_VIEWS: dict[str, str] = {
    "wts": """
SELECT *, trade_usd / sum(trade_usd) OVER (PARTITION BY year, hs2, country_code) AS w
FROM flow_edges WHERE trade_usd > 0""",
    "hop2": """
SELECT a.year, a.hs2, a.country_code AS origin, a.partner_code AS via, b.partner_code AS endpoint,
       a.w AS w1, b.w AS w2, a.w * b.w AS coef, coalesce(s.shock_pct, 0) AS shock
FROM wts a JOIN wts b ON a.year = b.year AND a.hs2 = b.hs2 AND a.partner_code = b.country_code
LEFT JOIN shocks s ON b.partner_code = s.country_code""",
    "expo": """
SELECT d.year, d.hs2, d.origin, d.direct, coalesce(i.indirect, 0) AS indirect, coalesce(i.mass, 0) AS mass,
       coalesce(i.cyc, 0) AS cyc, d.dw, coalesce(i.iw, 0) AS iw
FROM (SELECT year, hs2, wts.country_code AS origin, sum(w * coalesce(shock_pct, 0)) AS direct,
             coalesce(sum(w) FILTER (WHERE shock_pct > 0), 0) AS dw
      FROM wts LEFT JOIN shocks ON partner_code = shocks.country_code GROUP BY year, hs2, wts.country_code) d
LEFT JOIN (SELECT year, hs2, origin, sum(coef * shock) AS indirect, sum(coef) AS mass,
                  coalesce(sum(coef) FILTER (WHERE endpoint = origin), 0) AS cyc,
                  coalesce(sum(coef) FILTER (WHERE shock > 0), 0) AS iw FROM hop2 GROUP BY ALL) i
USING (year, hs2, origin)""",
    "macro_wide": """
SELECT country_code, country_name, region, income_level, year,
       max(value) FILTER (WHERE indicator_code = 'SIZE') AS m_size,
       max(value) FILTER (WHERE indicator_code = 'GROWTH') AS growth,
       max(value) FILTER (WHERE indicator_code = 'PRICES') AS prices,
       max(value) FILTER (WHERE indicator_code = 'OPEN_SHARE') AS open_share,
       max(value) FILTER (WHERE indicator_code = 'URGENT_SHARE') AS urgent_share,
       max(value) FILTER (WHERE indicator_code = 'BALANCE') AS balance
FROM macro_long GROUP BY ALL""",
    "sector_base": """
SELECT wts.year, wts.country_code, hs2, sum(trade_usd) AS export_usd, sum(w * w) AS partner_hhi,
       list_sum(list_slice(list_reverse_sort(list(w)), 1, 5)) AS top5_share,
       coalesce(sum(w) FILTER (WHERE growth IS NOT NULL), 0) AS partner_gdp_coverage,
       sum(w * growth) / nullif(sum(w) FILTER (WHERE growth IS NOT NULL), 0) AS partner_gdp,
       count(*) AS partner_count
FROM wts LEFT JOIN macro_wide m ON partner_code = m.country_code AND wts.year = m.year
GROUP BY wts.year, wts.country_code, hs2""",
    "sector_candidates": """
SELECT b.year + 1 AS year, b.country_code, b.hs2, b.export_usd AS lag_export_usd, p.export_usd AS previous_export_usd,
       100 * (b.export_usd / nullif(p.export_usd, 0) - 1) AS previous_growth, b.partner_hhi, b.top5_share,
       b.partner_gdp_coverage, b.partner_gdp, m.growth AS own_gdp, m.prices AS own_inflation,
       m.urgent_share AS own_unemployment, m.open_share AS own_investment, m.balance AS own_current_account,
       r.country_code IS NOT NULL AS target_country_reported,
       r.country_code IS NOT NULL AND n.export_usd IS NULL AS target_sector_unreported,
       CASE WHEN r.country_code IS NOT NULL THEN coalesce(n.export_usd, 0) END AS export_usd,
       CASE WHEN r.country_code IS NOT NULL
            THEN CAST(coalesce(n.export_usd, 0) <= b.export_usd * 0.9 AS INT) END AS outcome,
       b.export_usd >= 2000 AND p.export_usd IS NOT NULL AND b.partner_gdp_coverage >= 0.8 AS eligible
FROM sector_base b LEFT JOIN sector_base p ON p.year = b.year - 1 AND p.country_code = b.country_code AND p.hs2 = b.hs2
LEFT JOIN sector_base n ON n.year = b.year + 1 AND n.country_code = b.country_code AND n.hs2 = b.hs2
LEFT JOIN macro_wide m ON m.country_code = b.country_code AND m.year = b.year
LEFT JOIN (SELECT DISTINCT year, country_code FROM sector_base) r
  ON r.year = b.year + 1 AND r.country_code = b.country_code""",
    "sector_rows": """
SELECT *, ln(1 + lag_export_usd) AS log_export,
       CAST((own_gdp IS NULL)::INT + (own_inflation IS NULL)::INT + (own_unemployment IS NULL)::INT
            + (own_investment IS NULL)::INT + (own_current_account IS NULL)::INT AS INT) AS missing_own_features
FROM sector_candidates WHERE eligible""",
}

ORACLE_VIEWS["catalog"] = """
SELECT DISTINCT key, 'Priority ' || substr(key, 2) AS name,
       CASE WHEN key IN ('p1', 'p2', 'p3') THEN 'monthly' WHEN key = 'p4' THEN 'year to date rate' ELSE 'year to date amount' END AS basis,
       CASE WHEN key IN ('p1', 'p2') THEN 'urgent' ELSE 'normal' END AS topic FROM monthly_obs"""
ORACLE_VIEWS["pub"] = """
SELECT *, CAST(make_date(CAST(floor((mid + 1) / 12) AS INT), CAST((mid + 1) % 12 + 1 AS INT), 1) + CAST(publication_lag_days AS INT) AS DATE) AS published
FROM monthly_obs"""
ORACLE_VIEWS["spine"] = """
SELECT key, CAST(unnest(generate_series(a, b)) AS INT) AS mid FROM (SELECT key, min(mid) AS a, max(mid) AS b FROM monthly_obs GROUP BY key)"""
ORACLE_VIEWS["exp_rates"] = """
SELECT y.year, y.hs2, (sum(k.outcome) + 1) / (count(k.outcome) + 2) AS global_rate, count(k.outcome) AS train_n,
       CASE WHEN count(k.outcome) FILTER (WHERE k.hs2 = y.hs2) > 0
            THEN (sum(k.outcome) FILTER (WHERE k.hs2 = y.hs2) + 2) / (count(k.outcome) FILTER (WHERE k.hs2 = y.hs2) + 4)
            ELSE (sum(k.outcome) + 1) / (count(k.outcome) + 2) END AS sector_rate
FROM (SELECT DISTINCT year, hs2 FROM sector_rows) y JOIN sector_rows k ON k.year < y.year GROUP BY y.year, y.hs2"""
ORACLE_VIEWS["sector_scored"] = """
SELECT s.*, r.global_rate, r.sector_rate, r.train_n FROM sector_rows s JOIN exp_rates r ON r.year = s.year AND r.hs2 = s.hs2"""
