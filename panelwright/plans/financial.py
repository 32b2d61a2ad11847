from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, rounded
from panelwright.operators import financial as op
from panelwright.plans.registry import query

V = "round(value, 10) + 0.0 AS value"
LONG = """ix AS (SELECT country_code, mid, 'nominal' AS measure, nominal AS value FROM index_series
  UNION ALL SELECT country_code, mid, 'real_value', real_value FROM index_series),
ch AS (SELECT a.*, b.value AS value_12m_ago, 100 * (a.value / nullif(b.value, 0) - 1) AS change_12m_pct FROM ix a
  LEFT JOIN ix b ON a.country_code = b.country_code AND a.measure = b.measure AND a.mid = b.mid + 12)"""


def index(inp):
    return op.index_long(inp.index_series)


@query("exact_12m_change", f"""
WITH {LONG} SELECT country_code, mid, measure, {V}, round(value_12m_ago, 10) + 0.0 AS value_12m_ago,
  round(change_12m_pct, 6) + 0.0 AS change_12m_pct FROM ch""")
def exact_12m_change(inp):
    return op.change_12m(index(inp)).withColumns(
        {c: rounded(c, 6 if c == "change_12m_pct" else 10) for c in ("value", "value_12m_ago", "change_12m_pct")})


CUTOFFS = [y * 12 + 11 for y in range(1995, 2001)] + [1998 * 12 + 4]


@query("asof_latest_value", f"""
WITH k AS (SELECT DISTINCT country_code FROM policy_series), c AS (SELECT CAST(unnest({CUTOFFS}) AS INT) AS cutoff)
SELECT k.country_code, cutoff, max(value) FILTER (WHERE mid = cutoff) AS common_value, coalesce(max(obs_status) FILTER (WHERE mid = cutoff), '') AS common_status,
  max(mid) FILTER (WHERE value IS NOT NULL) AS latest_mid, arg_max(value, mid) FILTER (WHERE value IS NOT NULL) AS latest_value, max(mid) AS last_record_mid
FROM k CROSS JOIN c LEFT JOIN policy_series p ON p.country_code = k.country_code AND p.mid <= cutoff GROUP BY k.country_code, cutoff""")
def asof_latest_value(inp):
    return op.asof_values(inp.policy_series, CUTOFFS)


@query("series_extent", """
WITH e AS (SELECT country_code, count(*) AS rows, count(value) AS observed, min(mid) AS a, max(mid) AS b FROM policy_series GROUP BY 1)
SELECT country_code, rows, observed, a AS first_mid, b AS last_mid, coalesce((SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FROM
  (SELECT unnest(generate_series(e.a, e.b)) AS m) s WHERE NOT EXISTS (SELECT 1 FROM policy_series p WHERE p.country_code = e.country_code AND p.mid = m)), '') AS missing
FROM e""")
def series_extent(inp):
    return op.series_extent(inp.policy_series, ["country_code"]).withColumn(
        "missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("latest_in_year", """
SELECT country_code, CAST(floor(mid / 12) AS INT) AS year, max(mid) AS mid, arg_max(obs_status, mid) AS obs_status,
  (SELECT value FROM policy_series q WHERE q.country_code = p.country_code AND q.mid = max(p.mid)) AS value
FROM policy_series p GROUP BY country_code, CAST(floor(mid / 12) AS INT)""")
def latest_in_year(inp):
    return op.latest_in_year(inp.policy_series, ["country_code"]).select(
        "country_code", "year", "mid", "obs_status", "value")


@query("latest_quarter_triplet", """
WITH l AS (SELECT nk, CAST(floor(qid / 4) AS INT) AS year, max(qid) AS qid FROM credit_series GROUP BY ALL)
SELECT l.nk, l.year, l.qid, round(max(value) FILTER (WHERE measure = 'ratio'), 6) + 0.0 AS ratio,
  round(max(value) FILTER (WHERE measure = 'trend'), 6) + 0.0 AS trend, round(max(value) FILTER (WHERE measure = 'gap'), 6) + 0.0 AS gap
FROM l JOIN credit_series c ON c.nk = l.nk AND c.qid = l.qid GROUP BY ALL""")
def latest_quarter_triplet(inp):
    return op.latest_quarter(inp.credit_series).withColumns({c: rounded(c, 6) for c in ("ratio", "trend", "gap")})


@query("latest_index_change", f"""
WITH {LONG}, l AS (SELECT country_code, measure, CAST(floor(mid / 12) AS INT) AS year, max(mid) AS mid FROM ch GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT country_code FROM ch) CROSS JOIN (SELECT DISTINCT year FROM l) CROSS JOIN (SELECT unnest(['nominal', 'real_value']) AS measure))
SELECT g.country_code, g.measure, g.year, l.mid, round(ch.value, 10) + 0.0 AS value, round(change_12m_pct, 6) + 0.0 AS change_12m_pct
FROM g LEFT JOIN l USING (country_code, measure, year) LEFT JOIN ch ON ch.country_code = l.country_code AND ch.measure = l.measure AND ch.mid = l.mid""")
def latest_index_change(inp):
    changed = op.latest_in_year(op.change_12m(index(inp)), ["country_code", "measure"])
    span = changed.agg(F.sequence(F.min("year"), F.max("year"))).scalar()
    grid = changed.select("country_code").distinct().withColumn("year", F.explode(span)).withColumn(
        "measure", F.explode(F.array(F.lit("nominal"), F.lit("real_value"))))
    return grid.join(changed, ["country_code", "measure", "year"], "left").select(
        "country_code", "measure", "year", "mid", rounded("value", 10).alias("value"),
        rounded("change_12m_pct", 6).alias("change_12m_pct"))


@query("history_window", """
WITH ix AS (SELECT country_code AS c, mid, 'nominal' AS measure, nominal AS value FROM index_series
  UNION ALL SELECT country_code, mid, 'real_value', real_value FROM index_series),
s AS (SELECT 'policy' AS series, 10 AS k, country_code AS code, 'policy_rate' AS measure, CAST(floor(mid / 12) AS INT) AS y, mid AS id,
    value, obs_status, CAST(NULL AS DOUBLE) AS value_12m_ago, CAST(NULL AS DOUBLE) AS change_12m_pct FROM policy_series
  UNION ALL SELECT 'credit', 20, CAST(nk AS VARCHAR), measure, CAST(floor(qid / 4) AS INT), qid, value, NULL, NULL, NULL FROM credit_series
  UNION ALL SELECT 'index', 6, a.c, a.measure, CAST(floor(a.mid / 12) AS INT), a.mid, a.value, NULL, b.value, 100 * (a.value / nullif(b.value, 0) - 1)
    FROM ix a LEFT JOIN ix b ON a.c = b.c AND a.measure = b.measure AND a.mid = b.mid + 12)
SELECT s.series, s.code, e.y AS selected_year, measure, id, round(value, 6) + 0.0 AS value, obs_status,
  round(value_12m_ago, 6) + 0.0 AS value_12m_ago, round(change_12m_pct, 6) + 0.0 AS change_12m_pct
FROM s JOIN (SELECT DISTINCT series, code, y FROM s) e ON e.series = s.series AND e.code = s.code AND s.y BETWEEN e.y - k + 1 AND e.y""")
def history_window(inp):
    policy = inp.policy_series.select(F.col("country_code").alias("code"), F.lit("policy_rate").alias("measure"), "mid",
                                      "value", "obs_status")
    credit = inp.credit_series.select(F.col("nk").cast("string").alias("code"), "measure", "qid", "value")
    changed = op.change_12m(index(inp)).withColumnRenamed("country_code", "code")
    frame = None
    for name, rows, order, per_year in (("policy", policy, "mid", 12), ("credit", credit, "qid", 4), ("index", changed, "mid", 12)):
        window = op.history_window(rows, order, per_year, op.HISTORY_YEARS[name])
        window = window.withColumnRenamed(order, "id").withColumn("series", F.lit(name))
        frame = window if frame is None else frame.unionByName(window, allowMissingColumns=True)
    return frame.withColumns({c: rounded(c, 6) for c in ("value", "value_12m_ago", "change_12m_pct")})


@query("trim_to_last_observed", """
WITH p AS (SELECT country_code, mid, CASE WHEN mid > 23995 THEN NULL ELSE value END AS value FROM policy_series)
SELECT p.country_code, mid, value, n AS observations FROM p JOIN (SELECT country_code, max(mid) FILTER (WHERE value IS NOT NULL) AS last, count(value) AS n FROM p GROUP BY 1) l
USING (country_code) WHERE mid <= last AND n >= 40""")
def trim_to_last_observed(inp):
    rows = inp.policy_series.withColumn("value", F.when(F.col("mid") <= 23995, F.col("value")))
    return op.trim_trailing(rows, ["country_code"], 40).select("country_code", "mid", "value", "observations")


@query("identity_reconcile", """
SELECT nk, qid, CASE WHEN count(DISTINCT measure) < 3 THEN 'incomplete'
  WHEN abs(sum(CASE measure WHEN 'ratio' THEN value ELSE -value END)) <= 0.001 THEN 'ok' ELSE 'mismatch' END AS status
FROM (SELECT nk, qid, measure, CASE WHEN measure = 'gap' AND nk % 6 = 0 AND qid % 2 = 0 THEN value + 0.5 ELSE value END AS value FROM credit_series)
GROUP BY nk, qid""")
def identity_reconcile(inp):
    broken = F.when((F.col("measure") == "gap") & (F.col("nk") % 6 == 0) & (F.col("qid") % 2 == 0), F.col("value") + 0.5)
    rows = inp.credit_series.withColumn("value", broken.otherwise(F.col("value")))
    return op.identity_gaps(rows).select("nk", "qid", "status")


@query("financial_sheet", """
WITH pl AS (SELECT country_code, CAST(floor(mid / 12) AS INT) AS year, max(mid) AS mid FROM policy_series GROUP BY ALL),
cl AS (SELECT nk, CAST(floor(qid / 4) AS INT) AS year, max(qid) AS qid FROM credit_series GROUP BY ALL),
m AS (SELECT unnest(['ratio', 'trend', 'gap']) AS measure)
SELECT pl.country_code, pl.year, 'policy_rate' AS measure, CAST(CAST(floor(mid / 12) AS INT) AS VARCHAR) || '-' || lpad(CAST(mid % 12 + 1 AS VARCHAR), 2, '0') AS period,
  'monthly' AS frequency, '% per year' AS unit, round(value, 6) + 0.0 AS value, obs_status FROM pl JOIN policy_series USING (country_code, mid)
UNION ALL SELECT 'N' || lpad(CAST(cl.nk AS VARCHAR), 2, '0'), cl.year, m.measure, CAST(CAST(floor(cl.qid / 4) AS INT) AS VARCHAR) || '-Q' || CAST(cl.qid % 4 + 1 AS VARCHAR),
  'quarterly', CASE m.measure WHEN 'gap' THEN 'percentage points' ELSE '% of GDP' END, round(c.value, 6) + 0.0, CASE WHEN c.value IS NULL THEN '' ELSE 'A' END
FROM cl CROSS JOIN m LEFT JOIN credit_series c ON c.nk = cl.nk AND c.qid = cl.qid AND c.measure = m.measure""")
def financial_sheet(inp):
    policy = op.latest_in_year(inp.policy_series, ["country_code"]).select(
        "country_code", "year", F.lit("policy_rate").alias("measure"), month_label(F.col("mid")).alias("period"),
        F.lit("monthly").alias("frequency"), F.lit("% per year").alias("unit"), rounded("value", 6).alias("value"),
        "obs_status")
    wide = op.latest_quarter(inp.credit_series)
    long = wide.unpivot(["nk", "year", "qid"], ["ratio", "trend", "gap"], "measure", "value")
    credit = long.select(
        F.concat(F.lit("N"), F.lpad(F.col("nk").cast("string"), 2, "0")).alias("country_code"), "year", "measure",
        F.concat(F.floor(F.col("qid") / 4).cast("int").cast("string"), F.lit("-Q"),
                 (F.col("qid") % 4 + 1).cast("string")).alias("period"),
        F.lit("quarterly").alias("frequency"),
        F.when(F.col("measure") == "gap", "percentage points").otherwise("% of GDP").alias("unit"),
        rounded("value", 6).alias("value"), F.when(F.col("value").isNull(), "").otherwise("A").alias("obs_status"))
    return policy.unionByName(credit)
