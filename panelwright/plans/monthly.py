from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, month_number, rounded
from panelwright.operators import monthly as op
from panelwright.plans.registry import query

LATEST = 2001 * 12 + 7  # last month of the test tables


def r(frame, names, digits=6):
    return frame.withColumns({n: rounded(n, digits) for n in names})


@query("month_index", """
WITH x AS (SELECT key, mid, CASE WHEN mid % 10 = 0 THEN substr(period, 1, 4) || '-13' WHEN mid % 10 = 5 THEN replace(period, '-', '') ELSE period END AS text FROM monthly_obs)
SELECT key, mid, text, CASE WHEN regexp_full_match(text, '[0-9]{4}-(0[1-9]|1[0-2])') THEN mid END AS parsed,
  CASE WHEN regexp_full_match(text, '[0-9]{4}-(0[1-9]|1[0-2])') THEN text END AS label FROM x""")
def month_index(inp):
    text = F.when(F.col("mid") % 10 == 0, F.concat(F.substring("period", 1, 4), F.lit("-13"))).when(
        F.col("mid") % 10 == 5, F.replace("period", F.lit("-"), F.lit(""))).otherwise(F.col("period"))
    rows = inp.monthly_obs.select("key", "mid", text.alias("text"))
    parsed = rows.withColumn("parsed", month_number(F.col("text")))
    return parsed.withColumn("label", month_label(F.col("parsed")))


@query("cyclic_month", """
SELECT key, mid, round(sin(2 * pi() * (mid % 12) / 12), 9) + 0.0 AS month_sin, round(cos(2 * pi() * (mid % 12) / 12), 9) + 0.0 AS month_cos FROM monthly_obs""")
def cyclic_month(inp):
    angle = 2 * F.pi() * (F.col("mid") % 12) / 12
    return inp.monthly_obs.select("key", "mid", rounded(F.sin(angle), 9).alias("month_sin"),
                                  rounded(F.cos(angle), 9).alias("month_cos"))


@query("direction_label", """
SELECT a.key, a.mid, round(a.value - b.value, 4) + 0.0 AS delta, CASE WHEN round(a.value - b.value, 4) > 0 THEN 'up' WHEN round(a.value - b.value, 4) < 0 THEN 'down'
  WHEN a.value = b.value THEN 'flat' END AS direction, CASE WHEN a.key = 'p1' THEN 'index points' ELSE 'percentage points' END AS unit
FROM monthly_obs a LEFT JOIN monthly_obs b ON a.key = b.key AND a.mid = b.mid + 1""")
def direction_label(inp):
    rows = inp.monthly_obs.select("key", "mid", rounded(F.col("value") - op.lagged(1), 4).alias("delta"))
    unit = F.when(F.col("key") == "p1", "index points").otherwise("percentage points")
    return rows.withColumns({"direction": op.direction("delta"), "unit": unit})


@query("calendar_densify", "SELECT s.key, s.mid, m.value, m.period FROM spine s LEFT JOIN monthly_obs m ON m.key = s.key AND m.mid = s.mid")
def calendar_densify(inp):
    return op.densify(inp.monthly_obs, ["value", "period"])


@query("gap_segments", """
WITH i AS (SELECT key, mid, mid - row_number() OVER (PARTITION BY key ORDER BY mid) AS g FROM monthly_obs),
s AS (SELECT key, g, min(mid) AS first_mid, max(mid) AS last_mid, count(*) AS length FROM i GROUP BY ALL)
SELECT key, first_mid, last_mid, length, CAST(row_number() OVER (PARTITION BY key ORDER BY first_mid) AS INT) AS segment FROM s""")
def gap_segments(inp):
    return op.gap_segments(inp.monthly_obs)


@query("calendar_gaps", """
SELECT key, mid, next_mid, CAST(next_mid - mid - 1 AS INT) AS missing_months FROM (SELECT a.key, a.mid, (SELECT min(b.mid) FROM monthly_obs b WHERE b.key = a.key AND b.mid > a.mid) AS next_mid
  FROM monthly_obs a) WHERE next_mid - mid > 1""")
def calendar_gaps(inp):
    return op.calendar_gaps(inp.monthly_obs)


@query("simple_baselines", """
WITH p AS (SELECT a.key, a.mid, count(b.mid) AS n, arg_min(b.value, b.mid) AS y1 FROM monthly_obs a LEFT JOIN monthly_obs b ON a.key = b.key AND b.mid < a.mid GROUP BY ALL)
SELECT a.key, a.mid, a.value, l.value AS persistence, s.value AS seasonal, round(l.value + (l.value - y1) / nullif(n - 1, 0), 6) + 0.0 AS drift
FROM monthly_obs a JOIN p USING (key, mid) LEFT JOIN monthly_obs l ON l.key = a.key AND l.mid = a.mid - 1 LEFT JOIN monthly_obs s ON s.key = a.key AND s.mid = a.mid - 12""")
def simple_baselines(inp):
    return r(op.simple_baselines(inp.monthly_obs), ["drift"])


SCALE = """sc AS (SELECT a.key, a.mid, avg(d) AS s, count(d) AS n FROM monthly_obs a LEFT JOIN (SELECT x.key, x.mid, abs(x.value - y.value) AS d
  FROM monthly_obs x JOIN monthly_obs y ON x.key = y.key AND x.mid = y.mid + 12) m ON m.key = a.key AND m.mid < a.mid GROUP BY ALL)"""


@query("seasonal_scale", f"""
WITH {SCALE} SELECT key, mid, value, CASE WHEN s > 1e-12 THEN round(s, 6) + 0.0 END AS mase_scale, n AS pairs FROM monthly_obs JOIN sc USING (key, mid)""")
def seasonal_scale(inp):
    return r(op.seasonal_scale(inp.monthly_obs), ["mase_scale"])


@query("prefix_context", """
WITH p AS (SELECT a.key, a.mid, count(b.mid) AS context_n, string_agg(CAST(b.mid AS VARCHAR), ',' ORDER BY b.mid) AS periods,
  string_agg(CAST(CAST(b.value AS DECIMAL(18, 3)) AS VARCHAR), ',' ORDER BY b.mid) AS vals, max(b.mid) AS last
  FROM monthly_obs a JOIN monthly_obs b ON a.key = b.key AND b.mid < a.mid GROUP BY ALL)
SELECT key, mid, context_n, periods, vals AS "values" FROM p WHERE context_n BETWEEN 36 AND 60 AND last = mid - 1""")
def prefix_context(inp):
    text = F.transform("values", lambda v: v.cast("decimal(18,3)").cast("string"))
    return op.prefix_context(inp.monthly_obs).select(
        "key", "mid", "context_n", F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"),
        F.array_join(text, ",").alias("values"))


CHANGE = """chg AS (SELECT a.key, a.mid, c.name, c.basis, c.topic, a.value, a.period, b.value AS previous, CASE WHEN basis = 'year to date amount' THEN 'cumulative amount'
    WHEN basis = 'year to date rate' AND a.mid % 12 = 0 THEN 'crosses the year' WHEN b.value IS NULL THEN 'previous month not recorded' ELSE '' END AS reason
  FROM monthly_obs a JOIN catalog c ON a.key = c.key LEFT JOIN monthly_obs b ON a.key = b.key AND a.mid = b.mid + 1),
chd AS (SELECT *, CASE WHEN reason = '' THEN round(value - previous, 4) + 0.0 END AS delta FROM chg),
chx AS (SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' END AS direction FROM chd)"""


@query("natural_month_change", f"WITH {CHANGE} SELECT key, mid, name, basis, value, previous, delta, direction, reason FROM chx")
def natural_month_change(inp):
    rows = op.month_change(inp.monthly_obs, op.catalogue(inp.monthly_obs))
    return rows.select("key", "mid", "name", "basis", "value", "previous", "delta", "direction", "reason")


@query("topic_headlines", f"""
WITH {CHANGE}, f AS (SELECT * FROM chx WHERE mid = (SELECT max(mid) FROM monthly_obs m WHERE m.key = chx.key) AND delta IS NOT NULL AND {LATEST} - mid <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY key) AS n FROM f WHERE mid = (SELECT max(mid) FROM f g WHERE g.topic = f.topic))
SELECT topic, mid, string_agg(key, ',' ORDER BY key) AS members, string_agg(name || ' ' || direction, ', ' ORDER BY key) FILTER (WHERE n <= 2) AS title FROM n GROUP BY ALL""")
def topic_headlines(inp):
    return op.topic_headlines(op.month_change(inp.monthly_obs, op.catalogue(inp.monthly_obs)), LATEST)


@query("rolling_percentile_60m", """
WITH w AS (SELECT a.key, a.mid, a.value, count(*) AS n, count(*) FILTER (WHERE b.value < a.value) + 0.5 * count(*) FILTER (WHERE b.value = a.value) AS k
  FROM monthly_obs a JOIN monthly_obs b ON a.key = b.key AND b.mid BETWEEN a.mid - 59 AND a.mid GROUP BY ALL)
SELECT w.key, w.mid, w.value, n AS sample, round(100.0 * n / 60, 1) AS coverage_pct, CASE WHEN n >= 24 AND 100.0 * n / 60 >= 70 THEN round(100.0 * k / n, 1) END AS percentile,
  round(w.value - y.value, 3) + 0.0 AS year_ago_delta FROM w LEFT JOIN monthly_obs y ON y.key = w.key AND y.mid = w.mid - 12""")
def rolling_percentile_60m(inp):
    return op.rolling_percentile(inp.monthly_obs)


CYCLE = """cal AS (SELECT CAST(unnest(generate_series((SELECT min(mid) FROM monthly_obs), (SELECT max(mid) FROM monthly_obs))) AS INT) AS mid),
wide AS (SELECT mid, max(value) FILTER (WHERE key = 'p1') AS p1, max(value) FILTER (WHERE key = 'p2') AS p2, max(value) FILTER (WHERE key = 'p3') AS p3,
  max(value) FILTER (WHERE key = 'p4') AS p4 FROM cal LEFT JOIN monthly_obs USING (mid) GROUP BY mid),
cyc AS (SELECT a.mid, 100 * (a.p1 / b.p1 - 1) AS ip_yoy, 100 * (a.p2 / b.p2 - 1) AS cpi_yoy, a.p3 - b.p3 AS unemployment_change, a.p4 AS policy_rate, a.p3 - q.p3 AS unemployment_change_3m,
  CASE WHEN a.p1 IS NOT NULL AND f.p1 IS NOT NULL THEN CAST(f.p1 < a.p1 AS INT) END AS contraction
  FROM wide a LEFT JOIN wide b ON b.mid = a.mid - 12 LEFT JOIN wide q ON q.mid = a.mid - 3 LEFT JOIN wide f ON f.mid = a.mid + 3)"""


@query("yoy_features", f"""
WITH {CYCLE} SELECT mid, round(ip_yoy, 6) + 0.0 AS ip_yoy, round(cpi_yoy, 6) + 0.0 AS cpi_yoy, round(unemployment_change, 6) + 0.0 AS unemployment_change,
  policy_rate, round(unemployment_change_3m, 6) + 0.0 AS unemployment_change_3m FROM cyc""")
def yoy_features(inp):
    frame = op.cycle_features(inp.monthly_obs, 3).drop("contraction")
    return r(frame, ["ip_yoy", "cpi_yoy", "unemployment_change", "unemployment_change_3m"])


@query("future_label", f"WITH {CYCLE} SELECT mid, contraction FROM cyc")
def future_label(inp):
    return op.cycle_features(inp.monthly_obs, 3).select("mid", "contraction")


@query("purged_training_window", f"""
WITH {CYCLE}, ok AS (SELECT * FROM cyc WHERE ip_yoy IS NOT NULL AND cpi_yoy IS NOT NULL AND unemployment_change IS NOT NULL AND policy_rate IS NOT NULL AND contraction IS NOT NULL)
SELECT c.mid, count(*) AS train_n, min(ok.mid) AS train_start, max(ok.mid) AS train_end, CAST(sum(ok.contraction) AS BIGINT) AS events
FROM cyc c JOIN ok ON ok.mid >= c.mid - 3 - 36 AND ok.mid < c.mid - 3 GROUP BY c.mid HAVING count(*) >= 18""")
def purged_training_window(inp):
    return op.purged_windows(op.cycle_features(inp.monthly_obs, 3), 3, 36, 18)


LAGS = """lg AS (SELECT a.key, a.mid, a.value, b.value AS lag1, c.value AS lag2, d.value AS lag3, e.value AS lag12 FROM monthly_obs a
  JOIN monthly_obs b ON b.key = a.key AND b.mid = a.mid - 1 JOIN monthly_obs c ON c.key = a.key AND c.mid = a.mid - 2
  JOIN monthly_obs d ON d.key = a.key AND d.mid = a.mid - 3 JOIN monthly_obs e ON e.key = a.key AND e.mid = a.mid - 12)"""


@query("monthly_lag_features", f"""
WITH {LAGS} SELECT *, round(sin(2 * pi() * (mid % 12) / 12), 9) + 0.0 AS month_sin, round(cos(2 * pi() * (mid % 12) / 12), 9) + 0.0 AS month_cos FROM lg""")
def monthly_lag_features(inp):
    return r(op.lag_features(inp.monthly_obs), ["month_sin", "month_cos"], 9)


@query("anomaly_features", """
SELECT a.key, a.mid, a.value AS level, round(a.value - b.value, 6) + 0.0 AS change_1m, round(a.value - c.value, 6) + 0.0 AS change_12m
FROM monthly_obs a JOIN monthly_obs b ON b.key = a.key AND b.mid = a.mid - 1 JOIN monthly_obs c ON c.key = a.key AND c.mid = a.mid - 12""")
def anomaly_features(inp):
    return r(op.anomaly_features(inp.monthly_obs), ["change_1m", "change_12m"])


@query("chronological_split", f"""
WITH {LAGS}, n AS (SELECT key, mid, row_number() OVER (PARTITION BY key ORDER BY mid) AS n, max(mid) OVER (PARTITION BY key) AS last FROM lg)
SELECT key, mid, CASE WHEN n <= 24 THEN 'train' WHEN mid > last - 12 THEN 'test' ELSE 'validation' END AS split FROM n""")
def chronological_split(inp):
    return op.chronological_split(op.lag_features(inp.monthly_obs)).select("key", "mid", "split")


@query("publication_boundary", """
SELECT t.key, t.mid AS target_mid, i.mid, 'input after issue date' AS reason FROM pub t JOIN pub i ON i.key = t.key AND i.mid < t.mid
  AND i.published >= make_date(CAST(floor(t.mid / 12) AS INT), CAST(t.mid % 12 + 1 AS INT), 20)
UNION ALL SELECT key, mid, mid, 'target already published' FROM pub WHERE published <= make_date(CAST(floor(mid / 12) AS INT), CAST(mid % 12 + 1 AS INT), 20)""")
def publication_boundary(inp):
    return op.boundary_violations(op.with_published(inp.monthly_obs))


@query("origin_plan", """
WITH l AS (SELECT key, max(mid) AS last FROM monthly_obs GROUP BY key)
SELECT t.key, t.mid, CASE WHEN last - t.mid < 12 THEN 'audit' ELSE 'development' END AS split, count(*) AS context_n, min(c.mid) AS context_start, max(c.mid) AS context_end,
  CAST(max(c.published) AS VARCHAR) AS latest_context_publication, CAST(any_value(t.published) AS VARCHAR) AS target_publication, any_value(t.period) AS target
FROM pub t JOIN l USING (key) JOIN pub c ON c.key = t.key AND c.mid < t.mid WHERE last - t.mid < 24 GROUP BY t.key, t.mid, last""")
def origin_plan(inp):
    frame = op.origin_plan(op.with_published(inp.monthly_obs))
    return frame.withColumns({c: F.col(c).cast("string") for c in ("latest_context_publication", "target_publication")})


@query("window_mean", """
WITH w AS (SELECT r.request_id, r.key, r.p, r.q, count(m.value) AS n, avg(m.value) AS m FROM requests r LEFT JOIN monthly_obs m ON m.key = r.key AND m.mid BETWEEN r.p AND r.q GROUP BY ALL)
SELECT request_id, key, p, q, n, CASE WHEN n = q - p + 1 AND n BETWEEN 2 AND 24 THEN round(m, 6) + 0.0 END AS mean,
  CASE WHEN n = q - p + 1 AND n BETWEEN 2 AND 24 THEN 'answered' ELSE 'refused' END AS status FROM w""")
def window_mean(inp):
    return r(op.window_mean(inp.requests, inp.monthly_obs), ["mean"])


@query("extrema_with_ties", """
WITH w AS (SELECT r.request_id, m.value, m.period, min(m.value) OVER g AS low, max(m.value) OVER g AS high FROM requests r JOIN monthly_obs m ON m.key = r.key AND m.mid BETWEEN r.p AND r.q
  WINDOW g AS (PARTITION BY r.request_id))
SELECT request_id, low, high, string_agg(period, ',' ORDER BY period) FILTER (WHERE value = low) AS low_periods, string_agg(period, ',' ORDER BY period) FILTER (WHERE value = high) AS high_periods
FROM w GROUP BY ALL""")
def extrema_with_ties(inp):
    return op.extrema(inp.requests, inp.monthly_obs)


@query("breadth_above_threshold", """
SELECT mid, count(*) AS total, count(*) FILTER (WHERE value > 255) AS above, count(*) FILTER (WHERE value = 255) AS equal
FROM monthly_obs WHERE key IN ('p1', 'p2', 'p3') GROUP BY mid HAVING count(*) = 3""")
def breadth_above_threshold(inp):
    return op.breadth(inp.monthly_obs, ["p1", "p2", "p3"], 255.0)


@query("theme_freshness", """
SELECT topic, count(*) AS members, min(l) AS oldest_latest, max(l) AS newest_latest, min(l) <> max(l) AS partial
FROM catalog LEFT JOIN (SELECT key, max(mid) AS l FROM monthly_obs GROUP BY key) USING (key) GROUP BY topic""")
def theme_freshness(inp):
    return op.theme_freshness(inp.monthly_obs, op.catalogue(inp.monthly_obs))


@query("source_status", """
SELECT 'stats.example.org' AS host, key, count(*) AS rows, min(period) AS first_period, max(period) AS last_period, count(DISTINCT source_url) AS sources,
  count(*) FILTER (WHERE mid % 7 <> 0) AS dated, count(*) FILTER (WHERE mid % 7 = 0) AS undated FROM monthly_obs GROUP BY key""")
def source_status(inp):
    rows = op.with_published(inp.monthly_obs).withColumn("published", F.when(F.col("mid") % 7 != 0, F.col("published")))
    return op.source_status(rows, "source_url")


@query("period_breakdown", """
WITH b AS (SELECT a.key, a.mid, (l.value - a.value) * (l.value - a.value) AS e1, (s.value - a.value) * (s.value - a.value) AS e2 FROM monthly_obs a
  JOIN monthly_obs l ON l.key = a.key AND l.mid = a.mid - 1 JOIN monthly_obs s ON s.key = a.key AND s.mid = a.mid - 12),
p AS (SELECT *, CASE WHEN mid < 1998 * 12 THEN 'to 1997' WHEN mid < 2000 * 12 THEN '1998-1999' ELSE 'from 2000' END AS phase FROM b)
SELECT key, phase, count(*) AS months, round(avg(e1), 6) + 0.0 AS persistence_mse, round(avg(e2), 6) + 0.0 AS seasonal_mse, round(avg(e1) - avg(e2), 6) + 0.0 AS difference FROM p GROUP BY ALL""")
def period_breakdown(inp):
    rows = op.simple_baselines(inp.monthly_obs).dropna(subset=["persistence", "seasonal"])
    phase = F.when(F.col("mid") < 1998 * 12, "to 1997").when(F.col("mid") < 2000 * 12, "1998-1999").otherwise("from 2000")
    out = rows.groupBy("key", phase.alias("phase")).agg(
        F.count("*").alias("months"), F.avg(F.pow(F.col("persistence") - F.col("value"), 2)).alias("persistence_mse"),
        F.avg(F.pow(F.col("seasonal") - F.col("value"), 2)).alias("seasonal_mse"))
    return r(out.withColumn("difference", F.col("persistence_mse") - F.col("seasonal_mse")),
             ["persistence_mse", "seasonal_mse", "difference"])


@query("missing_worklist", """
SELECT k.key, m.mid FROM (SELECT DISTINCT key FROM monthly_obs WHERE key <> 'p1') k CROSS JOIN (SELECT mid FROM monthly_obs WHERE key = 'p1') m
WHERE NOT EXISTS (SELECT 1 FROM monthly_obs x WHERE x.key = k.key AND x.mid = m.mid)""")
def missing_worklist(inp):
    return op.missing_worklist(inp.monthly_obs, "p1")


@query("source_precedence", """
WITH c AS (SELECT key, mid, value, 'table' AS origin FROM monthly_obs WHERE mid % 3 <> 0 UNION ALL SELECT key, mid, value + 1, 'narrative' FROM monthly_obs WHERE mid % 2 = 0)
SELECT key, mid, value, origin FROM c WHERE origin = 'table' OR NOT EXISTS (SELECT 1 FROM c t WHERE t.origin = 'table' AND t.key = c.key AND t.mid = c.mid)""")
def source_precedence(inp):
    table = inp.monthly_obs.filter("mid % 3 <> 0").select("key", "mid", "value", F.lit("table").alias("origin"))
    narrative = inp.monthly_obs.filter("mid % 2 = 0").select(
        "key", "mid", (F.col("value") + 1).alias("value"), F.lit("narrative").alias("origin"))
    return op.source_precedence(table.unionByName(narrative), "table")


@query("hydrate_missing", """
WITH o AS (SELECT key, mid, CASE WHEN mid % 4 = 0 THEN '' WHEN mid % 4 = 1 THEN NULL ELSE CAST(published AS VARCHAR) END AS published FROM pub),
l AS (SELECT key, mid, CAST(published AS VARCHAR) || ' (page)' AS n FROM pub WHERE mid % 5 <> 0)
SELECT o.key, o.mid, CASE WHEN coalesce(trim(published), '') = '' THEN coalesce(n, published) ELSE published END AS published,
  coalesce(trim(published), '') = '' AND n IS NOT NULL AS hydrated FROM o LEFT JOIN l ON l.key = o.key AND l.mid = o.mid""")
def hydrate_missing(inp):
    dated = op.with_published(inp.monthly_obs).select("key", "mid", F.col("published").cast("string").alias("published"))
    holes = F.when(F.col("mid") % 4 == 0, "").when(F.col("mid") % 4 != 1, F.col("published"))
    lookup = dated.filter("mid % 5 <> 0").withColumn("published", F.concat("published", F.lit(" (page)")))
    return op.hydrate(dated.withColumn("published", holes), lookup, ["key", "mid"], "published")


PRESETS = [("fast", "p1"), ("fast", "p2"), ("slow", "p4"), ("slow", "p5"), ("slow", "p9")]


@query("preset_comparison_24m", f"""
WITH p AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PRESETS)}) t(preset, key)), s AS (SELECT *, CAST(unnest(generate_series({LATEST} - 23, {LATEST})) AS INT) AS mid FROM p)
SELECT preset, s.key, s.mid, m.value, (SELECT count(*) FROM monthly_obs x WHERE x.key = s.key AND x.mid BETWEEN {LATEST} - 23 AND {LATEST}) AS collected
FROM s LEFT JOIN monthly_obs m ON m.key = s.key AND m.mid = s.mid""")
def preset_comparison_24m(inp):
    presets = inp.spark.createDataFrame(PRESETS, "preset string, key string")
    return op.preset_window(inp.monthly_obs, presets, LATEST, 24)
