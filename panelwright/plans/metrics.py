from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import features as feat
from panelwright.operators import metrics as op
from panelwright.operators import monthly as mo
from panelwright.operators import panel as panel_op
from panelwright.plans.features import sector_rows
from panelwright.plans.registry import query
from panelwright.session import materialized

METHODS = ["p_model", "p_reference"]
#: Bootstrap draws: resampled clusters and groups, and moving blocks (three months here: the fixture series are short).
REPLICATES, BLOCK_REPLICATES = 2000, 4000
HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def r(frame, names, digits=6):
    return frame.withColumns({n: rounded(n, digits) for n in names})


def scored_rows(inp):
    rows = materialized(sector_rows(inp))
    return rows.join(feat.expanding_event_rates(rows), ["year", "hs2"])


def backtest(inp):
    rows = mo.simple_baselines(inp.monthly_obs).dropna(subset=["persistence", "seasonal"])
    return mo.chronological_split(rows)


LONG = "lng AS (SELECT outcome, lang, source, 'p_model' AS method, p_model AS p FROM scored UNION ALL SELECT outcome, lang, source, 'p_reference', p_reference FROM scored)"
BT = """b0 AS (SELECT a.key, a.mid, a.value, l.value AS persistence, s.value AS seasonal, row_number() OVER (PARTITION BY a.key ORDER BY a.mid) AS n, max(a.mid) OVER (PARTITION BY a.key) AS last
  FROM monthly_obs a JOIN monthly_obs l ON l.key = a.key AND l.mid = a.mid - 1 JOIN monthly_obs s ON s.key = a.key AND s.mid = a.mid - 12),
bt AS (SELECT *, CASE WHEN n <= 24 THEN 'train' WHEN mid > last - 12 THEN 'test' ELSE 'validation' END AS split FROM b0),
er AS (SELECT key, mid, split, 'persistence' AS method, persistence - value AS error FROM bt UNION ALL SELECT key, mid, split, 'seasonal', seasonal - value FROM bt)"""


@query("mae_rmse", f"""
WITH {BT} SELECT key, split, method, count(*) AS n, round(avg(abs(error)), 6) + 0.0 AS mae, round(sqrt(avg(error * error)), 6) + 0.0 AS rmse FROM er GROUP BY ALL""")
def mae_rmse(inp):
    errors = op.long_errors(backtest(inp), ["key", "split"], ["persistence", "seasonal"])
    return r(op.mae_rmse(errors, ["key", "split", "method"]), ["mae", "rmse"])


@query("argmin_method", f"""
WITH {BT}, m AS (SELECT key, method, avg(abs(error)) AS mae FROM er WHERE split = 'validation' GROUP BY ALL)
SELECT key, arg_min(method, mae) AS method, round(min(mae), 6) + 0.0 AS mae FROM m GROUP BY key""")
def argmin_method(inp):
    errors = op.long_errors(backtest(inp).filter("split = 'validation'"), ["key"], ["persistence", "seasonal"])
    return r(op.best_method(op.mae_rmse(errors, ["key", "method"]), ["key"], "mae"), ["mae"])


@query("probability_metrics", f"""
WITH {LONG} SELECT lang, source, method, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS events, round(avg(outcome), 6) + 0.0 AS event_rate, round(avg((p - outcome) * (p - outcome)), 6) + 0.0 AS brier,
  round(-avg(outcome * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - outcome) * ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) + 0.0 AS log_loss,
  count(*) FILTER (WHERE p < 0 OR p > 1) AS invalid FROM lng GROUP BY ALL""")
def probability_metrics(inp):
    return r(op.probability_metrics(inp.scored, ["lang", "source"], METHODS), ["event_rate", "brier", "log_loss"])


AUC = """auc AS (SELECT {k}, method, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS events, (sum(rk) FILTER (WHERE outcome = 1) - sum(outcome) * (sum(outcome) + 1) / 2.0) / nullif(sum(outcome) * (count(*) - sum(outcome)), 0) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {k}, method ORDER BY p) + (count(*) OVER (PARTITION BY {k}, method, p) - 1) / 2.0 AS rk FROM lng) GROUP BY {k}, method)"""


@query("rank_auc", f"""
WITH {LONG}, {AUC.format(k="lang")} SELECT lang, method, n, events, CASE WHEN n >= 30 THEN round(auc, 6) + 0.0 END AS roc_auc FROM auc""")
def rank_auc(inp):
    return op.rank_metrics(inp.scored, ["lang"], METHODS).select(
        "lang", "method", "n", "events", rounded("roc_auc", 6).alias("roc_auc"))


@query("average_precision", f"""
WITH {LONG}, c AS (SELECT lang, method, p, count(*) AS n, sum(outcome) AS e FROM lng GROUP BY ALL),
k AS (SELECT *, sum(n) OVER w AS above, sum(e) OVER w AS hits, sum(e) OVER (PARTITION BY lang, method) AS pos FROM c WINDOW w AS (PARTITION BY lang, method ORDER BY p DESC))
SELECT lang, method, round(CASE WHEN any_value(pos) > 0 THEN sum(e / pos * (hits / above)) END, 6) + 0.0 AS average_precision FROM k GROUP BY lang, method""")
def average_precision(inp):
    return op.rank_metrics(inp.scored, ["lang"], METHODS).select(
        "lang", "method", rounded("average_precision", 6).alias("average_precision"))


@query("calibration_bins", f"""
WITH {LONG}, s AS (SELECT unnest(['p_model', 'p_reference']) AS method), b AS (SELECT CAST(unnest(generate_series(0, 9)) AS INT) AS bin),
c AS (SELECT method, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mp, avg(outcome) AS er FROM lng GROUP BY ALL)
SELECT s.method, b.bin, b.bin / 10.0::DOUBLE AS lower, (b.bin + 1) / 10.0::DOUBLE AS upper, coalesce(n, 0) AS n, round(mp, 6) + 0.0 AS mean_prediction, round(er, 6) + 0.0 AS event_rate
FROM s CROSS JOIN b LEFT JOIN c ON c.method = s.method AND c.bin = b.bin""")
def calibration_bins(inp):
    return r(op.calibration(inp.scored, METHODS), ["mean_prediction", "event_rate"])


@query("mase", f"""
WITH {BT}, sc AS (SELECT a.key, a.mid, avg(d) AS s FROM monthly_obs a LEFT JOIN (SELECT x.key, x.mid, abs(x.value - y.value) AS d
  FROM monthly_obs x JOIN monthly_obs y ON x.key = y.key AND x.mid = y.mid + 12) m ON m.key = a.key AND m.mid < a.mid GROUP BY ALL),
j AS (SELECT er.*, CASE WHEN s > 1e-12 THEN s END AS s FROM er JOIN sc USING (key, mid) WHERE split = 'test'),
k AS (SELECT key, method, count(*) AS n, count(*) FILTER (WHERE s IS NULL) AS undefined_n, avg(abs(error) / s) AS mase FROM j GROUP BY ALL)
SELECT key, method, n, undefined_n, round(mase, 6) + 0.0 AS mase, round(avg(mase) OVER (PARTITION BY method), 6) + 0.0 AS macro_mase,
  mase <= min(mase) OVER (PARTITION BY key) AS wins FROM k""")
def mase(inp):
    scales = mo.seasonal_scale(inp.monthly_obs).select("key", "mid", "mase_scale")
    rows = backtest(inp).filter("split = 'test'").join(scales, ["key", "mid"])
    errors = op.long_errors(rows, ["key", "mase_scale"], ["persistence", "seasonal"])
    table = op.mase(errors, ["key", "method"])
    # one row per indicator and method
    macro = F.avg("mase").over(Window.partitionBy("method"))
    wins = F.col("mase") <= F.min("mase").over(Window.partitionBy("key"))
    return r(table.withColumns({"macro_mase": macro, "wins": wins}), ["mase", "macro_mase"])


@query("interval_diagnostics", f"""
WITH {BT}, q AS (SELECT key, value AS y, persistence - 20 AS p10, persistence AS p50, persistence + 30 AS p90 FROM bt WHERE split = 'test')
SELECT key, count(*) AS n, round(avg((y BETWEEN p10 AND p90)::INT), 6) + 0.0 AS coverage, round(avg(p90 - p10), 6) + 0.0 AS mean_width, round(avg(greatest(0.1 * (y - p10), -0.9 * (y - p10))), 6) + 0.0 AS pinball_p10,
  round(avg(greatest(0.5 * (y - p50), -0.5 * (y - p50))), 6) + 0.0 AS pinball_p50, round(avg(greatest(0.9 * (y - p90), -0.1 * (y - p90))), 6) + 0.0 AS pinball_p90 FROM q GROUP BY key""")
def interval_diagnostics(inp):
    rows = backtest(inp).filter("split = 'test'").withColumns(
        {"p10": F.col("persistence") - 20, "p50": F.col("persistence"), "p90": F.col("persistence") + 30})
    return r(op.interval_diagnostics(rows, ["key"]),
             ["coverage", "mean_width", "pinball_p10", "pinball_p50", "pinball_p90"])


@query("empirical_band", f"""
WITH {BT}, v AS (SELECT key, list_sort(list(abs(error))) AS e, count(*) AS n FROM er WHERE split = 'validation' AND method = 'persistence' GROUP BY key),
b AS (SELECT key, n, e[CAST(ceil(least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1)) AS BIGINT) + 1] AS radius FROM v)
SELECT b.key, round(radius, 6) + 0.0 AS radius, n AS development_n, count(*) AS holdout_n, round(avg((abs(error) <= radius + 1e-12)::INT), 6) + 0.0 AS coverage
FROM b JOIN er ON er.key = b.key AND split = 'test' AND method = 'persistence' GROUP BY ALL""")
def empirical_band(inp):
    errors = op.long_errors(backtest(inp), ["key", "split"], ["persistence"])
    return r(op.empirical_band(errors, "key"), ["radius", "coverage"])


@query("block_bootstrap_ci", f"""
WITH {BT}, d AS (SELECT key, abs(persistence - value) - abs(seasonal - value) AS delta, row_number() OVER (PARTITION BY key ORDER BY mid) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM bt),
s AS (SELECT key, any_value(n) AS n, avg(delta) AS mean FROM d GROUP BY key), rp AS (SELECT *, unnest(generate_series(1, {BLOCK_REPLICATES})) AS replicate FROM s),
sl AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / 3.0) AS BIGINT) - 1)) AS slot FROM rp), st AS (SELECT *, {HASH.format("'block|' || key || '|' || replicate || '|' || slot")} % n AS start FROM sl),
o AS (SELECT *, unnest([0, 1, 2]) AS o FROM st), m AS (SELECT o.key, replicate, avg(d.delta) AS m FROM o JOIN d ON d.key = o.key AND d.i = (start + o) % o.n WHERE slot * 3 + o < o.n GROUP BY ALL)
SELECT m.key, round(quantile_cont(m, 0.025), 6) + 0.0 AS lower, round(quantile_cont(m, 0.975), 6) + 0.0 AS upper, count(*) AS replicates, s.n, round(mean, 6) + 0.0 AS mean FROM m JOIN s USING (key) GROUP BY ALL""")
def block_bootstrap_ci(inp):
    delta = F.abs(F.col("persistence") - F.col("value")) - F.abs(F.col("seasonal") - F.col("value"))
    rows = backtest(inp).select("key", "mid", delta.alias("delta"))
    return r(op.block_bootstrap(rows, "key", "mid", 3, BLOCK_REPLICATES), ["lower", "upper", "mean"])


BOOT = """ix AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {c}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM cl),
sz AS (SELECT {k}, any_value(n) AS n, sum(total) / sum(cnt) AS mean FROM ix GROUP BY {k}), rp AS (SELECT *, unnest(generate_series(1, {REPLICATES})) AS replicate FROM sz),
sl AS (SELECT *, unnest(generate_series(0, n - 1)) AS slot FROM rp), pk AS (SELECT *, CAST('0x' || substr(md5('{l}|' || {t} || '|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS i FROM sl),
vv AS (SELECT {pk}, replicate, sum(total) / sum(cnt) AS v FROM pk JOIN ix USING ({k}, i) GROUP BY ALL)""".replace("{REPLICATES}", str(REPLICATES))
CLUSTERS = """cl AS (SELECT CAST(year AS VARCHAR) AS slice, country_code, sum((sector_rate - outcome) * (sector_rate - outcome) - (global_rate - outcome) * (global_rate - outcome)) AS total, count(*) AS cnt
  FROM sector_scored WHERE outcome IS NOT NULL AND year >= 1999 GROUP BY ALL
  UNION ALL SELECT 'all', country_code, sum((sector_rate - outcome) * (sector_rate - outcome) - (global_rate - outcome) * (global_rate - outcome)), count(*) FROM sector_scored WHERE outcome IS NOT NULL AND year >= 1999 GROUP BY ALL)"""


def slices(rows):
    """Every row once under its year and once under ``all``."""
    return rows.withColumn("slice", F.explode(F.array(F.col("year").cast("string"), F.lit("all"))))


def cluster_table(inp):
    rows = scored_rows(inp).filter("outcome IS NOT NULL AND year >= 1999")
    return op.brier_sums(slices(rows), "sector_rate", "global_rate", ["slice", "country_code"])


@query("cluster_bootstrap_ci", f"""
WITH {CLUSTERS}, {BOOT.format(k="slice", c="country_code", l="cluster", t="slice", pk="slice")}
SELECT slice, round(quantile_cont(v, 0.025), 6) + 0.0 AS lower, round(quantile_cont(v, 0.975), 6) + 0.0 AS upper, count(*) AS replicates, sz.n AS clusters, round(mean, 6) + 0.0 AS mean
FROM vv JOIN sz USING (slice) GROUP BY ALL""")
def cluster_bootstrap_ci(inp):
    return r(op.cluster_bootstrap(cluster_table(inp), ["slice"], "country_code", REPLICATES), ["lower", "upper", "mean"])


@query("event_rate_context", f"""
WITH cl AS (SELECT t.hs2, CAST(t.year AS INT) AS year, k.country_code, sum(k.outcome) AS total, count(*) AS cnt, max(k.year) AS last FROM (SELECT DISTINCT hs2, year FROM sector_rows) t
  JOIN sector_rows k ON k.hs2 = t.hs2 AND k.year < t.year WHERE k.outcome IS NOT NULL GROUP BY ALL), {BOOT.format(k="hs2, year", c="country_code", l="event", t="hs2 || '|' || year", pk="hs2, year")},
lb AS (SELECT hs2, year, CAST(max(last) AS INT) AS last_label_year, CAST(sum(total) AS BIGINT) AS events, CAST(sum(cnt) AS BIGINT) AS n FROM cl GROUP BY ALL)
SELECT hs2, year, last_label_year, events, lb.n, sz.n AS countries, round(events / lb.n, 6) + 0.0 AS event_rate, round((events + 2) / (lb.n + 4), 6) + 0.0 AS smoothed_rate,
  CASE WHEN sz.n >= 2 THEN round(quantile_cont(v, 0.025), 6) + 0.0 END AS lower, CASE WHEN sz.n >= 2 THEN round(quantile_cont(v, 0.975), 6) + 0.0 END AS upper
FROM vv JOIN sz USING (hs2, year) JOIN lb USING (hs2, year) GROUP BY hs2, year, last_label_year, events, lb.n, sz.n""")
def event_rate_context(inp):
    rows = materialized(sector_rows(inp))
    targets = rows.select("hs2", F.col("year").alias("target")).distinct()
    known = rows.filter("outcome IS NOT NULL").groupBy("hs2", "country_code", "year").agg(
        F.sum("outcome").alias("total"), F.count("*").alias("count"))
    # a label year informs every later target year
    spread = known.join(targets, "hs2").filter("year < target")
    clusters = spread.groupBy("hs2", F.col("target").alias("year"), "country_code").agg(
        F.sum("total").alias("total"), F.sum("count").alias("count"), F.max("year").alias("last"))
    keys = ["hs2", "year"]
    labels = clusters.groupBy(*keys).agg(
        F.max("last").alias("last_label_year"), F.sum("total").alias("events"), F.sum("count").alias("n"))
    band = op.cluster_bootstrap(clusters, keys, "country_code", REPLICATES, "event")
    out = labels.join(band, keys)
    enough = F.col("clusters") >= 2
    return out.select(
        *keys, "last_label_year", "events", "n", F.col("clusters").alias("countries"),
        rounded(F.col("events") / F.col("n"), 6).alias("event_rate"),
        rounded((F.col("events") + 2) / (F.col("n") + 4), 6).alias("smoothed_rate"),
        F.when(enough, rounded("lower", 6)).alias("lower"), F.when(enough, rounded("upper", 6)).alias("upper"))


@query("wilson_interval", """
WITH g AS (SELECT lang, source, sum(outcome) AS s, count(*) AS n FROM scored GROUP BY ALL), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT lang, source, CAST(s AS BIGINT) AS success, n, round((s / n + z * z / (2 * n) - z * sqrt(n) * sqrt(s / n * (1 - s / n) + z * z / (4 * n)) / n) / (1 + z * z / n), 6) + 0.0 AS lower,
  round((s / n + z * z / (2 * n) + z * sqrt(n) * sqrt(s / n * (1 - s / n) + z * z / (4 * n)) / n) / (1 + z * z / n), 6) + 0.0 AS upper FROM g, z""")
def wilson_interval(inp):
    groups = inp.scored.groupBy("lang", "source").agg(F.sum("outcome").alias("success"), F.count("*").alias("n"))
    low, high = op.wilson(F.col("success"), F.col("n"))
    return groups.withColumns({"lower": rounded(low, 6), "upper": rounded(high, 6)})


@query("group_rate_bootstrap", f"""
WITH g AS (SELECT lang, source, avg(outcome) AS rate FROM scored GROUP BY ALL), ix AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM g),
sz AS (SELECT lang, any_value(n) AS n, avg(rate) AS mean FROM ix GROUP BY lang), rp AS (SELECT *, unnest(generate_series(1, {REPLICATES})) AS replicate FROM sz), sl AS (SELECT *, unnest(generate_series(0, n - 1)) AS slot FROM rp),
pk AS (SELECT *, CAST('0x' || substr(md5('group|' || lang || '|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS i FROM sl), vv AS (SELECT lang, replicate, avg(rate) AS v FROM pk JOIN ix USING (lang, i) GROUP BY ALL)
SELECT lang, round(quantile_cont(v, 0.025), 6) + 0.0 AS lower, round(quantile_cont(v, 0.975), 6) + 0.0 AS upper, count(*) AS replicates, sz.n AS groups, round(mean, 6) + 0.0 AS mean FROM vv JOIN sz USING (lang) GROUP BY ALL""")
def group_rate_bootstrap(inp):
    groups = inp.scored.groupBy("lang", "source").agg(F.avg("outcome").alias("rate"))
    return r(op.group_rate_bootstrap(groups, ["lang"], "source", REPLICATES), ["lower", "upper", "mean"])


@query("research_gate", f"""
WITH {CLUSTERS}, {BOOT.format(k="slice", c="country_code", l="cluster", t="slice", pk="slice")},
u AS (SELECT slice, quantile_cont(v, 0.975) AS upper, any_value(mean) AS mean FROM vv JOIN sz USING (slice) GROUP BY slice)
SELECT count(*) FILTER (WHERE slice <> 'all') AS periods, count(*) FILTER (WHERE slice <> 'all' AND mean < 0) AS periods_better, round(max(upper) FILTER (WHERE slice = 'all'), 6) + 0.0 AS upper,
  bool_and(CASE WHEN slice = 'all' THEN upper < 0 ELSE mean < 0 END) AS passed FROM u""")
def research_gate(inp):
    table = op.cluster_bootstrap(cluster_table(inp), ["slice"], "country_code", REPLICATES)
    whole = F.col("slice") == "all"
    return table.agg(
        F.count_if(~whole).alias("periods"), F.count_if(~whole & (F.col("mean") < 0)).alias("periods_better"),
        rounded(F.max(F.when(whole, F.col("upper"))), 6).alias("upper"),
        F.every(F.when(whole, F.col("upper") < 0).otherwise(F.col("mean") < 0)).alias("passed"))


@query("relative_improvement", """
WITH c AS (SELECT a.country_code, a.year, any_value(a.value) AS v, CASE WHEN count(b.value) >= 3 THEN median(b.value) ELSE max(b.value) FILTER (WHERE b.year = a.year - 1) END AS m, max(b.value) FILTER (WHERE b.year = a.year - 1) AS p
  FROM macro_long a LEFT JOIN macro_long b ON b.country_code = a.country_code AND b.indicator_code = 'GROWTH' AND b.year BETWEEN a.year - 5 AND a.year - 1 WHERE a.indicator_code = 'GROWTH' GROUP BY a.country_code, a.year)
SELECT CASE WHEN year < 2001 THEN 'test' ELSE 'additional' END AS split, count(*) AS n, round(avg(abs(m - v)), 6) + 0.0 AS model_mae, round(avg(abs(p - v)), 6) + 0.0 AS reference_mae,
  round(1 - avg(abs(m - v)) / avg(abs(p - v)), 6) + 0.0 AS improvement FROM c WHERE v IS NOT NULL AND m IS NOT NULL AND p IS NOT NULL GROUP BY ALL""")
def relative_improvement(inp):
    center = panel_op.trailing_median(inp.macro_long, "GROWTH")
    lagged = panel_op.shifted(inp.macro_long.filter("indicator_code = 'GROWTH'"), 1, "previous").drop("indicator_code")
    rows = center.join(lagged, ["country_code", "year"]).dropna(subset=["value", "center", "previous"])
    split = F.when(F.col("year") < 2001, "test").otherwise("additional")
    table = rows.groupBy(split.alias("split")).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("center") - F.col("value"))).alias("model_mae"),
        F.avg(F.abs(F.col("previous") - F.col("value"))).alias("reference_mae"))
    return r(table.withColumn("improvement", 1 - F.col("model_mae") / F.col("reference_mae")),
             ["model_mae", "reference_mae", "improvement"])


@query("latency_quantiles", """
SELECT event_type, q, count(value) AS n, round(CASE WHEN q = 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.95) END, 6) + 0.0 AS quantile
FROM events CROSS JOIN (SELECT unnest([0.5, 0.95]::DOUBLE[]) AS q) GROUP BY event_type, q""")
def latency_quantiles(inp):
    return r(op.order_statistic_quantiles(inp.events, ["event_type"], "value", [0.5, 0.95]), ["quantile"])


@query("metric_slices", """
SELECT CASE WHEN grouping(year, country_code, hs2) = 7 THEN 'overall' WHEN grouping(year) = 0 THEN 'year' WHEN grouping(country_code) = 0 THEN 'country' ELSE 'sector' END AS slice,
  coalesce(CAST(year AS VARCHAR), country_code, hs2, 'all') AS member, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS events,
  round(avg((global_rate - outcome) * (global_rate - outcome)), 6) + 0.0 AS global_brier, round(avg((sector_rate - outcome) * (sector_rate - outcome)), 6) + 0.0 AS sector_brier
FROM sector_scored WHERE outcome IS NOT NULL AND year >= 1999 GROUP BY GROUPING SETS ((), (year), (country_code), (hs2))""")
def metric_slices(inp):
    rows = scored_rows(inp).filter("outcome IS NOT NULL AND year >= 1999")
    year, country, chapter = F.col("year"), F.col("country_code"), F.col("hs2")
    sets = rows.groupingSets([(), (year,), (country,), (chapter,)], year, country, chapter).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("outcome").alias("events"),
        F.avg(F.pow(F.col("global_rate") - F.col("outcome"), 2)).alias("global_brier"),
        F.avg(F.pow(F.col("sector_rate") - F.col("outcome"), 2)).alias("sector_brier"))
    slice_name = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "year").when(F.col("g") == 5, "country").otherwise("sector")
    return r(sets.select(slice_name.alias("slice"), F.coalesce(year.cast("string"), country, chapter, F.lit("all")).alias("member"),
                         "n", "events", "global_brier", "sector_brier"), ["global_brier", "sector_brier"])


@query("cohort_union", """
SELECT year, country_code, hs2, outcome IS NULL AS pending, outcome, round(global_rate, 6) + 0.0 AS global_rate, round(sector_rate, 6) + 0.0 AS sector_rate,
  sector_rate BETWEEN 0 AND 1 AND global_rate BETWEEN 0 AND 1 AS valid, CAST(1 AS BIGINT) AS copies FROM sector_scored WHERE year >= 2001""")
def cohort_union(inp):
    rows = scored_rows(inp).filter("year >= 2001")
    columns = [*feat.KEYS, "outcome", "global_rate", "sector_rate"]
    holdout = rows.filter("outcome IS NOT NULL").select(*columns, F.lit(False).alias("pending"))
    pending = rows.filter("outcome IS NULL").select(*columns, F.lit(True).alias("pending"))
    both = holdout.unionByName(pending)
    copies = both.groupBy(*feat.KEYS).agg(F.count("*").alias("copies"))
    valid = F.col("sector_rate").between(0, 1) & F.col("global_rate").between(0, 1)
    return r(both.join(copies, feat.KEYS).withColumn("valid", valid), ["global_rate", "sector_rate"])


@query("sector_peers", """
WITH l AS (SELECT 'country' AS lens, country_code AS peer_group, * FROM sector_scored UNION ALL SELECT 'industry', hs2, * FROM sector_scored)
SELECT lens, peer_group, year, country_code, hs2, round(lag_export_usd / sum(lag_export_usd) OVER (PARTITION BY lens, year, peer_group), 6) + 0.0 AS covered_share,
  round(100 * (sector_rate - global_rate), 6) + 0.0 AS disagreement_pp, country_code = 'N03' AND hs2 = '10' AS selected FROM l""")
def sector_peers(inp):
    lenses = F.array(F.struct(F.lit("country").alias("lens"), F.col("country_code").alias("peer_group")),
                     F.struct(F.lit("industry").alias("lens"), F.col("hs2").alias("peer_group")))
    rows = scored_rows(inp).withColumn("l", F.explode(lenses)).select("*", "l.*")
    total = F.sum("lag_export_usd").over(Window.partitionBy("lens", "year", "peer_group"))
    return rows.select(
        "lens", "peer_group", *feat.KEYS, rounded(F.col("lag_export_usd") / total, 6).alias("covered_share"),
        rounded(100 * (F.col("sector_rate") - F.col("global_rate")), 6).alias("disagreement_pp"),
        ((F.col("country_code") == "N03") & (F.col("hs2") == "10")).alias("selected"))


UNPIVOT = " UNION ALL ".join(f"SELECT year, country_code, hs2, '{c}' AS feature, round({c}, 9) + 0.0 AS v FROM sector_rows" for c in feat.NUMERIC_FEATURES)


@query("feature_peer_profile", f"""
WITH u AS ({UNPIVOT}), s AS (SELECT year, hs2, feature, median(v) AS m, count(v) AS n, coalesce(max(v) - min(v) < 1e-9, false) AS const FROM u GROUP BY ALL)
SELECT a.year, a.country_code, a.hs2, feature, round(a.v, 6) + 0.0 AS selected_value, round(s.m, 6) + 0.0 AS peer_median, s.n AS n_non_missing, const AS peer_constant,
  CASE WHEN a.v IS NOT NULL THEN round((SELECT count(*) FILTER (WHERE b.v < a.v) + 0.5 * count(*) FILTER (WHERE b.v = a.v) FROM u b WHERE b.year = a.year AND b.hs2 = a.hs2 AND b.feature = a.feature) / s.n, 6) + 0.0 END AS midrank
FROM u a JOIN s USING (year, hs2, feature)""")
def feature_peer_profile(inp):
    # values are compared on a 1e-9 grid: equal features may differ in the last bit after summation
    long = sector_rows(inp).unpivot(feat.KEYS, feat.NUMERIC_FEATURES, "feature", "v").withColumn("v", rounded("v", 9))
    group = ["year", "hs2", "feature"]
    stats = long.groupBy(*group).agg(
        F.percentile("v", 0.5).alias("peer_median"), F.count("v").alias("n_non_missing"),
        F.coalesce(F.max("v") - F.min("v") < 1e-9, F.lit(False)).alias("peer_constant"))
    placed = long.withColumn("midrank", panel_op.midrank("v", group) / 100)
    return r(placed.join(stats, group).withColumnRenamed("v", "selected_value"),
             ["selected_value", "peer_median", "midrank"])
