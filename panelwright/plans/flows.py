from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import flows as op
from panelwright.operators import intervals
from panelwright.plans.registry import query
from panelwright.sources import flow_files

EDGE_KEYS = ["year", "country_code", "hs2"]


def edges(inp):
    return op.sector_partner_edges(inp.flows_raw, inp.country_dim)


@query("scan_flows_typed", """
SELECT t AS year, count(*) AS rows, round(sum(v), 4) + 0.0 AS total, count(DISTINCT k) AS products,
       CAST(min(length(k)) AS INT) AS shortest, count(q) AS quantities
FROM flows_raw GROUP BY t""")
def scan_flows_typed(inp):
    path = flow_files.fresh_path(inp.spark, "flow-archive")
    flow_files.write_flow_archive(inp.flows_raw, path)
    return flow_files.read_flow_archive(inp.spark, path).groupBy(F.col("t").alias("year")).agg(
        F.count("*").alias("rows"), rounded(F.sum("v"), 4).alias("total"), F.countDistinct("k").alias("products"),
        F.min(F.length("k")).alias("shortest"), F.count("q").alias("quantities"),
    )


@query("country_dim", "SELECT numeric_code, iso3, name FROM country_dim")
def country_dim(inp):
    return op.country_dimension(inp.nation, inp.region)


@query("write_partitioned_edges")
def write_partitioned_edges(inp):
    raw = inp.flows_raw.groupBy(F.col("t").alias("year")).agg((F.sum("v") * 1000).alias("raw_usd"))
    return flow_files.write_edges(edges(inp), flow_files.fresh_path(inp.spark, "edges"), raw).select(
        "year", "rows", rounded("total_usd", 2).alias("total_usd"), rounded("excluded_usd", 2).alias("excluded_usd"),
        "fingerprint",
    )


@query("flow_star_join", """
SELECT t AS year, e.iso3 AS exporter_code, e.name AS exporter_name, m.iso3 AS importer_code, m.name AS importer_name,
       k, round(v, 7) + 0.0 AS v, q
FROM flows_raw JOIN country_dim e ON i = e.numeric_code JOIN country_dim m ON j = m.numeric_code""")
def flow_star_join(inp):
    return op.star_join(inp.flows_raw, inp.country_dim).select(
        F.col("t").alias("year"), "exporter_code", "exporter_name", "importer_code", "importer_name", "k",
        rounded("v", 7).alias("v"), "q",
    )


@query("unmapped_flows", """
WITH known AS (SELECT * FROM country_dim WHERE income_level <> 'Low')
SELECT t, i, j, count(*) AS rows, max(e.iso3) IS NULL AS exporter_missing, max(m.iso3) IS NULL AS importer_missing
FROM flows_raw LEFT JOIN known e ON i = e.numeric_code LEFT JOIN known m ON j = m.numeric_code
WHERE e.iso3 IS NULL OR m.iso3 IS NULL GROUP BY t, i, j""")
def unmapped_flows(inp):
    known = inp.country_dim.filter("income_level <> 'Low'")
    return op.unmapped(inp.flows_raw, known)


@query("bilateral_totals", """
SELECT t AS year, e.iso3 AS exporter_code, e.name AS exporter_name, m.iso3 AS importer_code, m.name AS importer_name,
       round(sum(v) * 1000, 4) + 0.0 AS trade_usd
FROM flows_raw JOIN country_dim e ON i = e.numeric_code JOIN country_dim m ON j = m.numeric_code GROUP BY ALL""")
def bilateral_totals(inp):
    return op.bilateral_totals(inp.flows_raw, inp.country_dim).withColumn("trade_usd", rounded("trade_usd", 4))


@query("chapter_totals", """
SELECT t AS year, e.iso3 AS reporter_code, e.name AS reporter_name, 'X' AS flow, left(k, 2) AS hs2,
       round(sum(v) * 1000, 4) + 0.0 AS trade_usd
FROM flows_raw JOIN country_dim e ON i = e.numeric_code GROUP BY ALL
UNION ALL
SELECT t, e.iso3, e.name, 'M', left(k, 2), round(sum(v) * 1000, 4) + 0.0
FROM flows_raw JOIN country_dim e ON j = e.numeric_code GROUP BY ALL""")
def chapter_totals(inp):
    return op.chapter_totals(inp.flows_raw, inp.country_dim).withColumn("trade_usd", rounded("trade_usd", 4))


@query("sector_partner_edges", """
SELECT year, country_code, partner_code, hs2, round(trade_usd, 4) + 0.0 AS trade_usd FROM flow_edges""")
def sector_partner_edges(inp):
    return edges(inp).withColumn("trade_usd", rounded("trade_usd", 4))


@query("flow_audit", """
SELECT t AS year, count(*) AS rows, round(sum(v), 4) + 0.0 AS total_thousand_usd,
       count(*) FILTER (WHERE t IS NULL OR v IS NULL OR NOT isfinite(v) OR v < 0
                        OR NOT regexp_full_match(k, '[0-9]{6}')) AS invalid_rows,
       count(*) FILTER (WHERE e.iso3 IS NULL OR m.iso3 IS NULL) AS unmapped_rows,
       count(*) FILTER (WHERE q IS NULL) AS missing_quantity_rows
FROM flows_raw LEFT JOIN country_dim e ON i = e.numeric_code LEFT JOIN country_dim m ON j = m.numeric_code GROUP BY t""")
def flow_audit(inp):
    return op.flow_audit(inp.flows_raw, inp.country_dim).withColumn(
        "total_thousand_usd", rounded("total_thousand_usd", 4)
    )


@query("totals_reconcile", """
WITH raw AS (SELECT t, sum(v) * 1000 AS raw FROM flows_raw GROUP BY t),
p AS (SELECT t, sum(x) AS x FROM (SELECT t, i, j, sum(v) * 1000 AS x FROM flows_raw GROUP BY t, i, j) GROUP BY t),
c AS (SELECT t, sum(x) AS x FROM (SELECT t, i, left(k, 2) AS h, sum(v) * 1000 AS x FROM flows_raw GROUP BY ALL
      UNION ALL SELECT t, j, left(k, 2), sum(v) * 1000 FROM flows_raw GROUP BY ALL) GROUP BY t)
SELECT raw.t AS year, round(raw, 4) + 0.0 AS raw, abs(p.x - raw) <= greatest(1.0, raw * 1e-9) AS pairs_ok,
       abs(c.x - 2 * raw) <= greatest(1.0, 2 * raw * 1e-9) AS chapters_ok
FROM raw JOIN p ON raw.t = p.t JOIN c ON raw.t = c.t""")
def totals_reconcile(inp):
    return op.totals_reconcile(inp.flows_raw, inp.country_dim).withColumn("raw", rounded("raw", 4))


@query("mirror_flows", """
WITH p AS (SELECT t AS year, e.iso3 AS ec, e.name AS en, m.iso3 AS mc, m.name AS mn, round(sum(v) * 1000, 4) + 0.0 AS x
  FROM flows_raw JOIN country_dim e ON i = e.numeric_code JOIN country_dim m ON j = m.numeric_code GROUP BY ALL)
SELECT year, ec AS reporter_code, en AS reporter_name, mc AS partner_code, mn AS partner_name, 'X' AS flow, x AS trade_usd FROM p
UNION ALL SELECT year, mc, mn, ec, en, 'M', x FROM p""")
def mirror_flows(inp):
    pairs = op.bilateral_totals(inp.flows_raw, inp.country_dim)
    return op.mirror_flows(pairs).withColumn("trade_usd", rounded("trade_usd", 4))


@query("trade_balance_by_year", """
WITH x AS (SELECT t, i AS c, sum(v) * 1000 AS x FROM flows_raw GROUP BY ALL),
m AS (SELECT t, j AS c, sum(v) * 1000 AS m FROM flows_raw GROUP BY ALL),
b AS (SELECT coalesce(x.t, m.t) AS t, coalesce(x.c, m.c) AS c, coalesce(x, 0) AS x, coalesce(m, 0) AS m
      FROM x FULL JOIN m ON x.t = m.t AND x.c = m.c)
SELECT t AS year, iso3 AS reporter_code, round(x, 4) + 0.0 AS exports_usd, round(m, 4) + 0.0 AS imports_usd,
       round(x - m, 4) + 0.0 AS balance_usd FROM b JOIN country_dim ON c = numeric_code""")
def trade_balance_by_year(inp):
    chapters = op.chapter_totals(inp.flows_raw, inp.country_dim)
    frame = op.trade_balance(chapters)
    return frame.select("year", "reporter_code",
                        *[rounded(c, 4).alias(c) for c in ("exports_usd", "imports_usd", "balance_usd")])


@query("concentration", """
WITH s AS (SELECT *, trade_usd / sum(trade_usd) OVER w AS share FROM flow_edges WHERE trade_usd > 0
           WINDOW w AS (PARTITION BY year, country_code, hs2)),
r AS (SELECT *, row_number() OVER (PARTITION BY year, country_code, hs2 ORDER BY share DESC, partner_code) AS n FROM s)
SELECT year, country_code, hs2, round(sum(trade_usd), 4) + 0.0 AS export_usd, round(sum(share * share), 6) + 0.0 AS hhi,
       round(1 / sum(share * share), 6) + 0.0 AS effective_partners, round(max(share), 6) + 0.0 AS top1_share,
       round(sum(share) FILTER (WHERE n <= 5), 6) + 0.0 AS top5_share, count(*) AS partner_count
FROM r GROUP BY year, country_code, hs2""")
def concentration(inp):
    frame = op.concentration(edges(inp), EDGE_KEYS)
    return frame.select(
        *EDGE_KEYS, rounded("export_usd", 4).alias("export_usd"),
        *[rounded(c, 6).alias(c) for c in ("hhi", "effective_partners", "top1_share", "top5_share")], "partner_count",
    )


@query("revealed_advantage", """
WITH c AS (SELECT t AS year, i, left(k, 2) AS hs2, sum(v) * 1000 AS x FROM flows_raw GROUP BY ALL),
s AS (SELECT *, x / sum(x) OVER (PARTITION BY year, i) AS o,
             sum(x) OVER (PARTITION BY year, hs2) / sum(x) OVER (PARTITION BY year) AS w FROM c)
SELECT year, iso3 AS reporter_code, hs2, round(x, 4) + 0.0 AS trade_usd, round(o, 6) + 0.0 AS own_share,
       round(w, 6) + 0.0 AS world_share, round(o / nullif(w, 0), 6) + 0.0 AS rca
FROM s JOIN country_dim ON i = numeric_code""")
def revealed_advantage(inp):
    frame = op.revealed_advantage(op.chapter_totals(inp.flows_raw, inp.country_dim))
    return frame.select("year", "reporter_code", "hs2", rounded("trade_usd", 4).alias("trade_usd"),
                        *[rounded(c, 6).alias(c) for c in ("own_share", "world_share", "rca")])


@query("partner_shares", """
WITH p AS (SELECT t AS year, i AS r, j AS p, 'X' AS flow, sum(v) * 1000 AS x FROM flows_raw GROUP BY ALL
  UNION ALL SELECT t, j, i, 'M', sum(v) * 1000 FROM flows_raw GROUP BY ALL)
SELECT year, a.iso3 AS reporter_code, b.iso3 AS partner_code, flow, round(x, 4) + 0.0 AS trade_usd,
       round(CASE WHEN sum(x) OVER w > 0 THEN x / sum(x) OVER w ELSE 0 END, 6) + 0.0 AS share
FROM p JOIN country_dim a ON r = a.numeric_code JOIN country_dim b ON p.p = b.numeric_code
WINDOW w AS (PARTITION BY year, r, flow)""")
def partner_shares(inp):
    flows = op.mirror_flows(op.bilateral_totals(inp.flows_raw, inp.country_dim))
    return op.shares(flows, ["year", "reporter_code", "flow"]).select(
        "year", "reporter_code", "partner_code", "flow", rounded("trade_usd", 4).alias("trade_usd"),
        rounded("share", 6).alias("share"),
    )


@query("top5_share", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY year, country_code, hs2 ORDER BY trade_usd DESC, partner_code) AS n,
  trade_usd / sum(trade_usd) OVER (PARTITION BY year, country_code, hs2) AS s FROM flow_edges)
SELECT year, country_code, hs2, round(sum(s), 6) + 0.0 AS top5_share FROM r WHERE n <= 5 GROUP BY ALL""")
def top5_share(inp):
    return op.concentration(edges(inp), EDGE_KEYS).select(*EDGE_KEYS, rounded("top5_share", 6).alias("top5_share"))


@query("top_partners", """
WITH p AS (SELECT t AS year, i AS r, j AS p, 'X' AS flow, sum(v) * 1000 AS x FROM flows_raw GROUP BY ALL
  UNION ALL SELECT t, j, i, 'M', sum(v) * 1000 FROM flows_raw GROUP BY ALL),
n AS (SELECT year, a.iso3 AS reporter_code, b.iso3 AS pc, flow, x, x / sum(x) OVER (PARTITION BY year, r, flow) AS s,
  row_number() OVER (PARTITION BY year, r, flow ORDER BY x DESC, b.iso3) AS n
  FROM p JOIN country_dim a ON r = a.numeric_code JOIN country_dim b ON p.p = b.numeric_code)
SELECT year, reporter_code, flow, CAST(CASE WHEN n <= 10 THEN n ELSE 11 END AS INT) AS place,
  CASE WHEN n <= 10 THEN pc ELSE 'OTHER' END AS partner_code, round(sum(x), 4) + 0.0 AS trade_usd,
  round(sum(s), 6) + 0.0 AS share, count(*) AS partners
FROM n GROUP BY ALL""")
def top_partners(inp):
    flows = op.mirror_flows(op.bilateral_totals(inp.flows_raw, inp.country_dim))
    frame = op.top_partners(flows, ["year", "reporter_code", "flow"], 10)
    return frame.withColumns({"trade_usd": rounded("trade_usd", 4), "share": rounded("share", 6)})


SECTION_CASES = " ".join(f"WHEN CAST(hs2 AS INT) BETWEEN {first} AND {last} THEN '{name}'" for first, last, name in op.SECTIONS)


@query("range_lookup", f"""
SELECT year, hs2, CASE {SECTION_CASES} END AS section, round(sum(trade_usd), 4) + 0.0 AS trade_usd FROM flow_edges GROUP BY ALL""")
def range_lookup(inp):
    totals = edges(inp).groupBy("year", "hs2").agg(rounded(F.sum("trade_usd"), 4).alias("trade_usd"))
    return op.range_lookup(totals, op.section_names(inp.spark))


@query("interval_totals", """
WITH d AS (SELECT l_suppkey AS s, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT s_suppkey AS s, k, 8000 + 37 * (s_suppkey % 50) + 11 * k AS low, 8000 + 37 * (s_suppkey % 50) + 11 * k + 60 * k * k - 1 AS high FROM supplier, (SELECT unnest(range(0, 8)) AS k))
SELECT r.s AS supplier, CAST(k AS INT) AS span, CAST(sum(n) AS BIGINT) AS rows, CAST(min(day) AS INT) AS first_day, CAST(max(day) AS INT) AS last_day
FROM r JOIN d ON d.s = r.s AND day BETWEEN low AND high GROUP BY ALL""")
def interval_totals(inp):
    """Shipments of a supplier within overlapping spans of a few days to several years (the first span is empty)."""
    days = inp.lineitem.groupBy(F.col("l_suppkey").alias("supplier"), F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).agg(F.count("*").alias("n"))
    start = 8000 + 37 * (F.col("s_suppkey") % 50) + 11 * F.col("span")
    spans = inp.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("span")).select(
        F.col("s_suppkey").alias("supplier"), "span", start.alias("low"), (start + 60 * F.col("span") * F.col("span") - 1).alias("high"))
    joined = intervals.interval_join(days, spans, "day", "low", "high", ("supplier",))
    return joined.groupBy("supplier", "span").agg(F.sum("n").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("chapter_lookup", """
WITH names AS (SELECT DISTINCT lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') AS h, p_brand AS n FROM part
               WHERE p_brand <> 'Brand#7'),
t AS (SELECT year, hs2, round(sum(trade_usd), 4) + 0.0 AS trade_usd FROM flow_edges GROUP BY ALL)
SELECT year, hs2, trade_usd, coalesce(n, 'Unnamed chapter') AS chapter_name FROM t LEFT JOIN names ON hs2 = h""")
def chapter_lookup(inp):
    names = inp.part.filter("p_brand <> 'Brand#7'").select(
        F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0").alias("hs2"), F.col("p_brand").alias("chapter_name")
    ).distinct()
    totals = edges(inp).groupBy("year", "hs2").agg(rounded(F.sum("trade_usd"), 4).alias("trade_usd"))
    return op.chapter_lookup(totals, names)


@query("reported_semi", """
WITH s AS (SELECT DISTINCT year, country_code, hs2 FROM flow_edges)
SELECT a.year + 1 AS year, a.country_code, a.hs2 FROM s a
WHERE EXISTS (SELECT 1 FROM s b WHERE b.year = a.year + 1 AND b.country_code = a.country_code)""")
def reported_semi(inp):
    sectors = edges(inp).select(*EDGE_KEYS).distinct()
    return op.reported(sectors.withColumn("year", F.col("year") + 1), sectors)
