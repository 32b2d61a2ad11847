from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, rounded
from panelwright.operators import financial
from panelwright.operators import flows as flow_op
from panelwright.plans.registry import query
from panelwright.sources import normalize as op


def json_of(frame, **fields):
    return frame.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json"))


@query("normalize_panel_records", """
SELECT country_code, country_name, region, income_level, year, indicator_code, round(value, 6) + 0.0 AS value FROM macro_long""")
def normalize_panel_records(inp):
    macro = inp.macro_long
    text = F.coalesce(F.col("value").cast("string"), F.lit("n/a"))
    indicator = F.struct(F.col("indicator_code").alias("id"))
    known = json_of(macro, countryiso3code=F.col("country_code"), indicator=indicator, date=F.col("year").cast("string"), value=text)
    world = json_of(macro, countryiso3code=F.lit("WLD"), indicator=indicator, date=F.col("year").cast("string"), value=text)
    undated = json_of(macro, countryiso3code=F.col("country_code"), indicator=indicator,
                      date=F.concat(F.col("year").cast("string"), F.lit("Q1")), value=text)
    countries = inp.country_dim.select(
        F.col("iso3").alias("country_code"), F.col("name").alias("country_name"), "region", "income_level")
    return op.panel_records(known.unionByName(world).unionByName(undated), countries).withColumn(
        "value", rounded("value", 6))


@query("normalize_trade_records", """
SELECT translate(a.iso3, '0123456789', 'ABCDEFGHIJ') AS reporter_code, a.name AS reporter_name, translate(b.iso3, '0123456789', 'ABCDEFGHIJ') AS partner_code,
  CASE WHEN j % 4 = 0 THEN translate(b.iso3, '0123456789', 'ABCDEFGHIJ') ELSE b.name END AS partner_name, t AS year, 'X' AS flow, round(sum(v) * 1000, 4) + 0.0 AS trade_usd
FROM flows_raw JOIN country_dim a ON i = a.numeric_code JOIN country_dim b ON j = b.numeric_code WHERE j <> 0 AND i % 6 <> 5 GROUP BY ALL""")
def normalize_trade_records(inp):
    pairs = inp.flows_raw.groupBy("t", "i", "j").agg((F.sum("v") * 1000).alias("usd"))
    named = flow_op.star_join(pairs, inp.country_dim)

    def letters(name):
        return F.translate(name, "0123456789", "ABCDEFGHIJ")

    def records(frame, **override):
        fields = {
            "reporterISO": letters("exporter_code"), "reporterDesc": F.col("exporter_name"),
            "partnerISO": letters("importer_code"), "partnerDesc": F.when(F.col("j") % 4 != 0, F.col("importer_name")),
            "refYear": F.col("t").cast("string"), "flowCode": F.lit("X"), "cmdCode": F.lit("TOTAL"), "partnerCode": F.col("j"),
            "partner2Code": F.lit(0), "customsCode": F.when(F.col("i") % 6 == 5, "C01").otherwise("C00"), "motCode": F.lit(0),
            "primaryValue": F.col("usd"), **override,
        }
        return json_of(frame, **fields)

    raw = records(named)
    for override in ({"cmdCode": F.lit("27")}, {"partnerISO": F.lit("_X ")}, {"primaryValue": -F.col("usd")},
                     {"motCode": F.lit(1000)}, {"partner2Code": F.lit(4)}):
        raw = raw.unionByName(records(named, **override))
    return op.trade_records(raw).withColumn("trade_usd", rounded("trade_usd", 4))


def cell(code, label):
    return F.concat(code, F.lit(": "), F.lit(label))


@query("normalize_policy_series", """
SELECT country_code, mid, obs_status, value, CAST(NULL AS BIGINT) AS excluded FROM policy_series WHERE country_code <> 'N09'
UNION ALL SELECT 'not monthly', NULL, NULL, NULL, count(*) FROM policy_series UNION ALL SELECT 'euro aggregate', NULL, NULL, NULL, count(*) FROM policy_series WHERE country_code = 'N03'
UNION ALL SELECT 'unit or multiplier', NULL, NULL, NULL, count(*) FROM policy_series WHERE country_code = 'N09' UNION ALL SELECT 'status and value disagree', NULL, NULL, NULL, count(*) FROM policy_series WHERE country_code = 'N04' AND obs_status = 'A'""")
def normalize_policy_series(inp):
    rows = inp.policy_series

    def cells(frame, freq="M", area=None, status=None):
        return frame.select(
            cell(F.lit(freq), "frequency").alias("FREQ"), cell(area if area is not None else F.col("country_code"), "area").alias("REF_AREA"),
            cell(F.when(F.col("country_code") == "N09", "100").otherwise("368"), "unit").alias("UNIT_MEASURE"),
            F.lit("0: Units").alias("UNIT_MULT"), cell(status if status is not None else F.col("obs_status"), "status").alias("OBS_STATUS"),
            month_label(F.col("mid")).alias("TIME_PERIOD"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("OBS_VALUE"))

    raw = cells(rows).unionByName(cells(rows, freq="D")).unionByName(
        cells(rows.filter("country_code = 'N03'"), area=F.lit("XM"))).unionByName(
        cells(rows.filter("country_code = 'N04' AND obs_status = 'A'"), status=F.lit("M")))
    good, rejected = op.policy_cells(raw)
    return good.withColumn("excluded", F.lit(None).cast("bigint")).unionByName(
        rejected.select(F.col("reason").alias("country_code"), F.col("rows").alias("excluded")), allowMissingColumns=True)


@query("normalize_credit_series", """
SELECT 'N' || lpad(CAST(nk AS VARCHAR), 2, '0') AS country_code, CAST(CAST(last_day(make_date(qid // 4, (qid % 4 + 1) * 3, 1)) AS DATE) AS VARCHAR) AS date, measure, round(value, 8) + 0.0 AS value FROM credit_series""")
def normalize_credit_series(inp):
    kind = F.when(F.col("measure") == "ratio", "A").when(F.col("measure") == "trend", "B").otherwise("C")
    raw = inp.credit_series.select(
        cell(F.concat(F.lit("N"), F.lpad(F.col("nk").cast("string"), 2, "0")), "area").alias("BORROWERS_CTY"),
        cell(kind, "type").alias("CG_DTYPE"), F.col("value").cast("string").alias("OBS_VALUE"),
        F.concat(F.floor(F.col("qid") / 4).cast("string"), F.lit("-Q"), (F.col("qid") % 4 + 1).cast("string")).alias("TIME_PERIOD"))
    odd = raw.withColumn("TIME_PERIOD", F.substring("TIME_PERIOD", 1, 4))  # annual rows are not quarters
    frame = op.credit_cells(raw.unionByName(odd))
    return frame.withColumns({"date": F.col("date").cast("string"), "value": rounded("value", 8)})


@query("normalize_index_series", """
SELECT CASE country_code WHEN 'N07' THEN 'XEA' ELSE country_code END AS country_code, mid, measure, round(value, 10) + 0.0 AS value, CASE country_code WHEN 'N07' THEN 'aggregate' ELSE 'economy' END AS area_type
FROM (SELECT country_code, mid, 'nominal' AS measure, nominal AS value FROM index_series UNION ALL SELECT country_code, mid, 'real', real_value FROM index_series)
WHERE NOT (CAST(substr(country_code, 2) AS INT) % 4 = 3 AND measure = 'real') AND NOT mid % 15 = 0""")
def normalize_index_series(inp):
    long = financial.index_long(inp.index_series)
    area = F.when(F.col("country_code") == "N07", "XM").otherwise(F.col("country_code"))
    kind = F.when(F.col("measure") == "nominal", "N").otherwise("R")

    def cells(frame, freq="M", basket="B"):
        value = F.when(F.col("mid") % 15 == 0, -F.col("value")).otherwise(F.col("value"))
        return frame.select(cell(F.lit(freq), "f").alias("FREQ"), cell(F.lit(basket), "b").alias("EER_BASKET"), cell(area, "a").alias("REF_AREA"),
                            cell(kind, "t").alias("EER_TYPE"), month_label(F.col("mid")).alias("TIME_PERIOD"), value.cast("string").alias("OBS_VALUE"))

    number = F.substring("country_code", 2, 2).cast("int")
    definitions = cells(long.filter(~((number % 4 == 3) & (F.col("measure") != "nominal")))).select("REF_AREA", "EER_TYPE").distinct()
    raw = cells(long).unionByName(cells(long, basket="N")).unionByName(cells(long, freq="D"))
    return op.index_cells(raw, definitions).withColumn("value", rounded("value", 10))


@query("explode_forecast_maps", """
SELECT i.indicator_code, c.country_code, CAST(y.year AS INT) AS year, round(m.value, 6) + 0.0 AS value FROM (SELECT unnest(['GROWTH', 'PRICES', 'BALANCE']) AS indicator_code) i
CROSS JOIN (SELECT DISTINCT country_code FROM macro_long WHERE country_code <> 'N11') c CROSS JOIN (SELECT unnest(generate_series(1996, 2003)) AS year) y
LEFT JOIN macro_long m ON m.indicator_code = i.indicator_code AND m.country_code = c.country_code AND m.year = y.year AND m.year >= 1996""")
def explode_forecast_maps(inp):
    rows = inp.macro_long.filter("indicator_code IN ('GROWTH', 'PRICES', 'BALANCE')")
    text = F.when(F.col("country_code") == "N11", "n/a").otherwise(F.coalesce(F.col("value").cast("string"), F.lit("")))
    # one small map per indicator and country, as the source delivers them
    by_country = rows.groupBy("indicator_code", "country_code").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), text))).alias("years"))
    values = F.create_map("indicator_code", F.create_map("country_code", "years"))
    raw = json_of(by_country, vintage=F.lit("2001-04"), unit=F.lit("%"), values=values)
    old = json_of(by_country, vintage=F.lit("2000-10"), unit=F.lit("%"), values=values)
    return op.forecast_maps(raw.unionByName(old), list(range(1996, 2004)), "2001-04", "%").withColumn("value", rounded("value", 6))


@query("explode_series_json", """
SELECT key, mid, CASE WHEN mid % 9 = 0 OR mid % 25 = 0 THEN NULL ELSE value END AS value, CASE WHEN mid % 9 = 0 THEN 'missing' WHEN mid % 25 = 0 THEN 'dash without footnote' ELSE 'observed' END AS status,
  CASE WHEN mid % 9 = 0 THEN 1 ELSE 0 END::BIGINT AS footnotes FROM monthly_obs""")
def explode_series_json(inp):
    mid = F.col("mid")
    noted = mid % 9 == 0
    text = F.when(noted | (mid % 25 == 0), "-").otherwise(F.col("value").cast("string"))
    notes = F.when(noted, F.array(F.struct(F.lit("X").alias("code"), F.lit("not available").alias("text"))))
    point = F.struct(F.substring("period", 1, 4).alias("year"), F.concat(F.lit("M"), F.substring("period", 6, 2)).alias("period"),
                     text.alias("value"), notes.alias("footnotes"))
    annual = F.struct(F.substring("period", 1, 4).alias("year"), F.lit("M13").alias("period"), F.lit("1").alias("value"),
                      F.lit(None).cast("array<struct<code: string, text: string>>").alias("footnotes"))
    points = inp.monthly_obs.select("key", point.alias("d")).unionByName(
        inp.monthly_obs.filter("mid % 12 = 11").select("key", annual.alias("d")))
    raw = json_of(points.groupBy("key").agg(F.collect_list("d").alias("data")), seriesID=F.col("key"), data=F.col("data"))
    rows, footnotes = op.series_json(raw)
    counts = footnotes.groupBy("key", "mid").agg(F.count("*").alias("footnotes"))
    return rows.join(counts, ["key", "mid"], "left").withColumn("footnotes", F.coalesce("footnotes", F.lit(0)))


@query("wide_rows_to_monthly", """
WITH g AS (SELECT k.key, y.y, CAST(unnest(generate_series(y.y * 12, least(y.y * 12 + 11, (SELECT max(mid) FROM monthly_obs m WHERE m.key = k.key)))) AS INT) AS mid
  FROM (SELECT DISTINCT key FROM monthly_obs) k CROSS JOIN (SELECT CAST(unnest(generate_series(1995, 2001)) AS INT) AS y) y)
SELECT g.key, g.mid, m.value FROM g LEFT JOIN monthly_obs m ON m.key = g.key AND m.mid = g.mid""")
def wide_rows_to_monthly(inp):
    rows = inp.monthly_obs.select("key", F.floor(F.col("mid") / 12).cast("int").alias("year"), (F.col("mid") % 12).alias("month"), "value")
    years = rows.groupBy("key", "year").pivot("month", list(range(12))).agg(F.max("value"))
    last = inp.monthly_obs.groupBy("key").agg(F.max("mid").alias("last"))
    cells = [F.when(F.col("year") * 12 + m <= F.col("last"), F.coalesce(F.col(str(m)).cast("string"), F.lit("."))) for m in range(12)]
    lines = years.join(last, "key").select(F.concat_ws("  ", "key", F.col("year").cast("string"), *cells).alias("line"))
    return op.yearly_lines(lines)


@query("wide_columns_to_long", """
SELECT k.key, s.mid, m.value FROM (SELECT DISTINCT mid FROM monthly_obs) s CROSS JOIN (SELECT unnest(['p1', 'p2', 'p4']) AS key) k LEFT JOIN monthly_obs m ON m.key = k.key AND m.mid = s.mid""")
def wide_columns_to_long(inp):
    keys = ["p1", "p2", "p3", "p4", "p5"]
    wide = inp.monthly_obs.groupBy("mid").pivot("key", keys).agg(F.max("value"))
    text = wide.select("mid", *[F.coalesce(F.col(k).cast("string"), F.lit("ND")).alias(k) for k in keys])
    metadata = inp.spark.createDataFrame(
        [("p1", "Percent", "1", "SRC/p1"), ("p2", "Percent", "1", "SRC/p2"), ("p3", "Index", "1", "SRC/p3"),
         ("p4", "Percent", "1", "SRC/p4"), ("p5", "Percent", "1", "SRC/other")],
        "column string, unit string, multiplier string, identity string")
    return op.wide_columns(text, metadata, "mid", keys)


PAY = """pay AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '-' || lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') AS month,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE s_nationkey < 12) AS BIGINT) AS x, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE s_nationkey >= 12) AS BIGINT) AS m
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
pr AS (SELECT month, floor(x / 10000000) / 10 AS x, floor(m / 10000000) / 10 AS m, floor((x + m) / 10000000) / 10 AS t, floor((x - m) / 10000000) / 10 AS b FROM pay)"""


@query("melt_trade_payload", f"""
WITH {PAY}, r AS (SELECT *, abs(t - (x + m)) <= 0.06 AND abs(b - (x - m)) <= 0.06 AS ok FROM pr)
SELECT month, ok AS reconciled, 'export' AS series, x AS value FROM r UNION ALL SELECT month, ok, 'import', m FROM r UNION ALL SELECT month, ok, 'total', t FROM r UNION ALL SELECT month, ok, 'balance', b FROM r""")
def melt_trade_payload(inp):
    home = F.col("s_nationkey") < 12
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rows = inp.lineitem.join(inp.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.sum(F.when(home, cents)).alias("x"), F.sum(F.when(~home, cents)).alias("m"))

    def shown(value):
        return F.floor(value / 10000000) / 10

    raw = json_of(rows, month=F.col("month"), export=shown(F.col("x")), **{"import": shown(F.col("m"))},
                  total=shown(F.col("x") + F.col("m")), balance=shown(F.col("x") - F.col("m")))
    return op.trade_payload(raw)
