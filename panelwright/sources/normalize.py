"""Raw source records to long tables: typed, filtered, with the rules of each source.

Every normaliser is a projection and filter chain; missing values stay NULL and rejects are counted, not
silently dropped. Uniqueness of the keys is checked with ``duplicate_keys`` on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import finite, month_number

PANEL_SCHEMA = "countryiso3code string, indicator struct<id: string>, date string, value string"


def panel_records(raw: DataFrame, countries: DataFrame) -> DataFrame:
    """JSON records to the country panel: known countries, digit years, numeric values or NULL."""
    r = raw.select(F.from_json("json", PANEL_SCHEMA).alias("r"))
    rows = r.filter(F.col("r.date").rlike(r"^\d+$")).select(
        F.col("r.countryiso3code").alias("country_code"), F.col("r.date").cast("int").alias("year"),
        F.col("r.indicator.id").alias("indicator_code"), F.col("r.value").try_cast("double").alias("value"),
    )
    return rows.join(countries, "country_code")


TRADE_SCHEMA = (
    "reporterISO string, reporterDesc string, partnerISO string, partnerDesc string, refYear string, flowCode string, "
    "cmdCode string, partnerCode int, partner2Code int, customsCode string, motCode int, primaryValue double"
)


def trade_records(raw: DataFrame) -> DataFrame:
    """Total of all goods between two named economies, all customs procedures and transport modes."""
    r = raw.select(F.from_json("json", TRADE_SCHEMA).alias("r")).select("r.*")
    kept = r.filter(
        (F.col("cmdCode") == "TOTAL") & (F.col("partnerCode") != 0) & (F.col("partner2Code") == 0)
        & (F.col("customsCode") == "C00") & (F.col("motCode") == 0) & F.col("partnerISO").rlike("^[A-Za-z]{3}$")
        & (F.col("primaryValue") >= 0)
    )
    return kept.select(
        F.col("reporterISO").alias("reporter_code"), F.coalesce("reporterDesc", "reporterISO").alias("reporter_name"),
        F.col("partnerISO").alias("partner_code"), F.coalesce("partnerDesc", "partnerISO").alias("partner_name"),
        F.col("refYear").cast("int").alias("year"), F.col("flowCode").alias("flow"),
        F.col("primaryValue").alias("trade_usd"),
    )


def code_of(cell: str):
    """``CODE: label`` cells carry the code before the colon."""
    return F.trim(F.substring_index(cell, ":", 1))


def policy_cells(raw: DataFrame, euro: str = "XM", unit: str = "368") -> tuple[DataFrame, DataFrame]:
    """Monthly policy rates and the counts of what was left out (daily rows, euro aggregate, broken contract)."""
    rows = raw.select(
        code_of("FREQ").alias("freq"), code_of("REF_AREA").alias("area"), code_of("UNIT_MEASURE").alias("unit"),
        code_of("UNIT_MULT").alias("multiplier"), code_of("OBS_STATUS").alias("obs_status"), "TIME_PERIOD",
        F.col("OBS_VALUE").try_cast("double").alias("value"),
    )
    mid = month_number(F.col("TIME_PERIOD"))
    missing = F.col("obs_status") == "M"
    status_fits = (missing & F.col("value").isNull()) | ((F.col("obs_status") == "A") & finite(F.col("value")))
    reason = (
        F.when(F.col("freq") != "M", "not monthly").when(F.col("area") == euro, "euro aggregate")
        .when((F.col("unit") != unit) | (F.col("multiplier") != "0"), "unit or multiplier")
        .when(mid.isNull(), "period").when(~F.coalesce(status_fits, F.lit(False)), "status and value disagree")
    )
    judged = rows.withColumns({"mid": mid, "reason": reason})
    good = judged.filter("reason IS NULL").select(F.col("area").alias("country_code"), "mid", "obs_status", "value")
    return good, judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))


def credit_cells(raw: DataFrame) -> DataFrame:
    """Quarters to quarter-end dates; source codes A, B and C to ratio, trend and gap."""
    year = F.regexp_extract("TIME_PERIOD", r"^(\d{4})-Q([1-4])$", 1).try_cast("int")
    quarter = F.regexp_extract("TIME_PERIOD", r"^(\d{4})-Q([1-4])$", 2).try_cast("int")
    kind = code_of("CG_DTYPE")
    measure = F.when(kind == "A", "ratio").when(kind == "B", "trend").when(kind == "C", "gap")
    return raw.select(
        code_of("BORROWERS_CTY").alias("country_code"), F.last_day(F.make_date(year, quarter * 3, F.lit(1))).alias("date"),
        measure.alias("measure"), F.col("OBS_VALUE").try_cast("double").alias("value"),
    ).filter("date IS NOT NULL AND measure IS NOT NULL")


def index_cells(raw: DataFrame, definitions: DataFrame) -> DataFrame:
    """Broad basket, monthly, positive, with a series definition; the euro area stays an aggregate area."""
    rows = raw.select(
        code_of("FREQ").alias("freq"), code_of("EER_BASKET").alias("basket"), code_of("REF_AREA").alias("area"),
        code_of("EER_TYPE").alias("type"), month_number(F.col("TIME_PERIOD")).alias("mid"),
        F.col("OBS_VALUE").try_cast("double").alias("value"),
    ).filter("freq = 'M' AND basket = 'B' AND value > 0")
    known = definitions.select(code_of("REF_AREA").alias("area"), code_of("EER_TYPE").alias("type"))
    euro = F.col("area") == "XM"
    return rows.join(known, ["area", "type"], "left_semi").select(
        F.when(euro, "XEA").otherwise(F.col("area")).alias("country_code"), "mid",
        F.when(F.col("type") == "N", "nominal").otherwise("real").alias("measure"), "value",
        F.when(euro, "aggregate").otherwise("economy").alias("area_type"),
    )


def forecast_maps(raw: DataFrame, years: list[int], vintage: str, unit: str) -> DataFrame:
    """Nested maps to a dense indicator x country x year grid of one vintage; countries without values go."""
    nested = "vintage string, unit string, values map<string, map<string, map<string, string>>>"
    right = raw.select(F.from_json("json", nested).alias("r")).filter(
        (F.col("r.vintage") == vintage) & (F.col("r.unit") == unit)
    )
    by_country = right.select(F.explode("r.values").alias("indicator_code", "countries")).select(
        "indicator_code", F.explode("countries").alias("country_code", "years")
    )
    grid = by_country.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    cells = grid.withColumn("value", F.try_element_at("years", F.col("year").cast("string")).try_cast("double"))
    any_value = cells.filter("value IS NOT NULL").select("country_code").distinct()
    return cells.select("indicator_code", "country_code", "year", "value").join(any_value, "country_code", "left_semi")


SERIES_SCHEMA = "seriesID string, data array<struct<year: string, period: string, value: string, footnotes: array<struct<code: string, text: string>>>>"


def series_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations without annual averages, and the footnotes; a dash needs a footnote to count as missing."""
    points = raw.select(F.from_json("json", SERIES_SCHEMA).alias("r")).select(
        F.col("r.seriesID").alias("key"), F.explode("r.data").alias("d")
    ).filter("d.period <> 'M13'")
    mid = F.col("d.year").cast("int") * 12 + F.substring("d.period", 2, 2).cast("int") - 1
    noted = F.coalesce(F.size("d.footnotes"), F.lit(0)) > 0
    dash = F.col("d.value") == "-"
    rows = points.select(
        "key", mid.alias("mid"), F.col("d.value").try_cast("double").alias("value"),
        F.when(dash & ~noted, "dash without footnote").when(dash, "missing").otherwise("observed").alias("status"),
    )
    notes = points.select("key", mid.alias("mid"), F.posexplode("d.footnotes").alias("position", "n")).select(
        "key", "mid", "position", "n.code", "n.text"
    )
    return rows, notes


def yearly_lines(raw: DataFrame) -> DataFrame:
    """``KEY YEAR v1 .. v12`` lines to monthly rows; only the last year of a key may be short."""
    cells = raw.select(F.split(F.trim("line"), r"\s+").alias("c")).filter(F.size("c") > 2).select(
        F.get("c", F.lit(0)).alias("key"), F.get("c", F.lit(1)).cast("int").alias("year"), (F.size("c") - 2).alias("n"),
        F.posexplode(F.slice("c", 3, 12)).alias("month", "text"),
    )
    last = F.max("year").over(Window.partitionBy("key"))
    return cells.withColumn("_last", last).filter((F.col("n") == 12) | (F.col("year") == F.col("_last"))).select(
        "key", (F.col("year") * 12 + F.col("month")).alias("mid"), F.col("text").try_cast("double").alias("value")
    )


def wide_columns(raw: DataFrame, metadata: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """Melt the columns whose metadata states the expected unit, multiplier and identity."""
    long = raw.unpivot([index], columns, "column", "text")
    right = metadata.filter("unit = 'Percent' AND multiplier = '1' AND identity = concat('SRC/', column)").select("column")
    return long.join(right, "column", "left_semi").select(
        F.col("column").alias("key"), index, F.col("text").try_cast("double").alias("value")
    )


PAYLOAD_SCHEMA = "month string, export double, import double, total double, balance double"


def trade_payload(raw: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Month rows to four series with the accounting identities checked per month."""
    r = raw.select(F.from_json("json", PAYLOAD_SCHEMA).alias("r")).select("r.*")
    fits = (F.abs(F.col("total") - (F.col("export") + F.col("import"))) <= tolerance) & (
        F.abs(F.col("balance") - (F.col("export") - F.col("import"))) <= tolerance
    )
    return r.withColumn("reconciled", fits).unpivot(
        ["month", "reconciled"], ["export", "import", "total", "balance"], "series", "value"
    )
