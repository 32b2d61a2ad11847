"""Bilateral goods flows: star join to the code dimension, reconciled totals, shares and concentration.

Raw flows are always reduced by their integer keys first (map-side partial aggregation copes with a hot
exporter or chapter) and only the reduced rows meet the code dimension and the share windows, so a window
partition never holds more rows than there are partners or chapters in the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import finite, ratio

# Chapter ranges of the 21 sections (first, last, name).
SECTIONS = (
    (1, 5, "动物及动物产品"), (6, 14, "植物产品"), (15, 15, "动植物油脂"), (16, 24, "食品饮料与烟草"), (25, 27, "矿物产品"),
    (28, 38, "化工产品"), (39, 40, "塑料与橡胶"), (41, 43, "皮革与毛皮"), (44, 46, "木及木制品"), (47, 49, "纸与印刷品"),
    (50, 63, "纺织品"), (64, 67, "鞋帽与羽毛制品"), (68, 70, "石材陶瓷与玻璃"), (71, 71, "珠宝与贵金属"), (72, 83, "贱金属及制品"),
    (84, 85, "机械与电气设备"), (86, 89, "运输设备"), (90, 92, "精密仪器与乐器"), (93, 93, "武器弹药"), (94, 96, "杂项制品"),
    (97, 97, "艺术品与古物"),
)


def country_dimension(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Code dimension. A numeric code that is missing, stated twice or without an ISO code stops the job: dropping it would
    lose all its flows without a word."""
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("numeric_code"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
        F.col("n_name").alias("name"),
    )
    codes = dim.groupBy("numeric_code").agg(F.count("*").alias("_n"), F.min("iso3").alias("iso3"), F.min("name").alias("name"))
    sound = F.col("numeric_code").isNotNull() & F.col("iso3").isNotNull() & (F.col("_n") == 1)
    checked = F.assert_true(sound, F.concat(F.lit("country code missing or not unique: "), F.coalesce(F.col("numeric_code").cast("string"), F.lit("null"))))
    return codes.filter(checked.isNull()).select("numeric_code", "iso3", "name")


def sided(dim: DataFrame, code: str, prefix: str) -> DataFrame:
    return dim.select(
        F.col("numeric_code").alias(code), F.col("iso3").alias(f"{prefix}_code"), F.col("name").alias(f"{prefix}_name")
    )


def star_join(flows: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    """Attach exporter and importer; the dimension is small enough for the size-checked auto broadcast."""
    return flows.join(sided(dim, "i", "exporter"), "i", how).join(sided(dim, "j", "importer"), "j", how)


def unmapped(flows: DataFrame, dim: DataFrame) -> DataFrame:
    """Pairs with a side missing from the dimension, after reduction to distinct code pairs."""
    pairs = flows.groupBy("t", "i", "j").agg(F.count("*").alias("rows"))
    joined = star_join(pairs, dim, "left")
    return joined.filter(F.col("exporter_code").isNull() | F.col("importer_code").isNull()).select(
        "t", "i", "j", "rows", F.col("exporter_code").isNull().alias("exporter_missing"),
        F.col("importer_code").isNull().alias("importer_missing"),
    )


def bilateral_totals(flows: DataFrame, dim: DataFrame) -> DataFrame:
    pairs = flows.groupBy("t", "i", "j").agg((F.sum("v") * 1000).alias("trade_usd"))
    return star_join(pairs, dim).select(
        F.col("t").alias("year"), "exporter_code", "exporter_name", "importer_code", "importer_name", "trade_usd"
    )


def chapter_totals(flows: DataFrame, dim: DataFrame) -> DataFrame:
    """Both directions from one pass: every reduced flow is an export row and an import row."""
    cells = flows.groupBy("t", "i", "j", F.substring("k", 1, 2).alias("hs2")).agg(F.sum("v").alias("v"))
    sides = cells.select(
        "t", "hs2", "v",
        F.explode(F.array(F.struct(F.lit("X").alias("flow"), F.col("i").alias("code")),
                          F.struct(F.lit("M").alias("flow"), F.col("j").alias("code")))).alias("side"),
    )
    totals = sides.groupBy("t", F.col("side.code").alias("code"), F.col("side.flow").alias("flow"), "hs2").agg(
        (F.sum("v") * 1000).alias("trade_usd")
    )
    return totals.join(sided(dim, "code", "reporter"), "code").select(
        F.col("t").alias("year"), "reporter_code", "reporter_name", "flow", "hs2", "trade_usd"
    )


def sector_partner_edges(flows: DataFrame, dim: DataFrame) -> DataFrame:
    """Edge list of the trade graph: chapters 1-97, no domestic loops."""
    chapter = F.substring("k", 1, 2)
    cells = (
        flows.filter((F.col("i") != F.col("j")) & chapter.try_cast("int").between(1, 97))
        .groupBy("t", "i", "j", chapter.alias("hs2"))
        .agg((F.sum("v") * 1000).alias("trade_usd"))
    )
    return star_join(cells, dim).select(
        F.col("t").alias("year"), F.col("exporter_code").alias("country_code"),
        F.col("importer_code").alias("partner_code"), "hs2", "trade_usd",
    )


def invalid_flow() -> Column:
    return (
        F.col("t").isNull() | F.coalesce(~finite(F.col("v")), F.lit(True)) | (F.col("v") < 0)
        | ~F.coalesce(F.col("k").rlike("^[0-9]{6}$"), F.lit(False))
    )


def flow_audit(flows: DataFrame, dim: DataFrame) -> DataFrame:
    """Row, total and defect counters per year in a single pass over the flows."""
    codes = dim.select("numeric_code", F.lit(True).alias("known"))
    joined = flows.join(codes.withColumnsRenamed({"numeric_code": "i", "known": "ek"}), "i", "left").join(
        codes.withColumnsRenamed({"numeric_code": "j", "known": "mk"}), "j", "left"
    )
    return joined.groupBy(F.col("t").alias("year")).agg(
        F.count("*").alias("rows"),
        F.sum("v").alias("total_thousand_usd"),
        F.count_if(invalid_flow()).alias("invalid_rows"),
        F.count_if(F.col("ek").isNull() | F.col("mk").isNull()).alias("unmapped_rows"),
        F.count_if(F.col("q").isNull()).alias("missing_quantity_rows"),
    )


def totals_reconcile(flows: DataFrame, dim: DataFrame) -> DataFrame:
    """Aggregates must add up to the raw total once (pairs) and twice (chapters).

    Raw total, pairs and chapter cells are grouping sets of one pass over the flows, combined before the one shuffle; only reduced
    rows meet the dimension, and a side that it does not know is missing from its total.
    """
    levels = flows.sparkSession.sql(
        """SELECT t, i, j, grouping_id() AS level, sum(v) * 1000 AS usd FROM (SELECT t, i, j, substring(k, 1, 2) AS hs2, v FROM {flows})
        GROUP BY GROUPING SETS ((t), (t, i, j), (t, i, j, hs2))""", flows=flows)
    raw, pair, cell = (F.col("level") == n for n in (7, 1, 0))  # bits of i, j and hs2 that are not grouped
    sides = star_join(levels, dim, "left")
    exporter, importer = F.col("exporter_code").isNotNull(), F.col("importer_code").isNotNull()
    of = lambda level, known: F.sum(F.when(level & known, F.col("usd")))
    joined = sides.groupBy(F.col("t").alias("year")).agg(
        of(raw, F.lit(True)).alias("raw"), of(pair, exporter & importer).alias("pairs"),
        (F.coalesce(of(cell, exporter), F.lit(0.0)) + F.coalesce(of(cell, importer), F.lit(0.0))).alias("chapters"))

    def agrees(total: str, times: int) -> Column:
        expected = F.col("raw") * times
        return F.coalesce(
            F.abs(F.col(total) - expected) <= F.greatest(F.lit(1.0), expected * 1e-9), F.lit(False)
        )

    return joined.select("year", "raw", agrees("pairs", 1).alias("pairs_ok"), agrees("chapters", 2).alias("chapters_ok"))


def mirror_flows(pairs: DataFrame) -> DataFrame:
    """Exports plus the same flows seen from the importer."""
    exports = pairs.select(
        "year", F.col("exporter_code").alias("reporter_code"), F.col("exporter_name").alias("reporter_name"),
        F.col("importer_code").alias("partner_code"), F.col("importer_name").alias("partner_name"),
        F.lit("X").alias("flow"), "trade_usd",
    )
    imports = pairs.select(
        "year", F.col("importer_code").alias("reporter_code"), F.col("importer_name").alias("reporter_name"),
        F.col("exporter_code").alias("partner_code"), F.col("exporter_name").alias("partner_name"),
        F.lit("M").alias("flow"), "trade_usd",
    )
    return exports.unionByName(imports)


def trade_balance(chapters: DataFrame) -> DataFrame:
    wide = chapters.groupBy("year", "reporter_code").pivot("flow", ["X", "M"]).agg(F.sum("trade_usd"))
    return wide.select(
        "year", "reporter_code", F.coalesce("X", F.lit(0.0)).alias("exports_usd"),
        F.coalesce("M", F.lit(0.0)).alias("imports_usd"),
    ).withColumn("balance_usd", F.col("exports_usd") - F.col("imports_usd"))


def shares(edges: DataFrame, keys: list[str], amount: str = "trade_usd") -> DataFrame:
    """Share of the group total; 0 when the total is not positive."""
    total = F.sum(amount).over(Window.partitionBy(*keys))
    return edges.withColumn("share", F.when(total > 0, F.col(amount) / total).otherwise(0.0))


def concentration(edges: DataFrame, keys: list[str], partner: str = "partner_code") -> DataFrame:
    """HHI, effective partners, top-1 and top-5 share and partner count of the positive flows."""
    ranked = shares(edges.filter(F.col("trade_usd") > 0), keys).withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), partner))
    )
    return (
        ranked.groupBy(*keys)
        .agg(
            F.sum("trade_usd").alias("export_usd"),
            F.sum(F.col("share") * F.col("share")).alias("hhi"),
            F.max("share").alias("top1_share"),
            F.sum(F.when(F.col("place") <= 5, F.col("share")).otherwise(0.0)).alias("top5_share"),
            F.count("*").alias("partner_count"),
        )
        .withColumn("effective_partners", ratio(F.lit(1.0), F.col("hhi")))
    )


def revealed_advantage(chapters: DataFrame) -> DataFrame:
    """Own chapter share over the world chapter share of exports; NULL when the benchmark is zero."""
    exports = chapters.filter(F.col("flow") == "X")
    own = F.sum("trade_usd").over(Window.partitionBy("year", "reporter_code"))
    world_chapter = exports.groupBy("year", "hs2").agg(F.sum("trade_usd").alias("world_chapter"))
    world = exports.groupBy("year").agg(F.sum("trade_usd").alias("world"))
    benchmark = world_chapter.join(world, "year").select(
        "year", "hs2", ratio(F.col("world_chapter"), F.col("world")).alias("world_share")
    )
    return (
        exports.withColumn("own_share", ratio(F.col("trade_usd"), own))
        .join(benchmark, ["year", "hs2"], "left")
        .select("year", "reporter_code", "hs2", "trade_usd", "own_share", "world_share",
                ratio(F.col("own_share"), F.col("world_share")).alias("rca"))
    )


def top_partners(flows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The largest partners of each group plus one row for everything not displayed."""
    window = Window.partitionBy(*keys).orderBy(F.desc("trade_usd"), "partner_code")
    ranked = shares(flows, keys).withColumn("place", F.row_number().over(window))
    shown = F.col("place") <= limit
    return ranked.groupBy(
        *keys,
        F.when(shown, F.col("place")).otherwise(limit + 1).cast("int").alias("place"),
        F.when(shown, F.col("partner_code")).otherwise("OTHER").alias("partner_code"),
    ).agg(F.sum("trade_usd").alias("trade_usd"), F.sum("share").alias("share"), F.count("*").alias("partners"))


def section_names(spark) -> DataFrame:
    """One row per chapter, so that the range lookup becomes an equality join."""
    ranges = spark.createDataFrame(SECTIONS, "first int, last int, section string")
    return ranges.select(F.explode(F.sequence("first", "last")).alias("chapter"), "section")


def range_lookup(frame: DataFrame, names: DataFrame) -> DataFrame:
    return (
        frame.withColumn("chapter", F.col("hs2").try_cast("int"))
        .join(F.broadcast(names), "chapter", "left")
        .drop("chapter")
    )


def chapter_lookup(frame: DataFrame, names: DataFrame, default: str = "Unnamed chapter") -> DataFrame:
    return frame.join(names, "hs2", "left").withColumn("chapter_name", F.coalesce("chapter_name", F.lit(default)))


def reported(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Targets whose country has any record in the target year."""
    return targets.join(totals.select("year", "country_code").distinct(), ["year", "country_code"], "left_semi")
