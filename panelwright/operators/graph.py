"""Exposure on the trade graph for every year, chapter and origin at once.

Exposure indices are conditional on the stated shocks; missing onward mass is never renormalised. One- and
two-hop indices are computed as repeated matrix-vector products (edge table joined to a node vector), so they
never materialise paths. Only the path listing itself joins edges with edges; a node has at most as many
neighbours as there are countries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import finite

NODE = ["year", "hs2", "country_code"]


def edge_violations(edges: DataFrame) -> DataFrame:
    """Count of rows per reason; one row may break several rules.

    Duplicates are counted from the grouped keys, so copies of one key never meet in a single window.
    """
    code = r"^(?:[A-Z]{3}|[A-Z]\d{2})$"
    missing = F.lit(False)
    for name in ("year", "hs2", "country_code", "partner_code", "trade_usd"):
        missing = missing | F.col(name).isNull()
    amount = F.col("trade_usd")
    reasons = F.array(
        F.when(missing | F.col("hs2").try_cast("int").isNull(), "missing or mixed key"),
        F.when(~F.col("country_code").rlike(code) | ~F.col("partner_code").rlike(code), "bad code"),
        F.when(F.col("country_code") == F.col("partner_code"), "self loop"),
        F.when((amount < 0) | (amount.isNotNull() & ~finite(amount)), "negative or non-finite"),
        F.when(amount == 0, "zero"),
    )
    single = edges.select(F.explode(F.array_compact(reasons)).alias("reason"), F.lit(1).alias("n"))
    copies = (
        edges.groupBy("year", "hs2", "country_code", "partner_code").agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit("duplicate").alias("reason"), "n")
    )
    return single.unionByName(copies).groupBy("reason").agg(F.sum("n").alias("rows"))


def weights(edges: DataFrame) -> DataFrame:
    """Row-normalised weights of the positive edges; exporters without flows have no row."""
    total = F.sum("trade_usd").over(Window.partitionBy(*NODE))
    return edges.filter(F.col("trade_usd") > 0).withColumn("weight", F.col("trade_usd") / total)


def node_vectors(weighted: DataFrame, shocks: DataFrame) -> DataFrame:
    """Per exporter: direct exposure and the weight it puts on shocked markets."""
    joined = weighted.join(shocks.withColumnRenamed("country_code", "partner_code"), "partner_code", "left")
    shock = F.coalesce("shock_pct", F.lit(0.0))
    return joined.groupBy(*NODE).agg(
        F.sum(F.col("weight") * shock).alias("direct"),
        F.sum(F.when(shock > 0, F.col("weight")).otherwise(0.0)).alias("direct_shocked_weight"),
    )


def exposures(weighted: DataFrame, shocks: DataFrame) -> DataFrame:
    """Direct and two-hop indices and retained mass of every origin.

    ``W (W s)``: the node vector of the first hop is joined back on the partner side. Retained mass is the
    weight of partners that report onward edges (each row of W sums to one).
    """
    first = node_vectors(weighted, shocks)
    onward = first.select(
        "year", "hs2", F.col("country_code").alias("partner_code"), F.col("direct").alias("p_direct"),
        F.col("direct_shocked_weight").alias("p_shocked"),
    )
    hops = weighted.join(onward, ["year", "hs2", "partner_code"], "left")
    second = hops.groupBy(*NODE).agg(
        F.sum(F.col("weight") * F.coalesce("p_direct", F.lit(0.0))).alias("indirect"),
        F.sum(F.col("weight") * F.coalesce("p_shocked", F.lit(0.0))).alias("two_hop_shocked_weight"),
        F.sum(F.when(F.col("p_direct").isNotNull(), F.col("weight")).otherwise(0.0)).alias("retained_mass"),
        F.count_if(F.col("p_direct").isNull()).alias("dead_end_partners"),
    )
    return first.join(second, NODE).withColumn(
        "unreported_onward_mass", F.greatest(F.lit(0.0), 1 - F.col("retained_mass"))
    )


def cycle_return(weighted: DataFrame) -> DataFrame:
    """Share of an origin's exports that its partners send straight back: every edge meets its reverse edge."""
    back = weighted.select(
        "year", "hs2", F.col("country_code").alias("partner_code"), F.col("partner_code").alias("country_code"),
        F.col("weight").alias("back"),
    )
    return weighted.join(back, ["year", "hs2", "country_code", "partner_code"], "left").groupBy(*NODE).agg(
        F.sum(F.col("weight") * F.coalesce("back", F.lit(0.0))).alias("cycle_return"))


def blended(alpha: Column | float) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (F.col("direct") + alpha * F.col("indirect")) / (1 + alpha)


def edge_id(source: str, target: str) -> Column:
    return F.concat_ws(":", F.lit("flow"), F.col("year").cast("string"), "hs2", source, target)


def two_hop_paths(weighted: DataFrame, shocks: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """Every path origin -> via -> endpoint with both shares, contribution and edge identifiers."""
    first = weighted.select(
        "year", "hs2", F.col("country_code").alias("origin"), F.col("partner_code").alias("via"),
        F.col("weight").alias("first_share"),
    )
    second = weighted.select(
        "year", "hs2", F.col("country_code").alias("via"), F.col("partner_code").alias("endpoint"),
        F.col("weight").alias("second_share"),
    )
    paths = first.join(second, ["year", "hs2", "via"]).withColumn(
        "coefficient", F.col("first_share") * F.col("second_share")
    )
    if shocks is None:
        return paths
    return (
        paths.join(shocks.withColumnRenamed("country_code", "endpoint"), "endpoint", "left")
        .withColumn("shock_pct", F.coalesce("shock_pct", F.lit(0.0)))
        .withColumn("contribution", F.col("coefficient") * F.col("shock_pct"))
        .withColumn("blended_contribution", alpha * F.col("contribution") / (1 + alpha))
        .withColumn("edge_ids", F.array(edge_id("origin", "via"), edge_id("via", "endpoint")))
    )


def ranked_paths(paths: DataFrame, limit: int) -> DataFrame:
    """The strongest paths per origin plus one row with the contribution of all the others."""
    window = Window.partitionBy("year", "hs2", "origin").orderBy(
        F.desc("contribution"), F.desc("coefficient"), "via", "endpoint"
    )
    ranked = paths.withColumn("place", F.row_number().over(window))
    shown = F.col("place") <= limit
    return ranked.groupBy(
        "year", "hs2", "origin",
        F.when(shown, F.col("place")).otherwise(limit + 1).cast("int").alias("place"),
        F.when(shown, F.col("via")).otherwise("OTHER").alias("via"),
        F.when(shown, F.col("endpoint")).otherwise("OTHER").alias("endpoint"),
    ).agg(F.sum("contribution").alias("contribution"), F.count("*").alias("paths"))


def flow_links(paths: DataFrame, limit: int = 20) -> DataFrame:
    """Level-to-level links of the strongest positive paths."""
    window = Window.partitionBy("year", "hs2", "origin").orderBy(
        F.desc("contribution"), F.desc("coefficient"), "via", "endpoint"
    )
    top = paths.filter("contribution > 0").withColumn("place", F.row_number().over(window)).filter(
        F.col("place") <= limit
    )
    links = F.array(
        F.struct(F.lit(1).alias("level"), F.col("origin").alias("source"), F.col("via").alias("target")),
        F.struct(F.lit(2).alias("level"), F.col("via").alias("source"), F.col("endpoint").alias("target")),
    )
    return (
        top.select("year", "hs2", "origin", "contribution", F.explode(links).alias("link"))
        .groupBy("year", "hs2", "origin", "link.level", "link.source", "link.target")
        .agg(F.sum("contribution").alias("value"))
    )


def alpha_sensitivity(exposed: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    grid = F.array(*[F.lit(float(a)) for a in sorted(set(alphas))])
    return exposed.withColumn("alpha", F.explode(grid)).withColumn("blended", blended(F.col("alpha")))


def scenario_decomposition(weighted: DataFrame, shocks: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Each shocked market alone, all together, and the zero scenario; the markets add up to the total."""
    hit = shocks.filter("shock_pct > 0")
    direct = weighted.join(hit.withColumnRenamed("country_code", "partner_code"), "partner_code").select(
        *NODE, F.col("partner_code").alias("market"), (F.col("weight") * F.col("shock_pct")).alias("direct"),
    )
    onward = direct.select(
        "year", "hs2", F.col("country_code").alias("partner_code"), "market", F.col("direct").alias("onward")
    )
    indirect = (
        weighted.join(onward, ["year", "hs2", "partner_code"])
        .groupBy(*NODE, "market").agg(F.sum(F.col("weight") * F.col("onward")).alias("indirect"))
    )
    parts = direct.select(*NODE, "market", "direct", F.lit(0.0).alias("indirect")).unionByName(
        indirect.select(*NODE, "market", F.lit(0.0).alias("direct"), "indirect")
    )
    totals = parts.groupingSets([(*NODE, "market"), tuple(NODE)], *NODE, "market").agg(
        F.grouping_id().alias("level"), F.sum("direct").alias("direct"), F.sum("indirect").alias("indirect")
    )
    named = totals.select(
        *NODE, F.when(F.col("level") == 1, "combined").otherwise(F.col("market")).alias("scenario"),
        "direct", "indirect",
    )
    zero = weighted.select(*NODE).distinct().select(
        *NODE, F.lit("zero").alias("scenario"), F.lit(0.0).alias("direct"), F.lit(0.0).alias("indirect")
    )
    return named.unionByName(zero).withColumn("blended", blended(alpha))


def graph_quality(weighted: DataFrame) -> DataFrame:
    """Nodes, edges and nodes without onward edges per year and chapter."""
    sides = weighted.select(
        "year", "hs2", F.explode(F.array(
            F.struct(F.col("country_code").alias("node"), F.lit(1).alias("out")),
            F.struct(F.col("partner_code").alias("node"), F.lit(0).alias("out")))).alias("s"),
    )
    nodes = sides.groupBy("year", "hs2", "s.node").agg(F.sum("s.out").alias("out_edges"))
    return nodes.groupBy("year", "hs2").agg(
        F.count("*").alias("nodes"), F.sum("out_edges").alias("edges"),
        F.count_if(F.col("out_edges") == 0).alias("dead_ends"),
    )


def gdp_shock_exposure(edges: DataFrame, shocks: DataFrame, limit: float = 10.0) -> DataFrame:
    """Partner weight times a GDP shock in percentage points; per partner and total.

    Every edge stays. A shock that is not finite or beyond ``limit`` either way is refused: it gives no exposure, and
    neither does a total that would need it; ``refused`` counts such partners.
    """
    weighted = weights(edges).join(shocks.withColumnRenamed("country_code", "partner_code"), "partner_code", "left")
    stated = F.coalesce("shock_pp", F.lit(0.0))
    allowed = finite(stated) & (F.abs(stated) <= limit)
    table = weighted.withColumns({"_part": F.when(allowed, F.col("weight") * stated), "_refused": (~allowed).cast("int")})
    total = table.groupingSets([(*NODE, "partner_code"), tuple(NODE)], *NODE, "partner_code").agg(
        F.grouping_id().alias("level"), F.sum("weight").alias("weight"), F.sum("_part").alias("exposure_pp"),
        F.sum("_refused").alias("refused"),
    )
    return total.select(
        *NODE, F.when(F.col("level") == 1, "TOTAL").otherwise(F.col("partner_code")).alias("partner_code"),
        "weight", F.when(F.col("refused") == 0, F.col("exposure_pp")).alias("exposure_pp"), "refused",
    )
