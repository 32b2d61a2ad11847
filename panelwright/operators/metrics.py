"""Evaluation metrics and resampling.

Metrics that need a global order (AUC, average precision, order statistics) never sort everything in one task:
rows are first reduced to one cell per distinct score, and running totals are built in four levels of bins over
the bits of the score, so that no window partition holds more than 65,536 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import finite, hash_number, order_bits, ratio

#: Low bits left out of a bin at each level: a window holds at most 65,536 bins or distinct scores, whatever their spread.
BIN_SHIFTS = (48, 32, 16)
#: Bootstrap replicates of a key that one row carries to a task.
REPLICATE_BLOCK = 100


def packed(keys: list[str]) -> Column:
    """The group as one value, in which missing parts are equal to each other."""
    return F.struct(F.lit(0).alias("_"), *keys)


def running_before(cells: DataFrame, keys: list[str], score: str, counts: list[str]) -> DataFrame:
    """Totals of ``counts`` over all cells of the key with a smaller score (distinct finite or infinite doubles).

    Bins are prefixes of the double's ordered bits, so one outlier or many scores next to zero fill no window. A
    missing key is a group like any other.
    """
    bins = [f"_b{n}" for n in range(len(BIN_SHIFTS))]
    bits = order_bits(F.col(score))
    binned = cells.withColumns({"_k": packed(keys), **{b: F.shiftright(bits, shift) for b, shift in zip(bins, BIN_SHIFTS)}})
    inner = Window.partitionBy("_k", *bins).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.withColumns({f"_w_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in counts})
    for level in range(len(bins)):
        outer_bins, name = bins[:level], bins[level]
        window = Window.partitionBy("_k", *outer_bins).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        coarse = binned.groupBy("_k", *outer_bins, name).agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
        before = coarse.select(
            "_k", *outer_bins, name,
            *[F.coalesce(F.sum(f"_s_{c}").over(window), F.lit(0)).alias(f"_l{level}_{c}") for c in counts],
        )
        out = out.join(before, ["_k", *outer_bins, name])
    totals = {
        f"{c}_before": reduce(lambda a, b: a + b, [F.col(f"_w_{c}"), *[F.col(f"_l{level}_{c}") for level in range(len(bins))]])
        for c in counts
    }
    return out.withColumns(totals).select(*keys, score, *counts, *totals)


def score_cells(scored: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """One row per key, method and distinct score: rows, rows with an outcome, and events."""
    long = scored.select(*keys, F.col("outcome").cast("int").alias("outcome"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])).alias("s"))
    return long.groupBy(*keys, F.col("s.method").alias("method"), F.col("s.score").alias("score")).agg(
        F.count("*").alias("n"), F.count("outcome").alias("labelled"), F.sum("outcome").alias("events")
    )


def rank_metrics(scored: DataFrame, keys: list[str], methods: list[str], minimum: int = 30) -> DataFrame:
    """ROC-AUC by average ranks (NULL below the minimum or with one class) and average precision with tied
    scores grouped.

    Rows without an outcome, or with a missing or non-finite score, take no part and are counted as ``invalid``.
    """
    group = [*keys, "method"]
    cells = score_cells(scored, keys, methods)
    usable = finite(F.col("score")) & (F.col("labelled") > 0)
    totals = cells.withColumn("_k", packed(group)).groupBy("_k").agg(
        F.coalesce(F.sum(F.when(usable, F.col("labelled"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(usable, F.col("events"))), F.lit(0)).alias("positives"), F.sum("n").alias("_rows"),
    )
    valid = cells.filter(usable).select(*group, "score", F.col("labelled").alias("n"), "events")
    placed = running_before(valid, group, "score", ["n", "events"]).withColumn("_k", packed(group)).drop(*group)
    negatives = F.col("n") - F.col("events")
    below = F.col("n_before") - F.col("events_before")
    at_or_above = F.col("total") - F.col("n_before")
    hits = F.col("positives") - F.col("events_before")
    sums = totals.join(placed, "_k", "left").groupBy("_k", "total", "positives", "_rows").agg(
        F.sum(F.col("events") * (below + 0.5 * negatives)).alias("_u"),
        F.sum(F.col("events") / F.nullif(F.col("positives"), F.lit(0)) * (hits / at_or_above)).alias("_ap"),
    )
    pairs = F.col("positives") * (F.col("total") - F.col("positives"))
    return sums.select(
        *[F.col(f"_k.{c}").alias(c) for c in group], F.col("total").alias("n"), F.col("positives").alias("events"),
        F.when((F.col("total") >= minimum) & (pairs > 0), F.col("_u") / pairs).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("_ap")).alias("average_precision"),
        (F.col("_rows") - F.col("total")).alias("invalid"),
    )


def order_statistic_quantiles(rows: DataFrame, keys: list[str], column: str, quantiles: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size; missing and NaN values take no part.

    Values are reduced to distinct cells, and only the cells that contain one of the two neighbouring ranks are kept.
    """
    value = F.col(column).cast("double")
    cells = rows.filter(value.isNotNull() & ~F.isnan(value)).groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    placed = running_before(cells, keys, "value", ["n"]).withColumn("_k", packed(keys)).drop(*keys)
    wanted = cells.groupBy(packed(keys).alias("_k")).agg(F.sum("n").alias("total")).select(
        "_k", "total", F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q")
    ).withColumn("_p", F.col("q") * (F.col("total") - 1))
    joined = wanted.join(placed, "_k")
    low, high = F.floor("_p"), F.ceil("_p")

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("value")))

    # the range test keeps at most two cells per group and quantile
    near = joined.filter((F.col("n_before") <= high) & (low < F.col("n_before") + F.col("n")))
    picked = near.groupBy("_k", "q", "total", "_p").agg(holds(low).alias("_a"), holds(high).alias("_b"))
    between = F.col("_a") + (F.col("_p") - F.floor("_p")) * (F.col("_b") - F.col("_a"))
    return picked.select(*[F.col(f"_k.{c}").alias(c) for c in keys], "q", F.col("total").alias("n"), between.alias("quantile"))


def probability_metrics(scored: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """Events, Brier score and clipped log-loss per method; out-of-range probabilities are counted."""
    cells = score_cells(scored, keys, methods)
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 2.220446049250313e-16)), F.lit(2.220446049250313e-16))
    misses = F.col("n") - F.col("events")
    square = F.col("events") * F.pow(F.col("score") - 1, 2) + misses * F.pow("score", 2)
    log_loss = -(F.col("events") * F.log(p) + misses * F.log(1 - p))
    n = F.sum("n")
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    return cells.groupBy(*keys, "method").agg(
        n.alias("n"), F.sum("events").alias("events"), (F.sum("events") / n).alias("event_rate"),
        (F.sum(square) / n).alias("brier"), (F.sum(log_loss) / n).alias("log_loss"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("invalid"),
    )


def calibration(scored: DataFrame, methods: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of every method, empty ones included."""
    cells = score_cells(scored, [], methods)
    index = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    filled = cells.groupBy("method", index.alias("bin")).agg(
        F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_prediction"),
        (F.sum("events") / F.sum("n")).alias("event_rate"),
    )
    spine = scored.sparkSession.range(bins).select(
        F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), F.col("id").cast("int").alias("bin")
    )
    return spine.join(filled, ["method", "bin"], "left").select(
        "method", "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_prediction", "event_rate",
    )


def long_errors(rows: DataFrame, keys: list[str], methods: list[str], actual: str = "value") -> DataFrame:
    long = rows.unpivot([*keys, actual], methods, "method", "prediction").filter("prediction IS NOT NULL")
    return long.withColumn("error", F.col("prediction") - F.col(actual))


def mae_rmse(errors: DataFrame, keys: list[str]) -> DataFrame:
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.pow("error", 2))).alias("rmse")
    )


def best_method(metrics: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Lowest development error per key; ties go to the first name."""
    return metrics.groupBy(*keys).agg(F.min(F.struct(metric, "method")).alias("m")).select(
        *keys, F.col("m.method").alias("method"), F.col(f"m.{metric}").alias(metric)
    )


def mase(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of |error| / scale; NULL when any scale is undefined, and how many are."""
    undefined = F.count_if(F.col("mase_scale").isNull())
    mean = F.avg(F.abs("error") / F.col("mase_scale"))
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"), undefined.alias("undefined_n"), F.when(undefined == 0, mean).alias("mase")
    )


def pinball(actual: str, quantile: str, level: float) -> Column:
    """Quantile loss: a miss above costs ``level``, a miss below what is left of one."""
    above = F.greatest(F.col(actual) - F.col(quantile), F.lit(0.0))
    below = F.greatest(F.col(quantile) - F.col(actual), F.lit(0.0))
    return level * above + (1 - level) * below


def interval_diagnostics(rows: DataFrame, keys: list[str], actual: str = "value") -> DataFrame:
    inside = F.col(actual).between(F.col("p10"), F.col("p90"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(inside.cast("int")).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("mean_width"),
        F.avg(pinball(actual, "p10", 0.1)).alias("pinball_p10"), F.avg(pinball(actual, "p50", 0.5)).alias("pinball_p50"),
        F.avg(pinball(actual, "p90", 0.9)).alias("pinball_p90"),
    )


def empirical_band(errors: DataFrame, key: str, level: float = 0.9) -> DataFrame:
    """Radius: the higher order statistic of the development absolute errors; its coverage on the holdout."""
    development = errors.filter("split = 'validation'").withColumn("_e", F.abs("error"))
    window = Window.partitionBy(key)
    ranked = development.withColumns({
        "_r": F.row_number().over(window.orderBy("_e")), "n": F.count("*").over(window),
    })
    q = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * level) / F.col("n"))
    radius = ranked.filter(F.col("_r") == F.ceil(q * (F.col("n") - 1)) + 1).select(
        key, F.col("_e").alias("radius"), F.col("n").alias("development_n")
    )
    held = errors.filter("split = 'test'").join(radius, key)
    return held.groupBy(key, "radius", "development_n").agg(
        F.count("*").alias("holdout_n"), F.avg((F.abs("error") <= F.col("radius")).cast("int")).alias("coverage")
    )


def pick(label: str, keys: list[str], replicate: Column, slot: Column, n: Column) -> Column:
    """A reproducible draw below ``n`` for one slot of one replicate of a key."""
    text = F.concat_ws("|", F.lit(label), *[F.col(k).cast("string") for k in keys], replicate.cast("string"), slot.cast("string"))
    return (hash_number(text) % n).cast("int")


def replicated(samples: DataFrame, keys: list[str], replicates: int, mean_of) -> DataFrame:
    """Interval of a resampled mean: one row per key with the array ``sample``, resampled inside the row.

    ``mean_of(replicate, position)`` gives the (total, count) drawn for a position; only one number per replicate leaves
    the row, so nothing of the size replicates x positions is shuffled.
    """
    # the rows are few and small but the work is not, so a size-based merge of partitions would leave it to one task
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.sequence(F.lit(1), F.lit(replicates), F.lit(REPLICATE_BLOCK))
    last = F.least(F.col("first") + REPLICATE_BLOCK - 1, F.lit(replicates))
    dealt = samples.withColumn("first", F.explode(blocks)).repartition(tasks, *keys, "first")
    spread = dealt.withColumn("replicate", F.explode(F.sequence("first", last)))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("count"))

    def add(so_far: Column, position: Column) -> Column:
        drawn = mean_of(F.col("replicate"), position)
        return F.struct((so_far["total"] + F.coalesce(drawn["total"], F.lit(0.0))).alias("total"),
                        (so_far["count"] + F.coalesce(drawn["count"], F.lit(0.0))).alias("count"))

    drawn = F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), start, add)
    sums = spread.select(*keys, drawn.alias("drawn"))
    return sums.select(*keys, ratio(F.col("drawn.total"), F.col("drawn.count")).alias("m")).groupBy(*keys).agg(
        F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"), F.count("*").alias("replicates"))


def sampled(rows: DataFrame, keys: list[str], order: str, total: Column, count: Column, mean: Column) -> DataFrame:
    """The ordered sample of each key as one array; a sample is as long as the calendar, the countries or the sources."""
    part = F.struct(F.col(order).alias("order"), total.cast("double").alias("total"), count.cast("double").alias("count"))
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(part)).alias("sample"), F.count("*").alias("n"), mean.alias("mean"))


def block_bootstrap(deltas: DataFrame, key: str, order: str, block: int, replicates: int) -> DataFrame:
    """Circular moving-block means of a series of paired differences (one row per key and month)."""
    known = F.when(F.col("delta").isNotNull(), F.lit(1.0))
    samples = sampled(deltas, [key], order, F.col("delta"), known, F.avg("delta"))

    def drawn(replicate: Column, position: Column) -> Column:
        start = pick("block", [key], replicate, F.floor(position / block), F.col("n"))
        return F.get(F.col("sample"), ((start + position % block) % F.col("n")).cast("int"))

    return replicated(samples, [key], replicates, drawn).join(samples.select(key, "n", "mean"), key)


def resampled(samples: DataFrame, keys: list[str], replicates: int, label: str) -> DataFrame:
    def drawn(replicate: Column, position: Column) -> Column:
        return F.get(F.col("sample"), pick(label, keys, replicate, position, F.col("n")))

    return replicated(samples, keys, replicates, drawn).join(samples.select(*keys, "n", "mean"), keys)


def cluster_bootstrap(clusters: DataFrame, keys: list[str], cluster: str, replicates: int, label: str = "cluster") -> DataFrame:
    """Resample whole clusters (one row each by now): sum of sums over sum of counts per replicate."""
    mean = F.sum("total") / F.nullif(F.sum("count"), F.lit(0))
    samples = sampled(clusters, keys, cluster, F.col("total"), F.col("count"), mean)
    return resampled(samples, keys, replicates, label).withColumnRenamed("n", "clusters")


def group_rate_bootstrap(groups: DataFrame, keys: list[str], group: str, replicates: int) -> DataFrame:
    """Mean of group rates with resampled groups."""
    known = F.when(F.col("rate").isNotNull(), F.lit(1.0))
    samples = sampled(groups, keys, group, F.col("rate"), known, F.avg("rate"))
    return resampled(samples, keys, replicates, "group").withColumnRenamed("n", "groups")


def wilson(success: Column, n: Column) -> tuple[Column, Column]:
    z = 1.959963984540054
    p = success / F.nullif(n, F.lit(0))
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return center - half, center + half


def brier_sums(scored: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """Per cluster: summed difference of two methods' squared errors and the number of rows."""
    loss = F.pow(F.col(first) - F.col("outcome"), 2) - F.pow(F.col(second) - F.col("outcome"), 2)
    return scored.groupBy(*keys).agg(F.sum(loss).alias("total"), F.count("*").alias("count"))
