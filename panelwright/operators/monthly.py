"""Monthly official observations on a real calendar.

Series are keyed by indicator; a series has at most one row per month, so windows by key are short. Lags are
range frames on the month id, never row offsets, so a gap yields NULL instead of a neighbour's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label


def by_key():
    """Months of one indicator in order."""
    return Window.partitionBy("key").orderBy("mid")


def lagged(months: int, column: str = "value") -> Column:
    """Value exactly ``months`` earlier (negative: later)."""
    return F.max(column).over(by_key().rangeBetween(-months, -months))


def with_published(monthly: DataFrame) -> DataFrame:
    """Publication date: so many days after the first day of the following month."""
    following = F.make_date(
        F.floor((F.col("mid") + 1) / 12).cast("int"), ((F.col("mid") + 1) % 12 + 1).cast("int"), F.lit(1)
    )
    return monthly.withColumn("published", F.date_add(following, F.col("publication_lag_days").cast("int")))


def catalogue(monthly: DataFrame) -> DataFrame:
    """Indicator dimension of the test tables: one row per key."""
    key = F.col("key")
    return monthly.select("key").distinct().select(
        "key", F.concat(F.lit("Priority "), F.substring("key", 2, 9)).alias("name"),
        F.when(key.isin("p1", "p2", "p3"), "monthly").when(key == "p4", "year to date rate")
        .otherwise("year to date amount").alias("basis"),
        F.when(key.isin("p1", "p2"), "urgent").otherwise("normal").alias("topic"),
    )


def densify(monthly: DataFrame, columns: list[str]) -> DataFrame:
    """One row per month between the first and last observation of each key."""
    spine = monthly.groupBy("key").agg(F.min("mid").alias("a"), F.max("mid").alias("b")).select(
        "key", F.explode(F.sequence("a", "b")).alias("mid")
    )
    return spine.join(monthly.select("key", "mid", *columns), ["key", "mid"], "left")


def trailing_spine(monthly: DataFrame, end: int, months: int) -> DataFrame:
    """The same trailing window of months for every key."""
    return monthly.select("key").distinct().withColumn(
        "mid", F.explode(F.sequence(F.lit(end - months + 1), F.lit(end)))
    )


def gap_segments(monthly: DataFrame) -> DataFrame:
    """Runs of consecutive months with their number, bounds and length."""
    island = F.col("mid") - F.row_number().over(by_key())
    runs = monthly.withColumn("_i", island).groupBy("key", "_i").agg(
        F.min("mid").alias("first_mid"), F.max("mid").alias("last_mid"), F.count("*").alias("length")
    )
    return runs.withColumn("segment", F.row_number().over(Window.partitionBy("key").orderBy("first_mid"))).drop("_i")


def calendar_gaps(monthly: DataFrame) -> DataFrame:
    following = F.lead("mid").over(by_key())
    return monthly.select("key", "mid", following.alias("next_mid")).filter("next_mid - mid > 1").withColumn(
        "missing_months", F.col("next_mid") - F.col("mid") - 1
    )


def simple_baselines(monthly: DataFrame) -> DataFrame:
    """Persistence, seasonal and drift forecasts of every month from its own past."""
    past = by_key().rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("value").over(past)
    last = lagged(1)
    drift = last + (last - F.first("value").over(past)) / F.nullif(n - 1, F.lit(0))
    return monthly.select(
        "key", "mid", "value", last.alias("persistence"), lagged(12).alias("seasonal"), drift.alias("drift")
    )


def seasonal_scale(monthly: DataFrame) -> DataFrame:
    """Mean absolute year-on-year difference over the past of every origin; NULL when numerically zero."""
    moves = monthly.withColumn("_d", F.abs(F.col("value") - lagged(12)))
    past = by_key().rowsBetween(Window.unboundedPreceding, -1)
    scale = F.avg("_d").over(past)
    return moves.select("key", "mid", "value", F.when(scale > 1e-12, scale).alias("mase_scale"),
                        F.count("_d").over(past).alias("pairs"))


def prefix_context(monthly: DataFrame, shortest: int = 36, longest: int = 60) -> DataFrame:
    """All prior values of each origin in order, if their number is within bounds and the last one is adjacent."""
    past = by_key().rowsBetween(Window.unboundedPreceding, -1)
    bounded = by_key().rowsBetween(-longest, -1)
    rows = monthly.select(
        "key", "mid", F.count("*").over(past).alias("context_n"), lagged(1, "mid").alias("previous"),
        F.collect_list("mid").over(bounded).alias("periods"), F.collect_list("value").over(bounded).alias("values"),
    )
    return rows.filter(F.col("context_n").between(shortest, longest) & F.col("previous").isNotNull())


def month_change(monthly: DataFrame, catalog: DataFrame) -> DataFrame:
    """Change against the previous calendar month with the reason when it is not computed."""
    joined = monthly.withColumn("previous", lagged(1)).join(catalog, "key")
    reason = (
        F.when(F.col("basis") == "year to date amount", "cumulative amount")
        .when((F.col("basis") == "year to date rate") & (F.col("mid") % 12 == 0), "crosses the year")
        .when(F.col("previous").isNull(), "previous month not recorded")
    )
    delta = F.when(reason.isNull(), F.round(F.col("value") - F.col("previous"), 4) + F.lit(0.0))
    return joined.withColumns({"reason": F.coalesce(reason, F.lit("")), "delta": delta}).withColumn(
        "direction", direction("delta")
    )


def direction(name: str) -> Column:
    value = F.col(name)
    return F.when(value > 0, "up").when(value < 0, "down").when(value == 0, "flat")


def latest_per_key(monthly: DataFrame) -> DataFrame:
    newest = F.max("mid").over(Window.partitionBy("key"))
    return monthly.withColumn("_m", newest).filter("mid = _m").drop("_m")


def topic_headlines(changes: DataFrame, latest: int) -> DataFrame:
    """Per topic the newest month shared by fresh members, its members and a two-member title."""
    fresh = latest_per_key(changes).filter(F.col("delta").isNotNull() & (latest - F.col("mid") <= 2))
    newest = F.max("mid").over(Window.partitionBy("topic"))
    shared = fresh.withColumn("_m", newest).filter("mid = _m")
    members = shared.groupBy("topic", "mid").agg(
        F.array_sort(F.collect_list(F.struct("key", "name", "direction"))).alias("m")
    )
    named = F.transform(F.slice("m", 1, 2), lambda x: F.concat(x["name"], F.lit(" "), x["direction"]))
    return members.select(
        "topic", "mid", F.array_join(F.col("m.key"), ",").alias("members"), F.array_join(named, ", ").alias("title")
    )


def rolling_percentile(monthly: DataFrame, months: int = 60, minimum: int = 24, coverage: float = 70.0) -> DataFrame:
    """Mid-rank within the trailing window, given enough observations, and the exact year-ago change."""
    window = by_key().rangeBetween(-(months - 1), 0)
    rows = monthly.withColumns({
        "_s": F.collect_list("value").over(window), "sample": F.count("value").over(window), "_ago": lagged(12),
    })
    below = F.size(F.filter("_s", lambda x: x < F.col("value")))
    equal = F.size(F.filter("_s", lambda x: x == F.col("value")))
    share = 100.0 * F.col("sample") / months
    rank = F.round(100.0 * (below + equal / 2) / F.col("sample"), 1)
    return rows.select(
        "key", "mid", "value", "sample", F.round(share, 1).alias("coverage_pct"),
        F.when((F.col("sample") >= minimum) & (share >= coverage), rank).alias("percentile"),
        (F.round(F.col("value") - F.col("_ago"), 3) + F.lit(0.0)).alias("year_ago_delta"),
    )


def cycle_features(monthly: DataFrame, horizon: int) -> DataFrame:
    """Year-on-year features of four series on a gap-free calendar and the future label of the first one."""
    spine = monthly.agg(F.explode(F.sequence(F.min("mid"), F.max("mid"))).alias("mid"))
    wide = monthly.groupBy("mid").pivot("key", ["p1", "p2", "p3", "p4"]).agg(F.max("value"))
    # one row per calendar month from here on
    calendar = spine.join(wide, "mid", "left")
    order = Window.orderBy("mid")

    def off(name: str, months: int) -> Column:
        return F.max(name).over(order.rangeBetween(months, months))

    future = off("p1", horizon)
    return calendar.select(
        "mid", (100 * (F.col("p1") / off("p1", -12) - 1)).alias("ip_yoy"),
        (100 * (F.col("p2") / off("p2", -12) - 1)).alias("cpi_yoy"),
        (F.col("p3") - off("p3", -12)).alias("unemployment_change"), F.col("p4").alias("policy_rate"),
        (F.col("p3") - off("p3", -3)).alias("unemployment_change_3m"),
        F.when(F.col("p1").isNotNull() & future.isNotNull(), (future < F.col("p1")).cast("int")).alias("contraction"),
    )


CYCLE_FEATURES = ["ip_yoy", "cpi_yoy", "unemployment_change", "policy_rate"]


def purged_windows(features: DataFrame, horizon: int, lookback: int, minimum: int) -> DataFrame:
    """Size, events and bounds of the training window of every month; labels still unknown are left out."""
    complete = F.col("contraction").isNotNull()
    for name in CYCLE_FEATURES:
        complete = complete & F.col(name).isNotNull()
    frame = Window.orderBy("mid").rangeBetween(-(horizon + lookback), -(horizon + 1))
    rows = features.withColumn("_ok", complete)
    n = F.count_if("_ok").over(frame)
    events = F.sum(F.when(F.col("_ok"), F.col("contraction"))).over(frame)
    return rows.select(
        "mid", n.alias("train_n"), F.min(F.when(F.col("_ok"), F.col("mid"))).over(frame).alias("train_start"),
        F.max(F.when(F.col("_ok"), F.col("mid"))).over(frame).alias("train_end"), events.alias("events"),
    ).filter(F.col("train_n") >= minimum)


def lag_features(monthly: DataFrame) -> DataFrame:
    """Lags 1, 2, 3 and 12, all present, and the position in the year."""
    angle = 2 * F.pi() * (F.col("mid") % 12) / 12
    rows = monthly.select(
        "key", "mid", "value", *[lagged(n).alias(f"lag{n}") for n in (1, 2, 3, 12)],
        F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"),
    )
    return rows.dropna(subset=["lag1", "lag2", "lag3", "lag12"])


def anomaly_features(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "key", "mid", F.col("value").alias("level"), (F.col("value") - lagged(1)).alias("change_1m"),
        (F.col("value") - lagged(12)).alias("change_12m"),
    ).dropna()


def chronological_split(samples: DataFrame, holdout: int = 12, minimum: int = 24) -> DataFrame:
    """train: first samples; test: the last calendar months of the series; validation: everything between."""
    last = F.max("mid").over(Window.partitionBy("key"))
    n = F.row_number().over(by_key())
    return samples.withColumn(
        "split", F.when(n <= minimum, "train").when(F.col("mid") > last - holdout, "test").otherwise("validation")
    )


def boundary_violations(published: DataFrame, issue_day: int = 20) -> DataFrame:
    """Inputs not yet public at the issue date of a target, and targets already public at their own.

    An input of month m becomes public in month p; it breaks exactly the targets after m whose issue date is
    on or before the publication date, a short run of months that is generated directly.
    """
    pub_mid = F.year("published") * 12 + F.month("published") - 1
    last = F.when(F.dayofmonth("published") >= issue_day, pub_mid).otherwise(pub_mid - 1)
    inputs = published.withColumn("_last", last).filter("_last > mid").select(
        "key", "mid", F.explode(F.sequence(F.col("mid") + 1, F.col("_last"))).alias("target_mid")
    )
    targets = published.select("key", F.col("mid").alias("target_mid"), "published")
    late = inputs.join(targets.select("key", "target_mid"), ["key", "target_mid"], "left_semi").select(
        "key", "target_mid", "mid", F.lit("input after issue date").alias("reason")
    )
    issue = F.make_date(F.floor(F.col("target_mid") / 12).cast("int"), (F.col("target_mid") % 12 + 1).cast("int"),
                        F.lit(issue_day))
    early = targets.filter(F.col("published") <= issue).select(
        "key", "target_mid", F.col("target_mid").alias("mid"), F.lit("target already published").alias("reason")
    )
    return late.unionByName(early)


def origin_plan(published: DataFrame, months: int = 12) -> DataFrame:
    """Forecast origins of the last two blocks of months with their context bounds and publication dates."""
    past = by_key().rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("mid").over(Window.partitionBy("key"))
    back = last - F.col("mid")
    rows = published.select(
        "key", "mid", F.when(back < months, "audit").when(back < 2 * months, "development").alias("split"),
        F.count("*").over(past).alias("context_n"), F.min("mid").over(past).alias("context_start"),
        F.max("mid").over(past).alias("context_end"), F.max("published").over(past).alias("latest_context_publication"),
        F.col("published").alias("target_publication"),
    )
    return rows.filter("split IS NOT NULL").withColumn("target", month_label(F.col("mid")))


def window_requests(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Observations inside each requested span: the span is a short list of months, hence an equality join."""
    months = requests.select(
        "request_id", "key", "p", "q", F.explode(F.sequence("p", "q")).alias("mid")
    )
    return months.join(monthly.select("key", "mid", "value", "period"), ["key", "mid"], "left")


def window_mean(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Mean over a complete contiguous span of 2-24 months, otherwise refused."""
    span = F.col("q") - F.col("p") + 1
    rows = window_requests(requests, monthly).groupBy("request_id", "key", "p", "q").agg(
        F.count("value").alias("n"), F.avg("value").alias("m")
    )
    fine = (F.col("n") == span) & span.between(2, 24)
    return rows.select(
        "request_id", "key", "p", "q", "n", F.when(fine, F.col("m")).alias("mean"),
        F.when(fine, "answered").otherwise("refused").alias("status"),
    )


def extrema(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Minimum and maximum of each span and every month that attains them."""
    rows = window_requests(requests, monthly).filter("value IS NOT NULL")
    group = Window.partitionBy("request_id")
    marked = rows.withColumns({"low": F.min("value").over(group), "high": F.max("value").over(group)})
    months = {
        f"{name}_periods": F.array_join(F.array_sort(F.collect_list(F.when(F.col("value") == F.col(name), F.col("period")))), ",")
        for name in ("low", "high")
    }
    return marked.groupBy("request_id", "low", "high").agg(*[c.alias(n) for n, c in months.items()])


def breadth(monthly: DataFrame, members: list[str], threshold: float) -> DataFrame:
    """How many members stand above the threshold, only for months every member reports."""
    rows = monthly.filter(F.col("key").isin(members)).groupBy("mid").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > threshold).alias("above"),
        F.count_if(F.col("value") == threshold).alias("equal"),
    )
    return rows.filter(F.col("total") == len(members))


def theme_freshness(monthly: DataFrame, catalog: DataFrame) -> DataFrame:
    latest = monthly.groupBy("key").agg(F.max("mid").alias("latest"))
    return catalog.join(latest, "key", "left").groupBy("topic").agg(
        F.count("*").alias("members"), F.min("latest").alias("oldest_latest"), F.max("latest").alias("newest_latest"),
        (F.min("latest") != F.max("latest")).alias("partial"),
    )


def source_status(published: DataFrame, source: str) -> DataFrame:
    return published.groupBy(F.parse_url(F.col(source), F.lit("HOST")).alias("host"), "key").agg(
        F.count("*").alias("rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.countDistinct(source).alias("sources"), F.count("published").alias("dated"),
        F.count_if(F.col("published").isNull()).alias("undated"),
    )


def preset_window(monthly: DataFrame, presets: DataFrame, end: int, months: int) -> DataFrame:
    """Trailing values of the members of preset groups with the number collected per member."""
    spine = presets.withColumn("mid", F.explode(F.sequence(F.lit(end - months + 1), F.lit(end))))
    rows = spine.join(monthly.select("key", "mid", "value"), ["key", "mid"], "left")
    return rows.withColumn("collected", F.count("value").over(Window.partitionBy("preset", "key")))


def missing_worklist(monthly: DataFrame, reference: str) -> DataFrame:
    """Months the reference series has and another series lacks."""
    months = monthly.filter(F.col("key") == reference).agg(F.collect_set("mid")).scalar()  # a calendar
    wanted = monthly.filter(F.col("key") != reference).select("key").distinct().withColumn("mid", F.explode(months))
    return wanted.join(monthly.select("key", "mid"), ["key", "mid"], "left_anti")


def source_precedence(candidates: DataFrame, preferred: str) -> DataFrame:
    """Drop other rows of a period the preferred source already covers."""
    covered = candidates.filter(F.col("origin") == preferred).select("key", "mid").distinct().withColumn("_c", F.lit(True))
    return candidates.join(covered, ["key", "mid"], "left").filter(
        (F.col("origin") == preferred) | F.col("_c").isNull()
    ).drop("_c")


def hydrate(rows: DataFrame, lookup: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Fill an empty attribute from a lookup; an existing one is never overwritten."""
    found = lookup.select(*keys, F.col(column).alias("_new"))
    empty = F.col(column).isNull() | (F.trim(column) == "")
    return rows.join(found, keys, "left").withColumns({
        "hydrated": empty & F.col("_new").isNotNull(),
        column: F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column)),
    }).drop("_new")
