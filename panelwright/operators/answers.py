"""From a question to its answer, for all questions at once: guard, indicator, tool, periods, numbers and evidence in one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, month_number
from panelwright.operators import retrieval

# Words of the period slot, and the reasons that ask back instead of refusing.
MONTH_BEFORE, YEAR_BEFORE = ("上月", "上个月", "去年同月"), "去年同月"
RECENT = r"(?:近|最近)(\d{1,2})个月"
CLARIFY = ("ambiguous_indicator", "ambiguous_period", "ambiguous_operation", "unsupported_operation", "empty_question")
#: Months a mean or an extreme may cover.
SHORTEST, LONGEST = 2, 24

MODELS = "key string, evaluated boolean, ridge_mae double, persistence_mae double, seasonal_mae double, test_n long, gate_passed boolean, " \
         "default_method string, forecast_mid int, reference double, experimental double"


def with_slots(questions: DataFrame, policy: str = "keyword", threshold: float = 0.08) -> DataFrame:
    """``questions`` with what they say: reason (of the guard), displayed, named (the indicator), tool, months (mentioned) and valid (months)."""
    guarded = retrieval.guard(questions)
    slots = {"named": retrieval.resolve_alias(questions), "months": retrieval.period_mentions(questions)}
    tools = retrieval.keyword_route(questions) if policy == "keyword" else retrieval.route(questions, threshold)
    out = guarded.join(slots["named"].withColumnRenamed("key", "named"), "question_id")
    return out.join(slots["months"], "question_id").join(tools.select("question_id", "tool"), "question_id")


def slots_in_row(questions: DataFrame) -> DataFrame:
    """``with_slots`` of the keyword policy without any join: every slot is an expression on the question."""
    kept = F.struct(*questions.columns)
    guarded = retrieval.guard(questions.withColumn("asked", kept)).select("question_id", "question", "reason", "displayed", "asked")
    carried = guarded.withColumn("question_id", F.struct(*guarded.columns))
    named = retrieval.resolve_alias(carried).select(F.col("question_id").alias("row"), F.col("key").alias("named"))
    again = named.select(F.struct("row", "named").alias("question_id"), F.col("row.question").alias("question"))
    months = retrieval.period_mentions(again).select(F.struct("question_id", "periods", "valid").alias("question_id"), F.col("question_id.row.question").alias("question"))
    tools = retrieval.keyword_route(months)
    at = F.col("question_id")
    return tools.select(
        at["question_id"]["row"]["question_id"].alias("question_id"), "question", at["question_id"]["row"]["reason"].alias("reason"),
        at["question_id"]["row"]["displayed"].alias("displayed"), at["question_id"]["named"].alias("named"), "tool",
        at["periods"].alias("periods"), at["valid"].alias("valid"))


def _periods(q: Column, tool: Column, months: Column, latest: Column) -> tuple[Column, Column, Column]:
    """(reason, first month, last month) of the period slot; months default to the latest one known."""
    n, one = F.size(months), F.get(months, F.lit(0))
    two = F.get(months, F.lit(1))
    current = F.coalesce(one, latest)
    looks_back = retrieval.any_of(q, MONTH_BEFORE) & (n <= 1)
    back = F.when(F.contains(q, F.lit(YEAR_BEFORE)), 12).otherwise(1)
    recent = F.regexp_extract(q, RECENT, 1).try_cast("int")
    windowed = (n == 0) & recent.isNotNull()
    spans = tool.isin("mean", "extrema")
    first = (F.when(tool == "observation", current).when((tool == "difference") & looks_back, current - back)
             .when(tool == "difference", F.least(one, two)).when(spans & windowed, latest - recent + 1).when(spans, one))
    last = (F.when(tool == "observation", current).when((tool == "difference") & looks_back, current)
            .when(tool == "difference", F.greatest(one, two)).when(spans & windowed, latest).when(spans, two))
    model = tool.isin("evaluation", "forecast")
    wanted = F.when(tool == "forecast", latest + 1).otherwise(latest)
    reason = (F.when(model & (n > 0) & ~((n == 1) & (one == wanted)), "historical_model")
              .when((tool == "observation") & (n > 1), "ambiguous_period")
              .when((tool == "difference") & ~looks_back & (n != 2), "ambiguous_period")
              .when(spans & ~windowed & (n != 2), "ambiguous_period")
              .when(spans & ~(last - first + 1).between(SHORTEST, LONGEST), "invalid_window"))
    return reason, F.when(~model, first), F.when(~model, last)


def answer_questions(questions: DataFrame, observations: DataFrame, models: DataFrame, policy: str = "keyword", threshold: float = 0.08) -> DataFrame:
    """One row per question (question_id, question): status, reason, scope, numbers and evidence.

    ``observations`` are the official readings (key, mid, value), one per key and month; ``models`` the evaluated models (``MODELS``), one per key.
    Slots are filled in the reference order: refusal by the guard, one indicator that has readings, the tool (``policy`` keyword, or
    tfidf with ``threshold``), then the period: mentioned months, ``上月``, ``去年同月``, ``最近 n 个月``, or by default the latest
    reading. ``status`` is ``answered``; ``clarify`` where the question may be put better; else ``refused``, with the ``reason``. All months that
    are asked for must have a reading. Extremes keep every month that ties; a word for low asks for the minimum.

    Columns: question_id, status, reason, displayed, key, tool, first_period, last_period, defaulted_period, value (the reading, difference,
    mean, extreme, or the model's ridge error or experimental forecast), reference and current (both ends, or the model's baseline), n,
    extreme_periods and evidence_ids. A null question counts as empty. Question ids are unique.

    The readings of an indicator are one map, so questions meet their indicator once, many to one, and all arithmetic stays in the row;
    with the keyword policy questions are not shuffled for anything else.
    """
    asked = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"))
    slots = slots_in_row(asked) if policy == "keyword" else with_slots(asked, "tfidf", threshold)
    readings = observations.where("value IS NOT NULL").groupBy("key").agg(
        F.max("mid").alias("latest"), F.map_from_entries(F.collect_list(F.struct("mid", "value"))).alias("readings"))
    known = slots.join(readings.withColumnRenamed("key", "named"), "named", "left").join(models.withColumnRenamed("key", "named"), "named", "left")
    q = retrieval.normalize(F.col("question"))
    months = F.transform("periods", month_number)
    named = F.col("named")
    slot, first, last = _periods(F.col("_q"), F.col("tool"), F.col("_months"), F.col("latest"))
    found = known.withColumns({"_q": q, "_months": months}).withColumns({"_slot": slot, "_first": first, "_last": last})
    reason = F.coalesce(
        F.col("reason"), F.when(named == "ambiguous", "ambiguous_indicator").when((named == "unsupported") | F.col("latest").isNull(), "unsupported_indicator"),
        F.when(F.col("tool").isNull(), "unsupported_operation"), F.when(~F.col("valid"), "invalid_period"), F.col("_slot"))
    found = found.withColumn("_reason", reason)
    ends = F.col("tool") == "difference"
    wanted = F.when(F.col("_reason").isNull() & F.col("_first").isNotNull(), F.when(ends, F.array("_first", "_last")).otherwise(F.sequence("_first", "_last")))
    # a generator evaluates the looked-up readings once
    found = found.select("*", F.explode(F.array(F.struct(wanted.alias("mids"), F.transform(wanted, lambda m: F.col("readings")[m]).alias("values")))).alias("_e"))
    mids, values = F.col("_e.mids"), F.col("_e.values")
    model = F.col("tool").isin("evaluation", "forecast")
    missing = F.when(model, F.when(~F.coalesce(F.col("evaluated"), F.lit(False)) | ((F.col("tool") == "forecast") & F.col("experimental").isNull()), "insufficient_model")
                     ).when(F.exists(values, lambda v: v.isNull()), "missing_observation")
    final = F.coalesce(F.col("_reason"), missing)
    found = found.withColumn("_final", final)
    good, tool = F.col("_final").isNull(), F.col("tool")
    n = F.size(values)
    start, end = F.get(values, F.lit(0)), F.get(values, n - 1)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    extreme = F.when(retrieval.any_of(F.col("_q"), retrieval.LOW), F.array_min(values)).otherwise(F.array_max(values))
    ties = F.filter(F.arrays_zip(mids.alias("m"), values.alias("v")), lambda e: e["v"] == extreme)
    value = (F.when(tool == "observation", start).when(tool == "difference", end - start).when(tool == "mean", total / n).when(tool == "extrema", extreme)
             .when(tool == "evaluation", F.col("ridge_mae")).otherwise(F.col("experimental")))
    label = lambda m: F.concat(F.lit("obs:"), named, F.lit(":"), month_label(m))
    evidence = F.when(model, F.array(F.concat(F.lit("model:"), named))).otherwise(F.transform(mids, label))
    status = F.when(good, "answered").when(F.col("_final").isin(*CLARIFY), "clarify").otherwise("refused")
    shown = good & ~model
    return found.select(
        "question_id", status.alias("status"), F.col("_final").alias("reason"), "displayed",
        F.when(~named.isin("ambiguous", "unsupported"), named).alias("key"), "tool",
        F.when(shown, month_label(F.col("_first"))).alias("first_period"), F.when(shown, month_label(F.col("_last"))).alias("last_period"),
        F.when(good, F.size("_months") == 0).alias("defaulted_period"), F.when(good, value).alias("value"),
        F.when(good, F.when(ends, start).when(tool == "evaluation", F.col("persistence_mae")).when(tool == "forecast", F.col("reference"))).alias("reference"),
        F.when(good, F.when(ends, end)).alias("current"),
        F.when(good, F.when(tool == "evaluation", F.col("test_n")).when(~model, n.cast("long"))).alias("n"),
        F.when(good & (tool == "extrema"), F.array_join(F.transform(ties, lambda e: month_label(e["m"])), ",")).alias("extreme_periods"),
        F.when(good, F.array_join(evidence, ",")).alias("evidence_ids"))
