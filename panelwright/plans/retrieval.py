from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.functions.unicode import fold
from panelwright.operators import answers, metrics
from panelwright.operators import monthly as mo
from panelwright.operators import retrieval as op
from panelwright.plans.metrics import BT, backtest
from panelwright.plans.monthly import CHANGE
from panelwright.plans.registry import query
from panelwright.sources.asked import ANSWERS_SQL

TABLES = ", ".join("'" + t.replace("'", "''") + "'" for t in (op.WIDE, op.NARROW))


def norm(text):
    return f"lower(regexp_replace(translate({text}, {TABLES}), '[ \\t\\r\\n\\f]+', '', 'g'))"


@query("text_normalize", f"""
WITH t AS (SELECT doc_id, {norm("translate(text, '0123456789ABCDEF', '０１２３４５６７８９ＡＢＣＤＥＦ')")} AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM t""")
def text_normalize(inp):
    wide = F.translate("text", "0123456789ABCDEF", "０１２３４５６７８９ＡＢＣＤＥＦ")
    return inp.documents.select("doc_id", op.normalize(wide).alias("t")).select(
        "doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


GRAM = """SELECT {id}, gram, count(*) AS tf FROM (SELECT {id}, unnest(list_concat(list_concat([substr(t, i, 2) for i in range(1, length(t))], [substr(t, i, 3) for i in range(1, length(t) - 1)]),
  [substr(t, i, 4) for i in range(1, length(t) - 2)])) AS gram FROM {src}) GROUP BY ALL"""


@query("char_tfidf", f"""
WITH t AS (SELECT conv_id || '-' || turn AS text_id, {norm("text")} AS t FROM conversations), g AS ({GRAM.format(id="text_id", src="t")}),
d AS (SELECT gram, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY gram), w AS (SELECT text_id, gram, tf, (1 + ln(tf)) * idf AS w FROM g JOIN d USING (gram)),
n AS (SELECT text_id, sqrt(sum(w * w)) AS n FROM w GROUP BY text_id)
SELECT text_id, gram, tf, round(w / n, 6) + 0.0 AS weight FROM w JOIN n USING (text_id)""")
def char_tfidf(inp):
    texts = inp.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text")
    return op.tfidf(texts, "text_id", op.normalize(F.col("text"))).withColumn("weight", rounded("weight", 6))


PROTO = ", ".join(f"('{t}', '{x}', {i})" for i, (t, x) in enumerate(op.PROTOTYPES))


@query("route_top1", f"""
WITH p0 AS (SELECT * FROM (VALUES {PROTO}) v(tool, text, pos)), p AS (SELECT tool, pos, {norm("text")} AS t FROM p0), pg AS ({GRAM.format(id="tool", src="p")}),
d AS (SELECT gram, ln(7.0 / (1 + count(*))) + 1 AS idf FROM pg GROUP BY gram), pw AS (SELECT tool, gram, (1 + ln(tf)) * idf AS w, idf FROM pg JOIN d USING (gram)),
pn AS (SELECT tool, sqrt(sum(w * w)) AS n FROM pw GROUP BY tool), q AS (SELECT question_id, {norm("question")} AS t FROM questions), qg AS ({GRAM.format(id="question_id", src="q")}),
qw AS (SELECT question_id, gram, (1 + ln(tf)) * idf AS w FROM qg JOIN d USING (gram)), qn AS (SELECT question_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
sc AS (SELECT question_id, tool, round(sum(qw.w * pw.w / pn.n / qn.n), 9) AS s FROM qw JOIN pw USING (gram) JOIN pn USING (tool) JOIN qn USING (question_id) GROUP BY ALL),
al AS (SELECT question_id, p.tool, p.pos, coalesce(s, 0) AS s, q.t FROM q CROSS JOIN p LEFT JOIN sc USING (question_id, tool)),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, pos) AS n FROM al)
SELECT question_id, round(s, 6) + 0.0 AS score, CASE WHEN contains(t, '差值') THEN 'difference' WHEN s >= 0.08 THEN tool END AS tool FROM b WHERE n = 1""")
def route_top1(inp):
    return op.route(inp.questions, 0.08).withColumn("score", rounded("score", 6))


@query("keyword_route", """
SELECT question_id, CASE qform WHEN 0 THEN 'observation' WHEN 1 THEN 'difference' WHEN 2 THEN 'mean' WHEN 3 THEN 'extrema' WHEN 4 THEN 'forecast' WHEN 5 THEN 'evaluation' WHEN 8 THEN 'extrema' ELSE 'observation' END AS tool FROM questions""")
def keyword_route(inp):
    return op.keyword_route(inp.questions).select("question_id", "tool")


@query("alias_longest_match", """
SELECT question_id, CASE WHEN qform = 9 THEN 'ambiguous' ELSE ['cpi_yoy', 'cpi_mom', 'ppi_yoy', 'ppi_mom', 'manufacturing_pmi', 'manufacturing_new_orders_pmi', 'nonmanufacturing_pmi'][k + 1] END AS key FROM questions""")
def alias_longest_match(inp):
    return op.resolve_alias(inp.questions)


@query("period_mentions", """
SELECT question_id, CASE WHEN qform = 0 THEN p0 WHEN qform IN (1, 2) THEN p0 || ',' || p3 WHEN qform = 9 THEN substr(p0, 1, 4) || '-13' ELSE '' END AS periods, qform <> 9 AS valid FROM questions""")
def period_mentions(inp):
    return op.period_mentions(inp.questions).withColumn("periods", F.array_join("periods", ","))


@query("request_guard", """
SELECT question_id, CASE qform WHEN 6 THEN 'unsupported_claim' WHEN 7 THEN 'unsafe_request' WHEN 8 THEN 'ambiguous_operation' END AS reason,
  CASE WHEN qform = 7 THEN '[sensitive content removed]' ELSE question END AS displayed FROM questions""")
def request_guard(inp):
    return op.guard(inp.questions).select("question_id", "reason", "displayed")


@query("filtered_retrieval", f"""
WITH e AS (SELECT 'obs:' || key || ':' || period AS evidence_id, key, mid, {norm("period || ' ' || key || ' ' || source_title || ' official observation'")} AS t FROM monthly_obs),
rq AS (SELECT request_id, key, p, q, {norm("tool || ' ' || key || ' ' || CAST(CAST(floor(q / 12) AS INT) AS VARCHAR) || '-' || lpad(CAST(q % 12 + 1 AS VARCHAR), 2, '0')")} AS t FROM requests),
eg AS ({GRAM.format(id="evidence_id", src="e")}), d AS (SELECT gram, ln((1 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM eg GROUP BY gram),
ew AS (SELECT evidence_id, gram, (1 + ln(tf)) * idf AS w FROM eg JOIN d USING (gram)), en AS (SELECT evidence_id, sqrt(sum(w * w)) AS n FROM ew GROUP BY ALL),
qg AS ({GRAM.format(id="request_id", src="rq")}), qw AS (SELECT request_id, gram, (1 + ln(tf)) * idf AS w FROM qg JOIN d USING (gram)), qn AS (SELECT request_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
pr AS (SELECT request_id, evidence_id FROM rq JOIN e ON e.key = rq.key AND e.mid BETWEEN rq.p AND rq.q),
sc AS (SELECT pr.request_id, pr.evidence_id, round(coalesce(sum(ew.w * qw.w) / any_value(en.n) / any_value(qn.n), 0), 6) + 0.0 AS score FROM pr JOIN en USING (evidence_id) JOIN qn USING (request_id)
  LEFT JOIN ew USING (evidence_id) LEFT JOIN qw ON qw.request_id = pr.request_id AND qw.gram = ew.gram GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, evidence_id) AS INT) AS place FROM sc""")
def filtered_retrieval(inp):
    evidence = inp.monthly_obs.select(
        op.evidence_id(F.col("key"), F.col("mid")).alias("evidence_id"), "key", "mid",
        F.concat_ws(" ", "period", "key", "source_title", F.lit("official observation")).alias("text"))
    asked = inp.requests.withColumn("question", F.concat_ws(" ", "tool", "key", op.month_label(F.col("q"))))
    return op.filtered_retrieval(asked, evidence)


ANSWERS = """mm AS (SELECT r.*, unnest(CASE tool WHEN 'observation' THEN [p] WHEN 'difference' THEN [p, q] ELSE generate_series(p, q) END) AS mid FROM requests r),
an AS (SELECT mm.request_id, mm.key, mm.p, mm.q, mm.tool, count(*) AS expected, count(o.value) AS n, max(o.value) FILTER (WHERE o.mid = mm.p) AS a, max(o.value) FILTER (WHERE o.mid = mm.q) AS b, avg(o.value) AS m, max(o.value) AS h,
  string_agg('obs:' || o.key || ':' || o.period, ',' ORDER BY o.period) AS ids FROM mm LEFT JOIN monthly_obs o ON o.key = mm.key AND o.mid = mm.mid GROUP BY ALL),
ans AS (SELECT request_id, key, p, q, tool, CASE WHEN n < expected THEN 'refused' ELSE 'answered' END AS status, CASE WHEN n < expected THEN 'missing_observation' END AS reason,
  CASE WHEN n = expected THEN round(CASE tool WHEN 'observation' THEN a WHEN 'difference' THEN b - a WHEN 'mean' THEN m ELSE h END, 6) + 0.0 END AS value, CASE WHEN n = expected THEN n END AS n, CASE WHEN n = expected THEN ids END AS evidence_ids FROM an)"""


@query("batch_answers", f"WITH {ANSWERS} SELECT * FROM ans")
def batch_answers(inp):
    return op.batch_answers(inp.requests, inp.monthly_obs).withColumn("value", rounded("value", 6))


@query("task_scorecard", f"""
WITH {ANSWERS}, c AS (SELECT tool, status = 'answered' AS answerable, status = 'answered' AND p % 11 <> 4 AS answered, status = 'answered' AND p % 11 <> 4 AND p % 7 <> 3 AS number_ok, status = 'answered' AND p % 11 <> 4 AND p % 13 <> 5 AS support_ok,
  CASE WHEN status = 'answered' THEN p % 11 <> 4 AND p % 7 <> 3 AND p % 13 <> 5 ELSE p % 11 <> 4 END AS correct FROM ans)
SELECT coalesce(tool, 'ALL') AS tool, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE answerable AND answered) AS covered,
  count(*) FILTER (WHERE number_ok) AS number_ok, count(*) FILTER (WHERE support_ok) AS support_ok, round(count(*) FILTER (WHERE correct) / count(*), 6) + 0.0 AS task_rate FROM c GROUP BY ROLLUP (tool)""")
def task_scorecard(inp):
    gold = op.batch_answers(inp.requests, inp.monthly_obs)
    p = F.col("p")
    refused = p % 11 == 4
    # answers of a system that refuses some tasks for another reason and gets some numbers and evidence wrong
    answers = gold.select(
        "request_id", "tool", F.when(refused, "refused").otherwise(F.col("status")).alias("status"),
        F.when(refused, "unsupported_operation").otherwise(F.col("reason")).alias("reason"),
        F.when(~refused, F.when(p % 7 == 3, F.col("value") + 0.5).otherwise(F.col("value"))).alias("value"),
        F.when(~refused, F.when(p % 13 == 5, F.concat("evidence_ids", F.lit(","))).otherwise(F.col("evidence_ids"))).alias("evidence_ids"))
    return op.scorecard_rates(op.scorecard(answers, gold)).withColumn("task_rate", rounded("task_rate", 6))


@query("typed_claims", f"""
WITH {CHANGE}, {BT}, md AS (SELECT key, arg_min(method, mae) AS method FROM (SELECT key, method, avg(abs(error)) AS mae FROM er WHERE split = 'validation' GROUP BY ALL) GROUP BY key),
cur AS (SELECT chx.*, md.method, 'obs:' || chx.key || ':' || period AS here, 'obs:' || chx.key || ':' || CAST(CAST(floor((mid - 1) / 12) AS INT) AS VARCHAR) || '-' || lpad(CAST((mid - 1) % 12 + 1 AS VARCHAR), 2, '0') AS before FROM chx LEFT JOIN md ON md.key = chx.key
  WHERE mid = (SELECT max(mid) FROM monthly_obs m WHERE m.key = chx.key))
SELECT key, 'latest' AS claim, 'official_observation' AS kind, here AS evidence_ids, 'value=' || CAST(CAST(value AS DECIMAL(18, 3)) AS VARCHAR) AS "values" FROM cur
UNION ALL SELECT key, 'comparison', CASE WHEN previous IS NULL THEN 'unavailable' ELSE 'computed_observation' END, CASE WHEN previous IS NULL THEN here ELSE here || ',' || before END,
  'delta=' || coalesce(CAST(CAST(value - previous AS DECIMAL(18, 3)) AS VARCHAR), '') FROM cur
UNION ALL SELECT key, 'method', 'model_decision', 'model:' || key, 'default_method=' || coalesce(method, 'unavailable') FROM cur UNION ALL SELECT key, 'limits', 'limitation', 'model:' || key, 'note=revised snapshot; no causal or investment statement' FROM cur""")
def typed_claims(inp):
    changes = mo.month_change(inp.monthly_obs, mo.catalogue(inp.monthly_obs))
    errors = metrics.long_errors(backtest(inp).filter("split = 'validation'"), ["key"], ["persistence", "seasonal"])
    selected = metrics.best_method(metrics.mae_rmse(errors, ["key", "method"]), ["key"], "mae").select("key", "method")
    entry = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return op.typed_claims(inp.monthly_obs, changes, selected).select(
        "key", "claim", "kind", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join(entry, ";").alias("values"))


@query("question_answers", ANSWERS_SQL)
def question_answers(inp):
    asked = inp.asked_questions.select("question_id", F.explode(F.array("question")).alias("question"))  # written once
    found = answers.answer_questions(asked, inp.indicator_obs, inp.indicator_models)
    return found.select("question_id", "status", "reason", "key", "tool", "first_period", "last_period", rounded("value", 6).alias("value"), "n", "extreme_periods", "evidence_ids")


@query("text_fold", r"""
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents)""")
def text_fold(inp):
    """Texts whose digits, letters, ligatures and blanks stand in compatibility forms fold back to the plain ones."""
    odd = F.translate(F.replace("text", F.lit("fi"), F.lit("\ufb01")), "0123456789ABCXYZ ", "０１２３４５６７８９ＡＢＣⅩＹＺ\u00a0")
    written = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(odd)
    return inp.documents.select("doc_id", fold(written).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))
