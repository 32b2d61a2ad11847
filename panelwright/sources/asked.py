"""Questions in twelve forms about seven indicators, written from ``report_src``, with the readings and models they ask for."""

from __future__ import annotations

KEYS = ("cpi_yoy", "cpi_mom", "ppi_yoy", "ppi_mom", "manufacturing_pmi", "manufacturing_new_orders_pmi", "nonmanufacturing_pmi")
NAMES = ("CPI同比", "消费价格环比", "工业生产者出厂价格同比", "PPI环比", "制造业PMI", "制造业新订单PMI", "非制造业PMI")
_MONTH = "concat(CAST(floor(({m}) / 12) AS INT), '-', lpad(CAST(({m}) % 12 + 1 AS STRING), 2, '0'))"
FORMS = (
    "concat(name, '在', y, '年', m, '月的具体数值是多少')", "concat(name, '最新读数是多少')", "concat(name, '较上月变化')", "concat(p0, name, '与去年同月相比')",
    "concat(name, '最近', n, '个月平均')", "concat(p0, '到', p3, name, '最低')", "concat(name, '相比')", "concat(p0, '和', p3, name, '读数')",
    "concat(name, '下一期预测值')", "concat(p0, name, '回测MAE')", "concat('为什么', name, '上涨')", "concat(name, '在', y, '年13月')",
)


def asked_views() -> dict[str, str]:
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(NAMES))
    forms = " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS))
    readings = "\nUNION ALL ".join(
        f"SELECT '{key}' AS key, mid, CAST((s1 * {k + 1} + s2) % 401 AS DOUBLE) / 10 AS value FROM indicator_base WHERE mid % 11 <> {k}" for k, key in enumerate(KEYS))
    return {
        "indicator_base": "SELECT mid, CAST(sum(c1) AS BIGINT) AS s1, CAST(sum(c2) AS BIGINT) AS s2 FROM report_src GROUP BY mid",
        "indicator_obs": readings,
        "indicator_models": """SELECT key, key <> 'ppi_mom' AS evaluated, min(value) AS ridge_mae, max(value) AS persistence_mae, max(value) - min(value) AS seasonal_mae, count(*) AS test_n,
  false AS gate_passed, 'persistence' AS default_method, CAST(max(mid) + 1 AS INT) AS forecast_mid, max(value) AS reference, min(value) AS experimental FROM indicator_obs GROUP BY key""",
        "asked_questions": f"""WITH asked_names AS (SELECT doc_id, mid, y, m, CAST(s % 7 AS INT) AS k, CAST((s * 3 + mid) % {len(FORMS)} AS INT) AS form, CAST(s % 27 AS INT) AS n, CASE s % 7 {names} END AS name,
  {_MONTH.format(m="mid")} AS p0, {_MONTH.format(m="mid + 3")} AS p3 FROM report_src)
SELECT doc_id AS question_id, mid, k, form, n, CASE form {forms} END AS question FROM asked_names""",
    }


#: The answers, by the form of each question.
ANSWERS_SQL = f"""
WITH lt AS (SELECT key, CAST(max(mid) AS INT) AS latest FROM indicator_obs GROUP BY key),
fq AS (SELECT question_id, mid, form, n AS asked_n, {list(KEYS)}[k + 1] AS key FROM asked_questions),
sc AS (SELECT fq.*, latest, ['observation', 'observation', 'difference', 'difference', 'mean', 'extrema', 'difference', 'observation', 'forecast', 'evaluation', 'observation', 'observation'][form + 1] AS tool,
  CASE form WHEN 1 THEN latest WHEN 2 THEN latest - 1 WHEN 3 THEN mid - 12 WHEN 4 THEN latest - asked_n + 1 ELSE mid END AS p,
  CASE form WHEN 0 THEN mid WHEN 3 THEN mid WHEN 5 THEN mid + 3 ELSE latest END AS q,
  CASE WHEN form = 10 THEN 'unsupported_claim' WHEN form = 11 THEN 'invalid_period' WHEN form IN (6, 7) THEN 'ambiguous_period' WHEN form = 4 AND asked_n NOT BETWEEN 2 AND 24 THEN 'invalid_window'
       WHEN form = 9 AND mid <> latest THEN 'historical_model' END AS early FROM fq JOIN lt USING (key)),
ms AS (SELECT *, unnest(CASE WHEN early IS NOT NULL OR form IN (8, 9) THEN [] WHEN tool = 'difference' THEN [p, q] WHEN tool = 'observation' THEN [p] ELSE generate_series(p, q) END) AS month FROM sc),
vs AS (SELECT ms.question_id, month, value, floor(month / 12)::INT || '-' || lpad((month % 12 + 1)::INT::VARCHAR, 2, '0') AS label FROM ms LEFT JOIN indicator_obs o ON o.key = ms.key AND o.mid = month),
ag AS (SELECT question_id, count(*) AS expected, count(value) AS n, arg_min(value, month) AS a, arg_max(value, month) AS b, avg(value) AS mean, min(value) AS low, string_agg(label, ',' ORDER BY month) AS labels FROM vs GROUP BY 1),
tie AS (SELECT question_id, string_agg(label, ',' ORDER BY month) AS labels FROM vs JOIN ag USING (question_id) WHERE value = low GROUP BY 1),
fin AS (SELECT sc.*, ag.n, a, b, mean, low, ag.labels, tie.labels AS ties, ridge_mae, experimental, test_n,
  coalesce(early, CASE WHEN form IN (8, 9) THEN CASE WHEN NOT evaluated THEN 'insufficient_model' END WHEN ag.n < expected THEN 'missing_observation' END) AS reason
  FROM sc LEFT JOIN ag USING (question_id) LEFT JOIN tie USING (question_id) LEFT JOIN indicator_models im ON im.key = sc.key)
SELECT question_id, CASE WHEN reason IS NULL THEN 'answered' WHEN reason = 'ambiguous_period' THEN 'clarify' ELSE 'refused' END AS status, reason, key, tool,
  CASE WHEN reason IS NULL AND form NOT IN (8, 9) THEN floor(p / 12)::INT || '-' || lpad((p % 12 + 1)::INT::VARCHAR, 2, '0') END AS first_period,
  CASE WHEN reason IS NULL AND form NOT IN (8, 9) THEN CASE WHEN tool = 'observation' THEN floor(p / 12)::INT || '-' || lpad((p % 12 + 1)::INT::VARCHAR, 2, '0') ELSE floor(q / 12)::INT || '-' || lpad((q % 12 + 1)::INT::VARCHAR, 2, '0') END END AS last_period,
  CASE WHEN reason IS NULL THEN round(CASE tool WHEN 'observation' THEN a WHEN 'difference' THEN b - a WHEN 'mean' THEN mean WHEN 'extrema' THEN low WHEN 'forecast' THEN experimental ELSE ridge_mae END, 6) + 0.0 END AS value,
  CASE WHEN reason IS NULL THEN CASE WHEN form = 9 THEN test_n WHEN form <> 8 THEN n END END AS n,
  CASE WHEN reason IS NULL AND tool = 'extrema' THEN ties END AS extreme_periods,
  CASE WHEN reason IS NULL THEN CASE WHEN form IN (8, 9) THEN 'model:' || key ELSE 'obs:' || key || ':' || replace(labels, ',', ',obs:' || key || ':') END END AS evidence_ids FROM fin"""
