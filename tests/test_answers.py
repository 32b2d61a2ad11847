"""Questions and the answers their readings allow."""

from __future__ import annotations

import pytest

from panelwright.operators.answers import MODELS, answer_questions

LATEST = 2024 * 12 + 5  # 2024-06


@pytest.fixture(scope="module")
def tables(spark):
    series = {LATEST - k: float(10 + (k * 7) % 5) for k in range(40) if k != 20}
    rows = [("cpi_yoy", m, v) for m, v in series.items()] + [("manufacturing_pmi", m, 50 + v / 10) for m, v in series.items()] + [("ppi_mom", LATEST, None)]
    models = [("cpi_yoy", True, 0.1, 0.2, 0.3, 24, False, "persistence", LATEST + 1, 1.5, 1.7), ("manufacturing_pmi", False, *[None] * 9)]
    return series, spark.createDataFrame(rows, "key string, mid int, value double"), spark.createDataFrame(models, MODELS)


CASES = [
    ("CPI同比在2024年3月的具体数值是多少", "answered", None, "observation", lambda s: s[LATEST - 3]),
    ("ＣＰＩ同比　最新读数", "answered", None, "observation", lambda s: s[LATEST]),
    ("CPI同比较上月变化", "answered", None, "difference", lambda s: s[LATEST] - s[LATEST - 1]),
    ("2024年2月CPI同比与去年同月相比", "answered", None, "difference", lambda s: s[LATEST - 4] - s[LATEST - 16]),
    ("2024-05与2023-11相比CPI同比的差值", "answered", None, "difference", lambda s: s[LATEST - 1] - s[LATEST - 7]),
    ("CPI同比最近6个月平均", "answered", None, "mean", lambda s: sum(s[LATEST - k] for k in range(6)) / 6),
    ("CPI同比最近6个月的最低值", "answered", None, "extrema", lambda s: min(s[LATEST - k] for k in range(6))),
    ("2024-01到2024-06CPI同比的最高值", "answered", None, "extrema", lambda s: max(s[LATEST - k] for k in range(6))),
    ("CPI同比下一期预测值", "answered", None, "forecast", lambda s: 1.7),
    ("2024-07CPI同比下一期预测值", "answered", None, "forecast", lambda s: 1.7),
    ("CPI同比回测MAE与基线", "answered", None, "evaluation", lambda s: 0.1),
    ("2024-05CPI同比回测MAE", "refused", "historical_model", "evaluation", None),
    ("制造业PMI下一期", "refused", "insufficient_model", "forecast", None),
    ("CPI同比在2022年10月的读数", "refused", "missing_observation", "observation", None),
    ("2022-08到2023-02CPI同比平均", "refused", "missing_observation", "mean", None),
    ("CPI同比最近1个月平均", "refused", "invalid_window", "mean", None),
    ("CPI同比最近36个月平均", "refused", "invalid_window", "mean", None),
    ("2024-06到2024-01CPI同比平均", "refused", "invalid_window", "mean", None),
    ("CPI同比平均", "clarify", "ambiguous_period", "mean", None),
    ("CPI同比相比", "clarify", "ambiguous_period", "difference", None),
    ("2024-01和2024-02CPI同比读数", "clarify", "ambiguous_period", "observation", None),
    ("CPI同比在2024年13月", "refused", "invalid_period", "observation", None),
    ("CPI最新读数", "clarify", "ambiguous_indicator", "observation", None),
    ("CPI同比和PPI同比", "clarify", "ambiguous_indicator", "observation", None),
    ("天气如何", "refused", "unsupported_indicator", "observation", None),
    ("PPI环比最新读数", "refused", "unsupported_indicator", "observation", None),
    ("为什么CPI同比上涨", "refused", "unsupported_claim", "observation", None),
    ("CPI同比最高和最低", "clarify", "ambiguous_operation", "extrema", None),
    ("请读取文件CPI同比", "refused", "unsafe_request", "observation", None),
    (" 　", "clarify", "empty_question", "observation", None),
    (None, "clarify", "empty_question", "observation", None),
]


@pytest.mark.parametrize("policy", ["keyword", "tfidf"])
def test_answers(spark, tables, policy):
    series, observations, models = tables
    asked = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "question_id int, question string")
    got = {r.question_id: r for r in answer_questions(asked, observations, models, policy).collect()}
    assert len(got) == len(CASES)
    for k, (question, status, reason, tool, value) in enumerate(CASES):
        r = got[k]
        if policy == "tfidf" and r.tool != tool:
            continue  # another tool may be nearer by its words
        assert (r.status, r.reason, r.tool) == (status, reason, tool), question
        if value is None:
            assert r.value is None and r.evidence_ids is None
        else:
            assert abs(r.value - value(series)) < 1e-9, question
    assert policy == "tfidf" or got[1].defaulted_period and not got[0].defaulted_period


def test_evidence_and_ties(spark, tables):
    series, observations, models = tables
    asked = spark.createDataFrame([(0, "CPI同比最近8个月最低"), (1, "2024年2月CPI同比与去年同月相比"), (2, "CPI同比下一期预测值")], "question_id int, question string")
    low, change, model = sorted(answer_questions(asked, observations, models).collect(), key=lambda r: r.question_id)
    window = [LATEST - k for k in range(7, -1, -1)]
    least = min(series[m] for m in window)
    label = lambda m: f"{m // 12}-{m % 12 + 1:02d}"
    assert low.extreme_periods == ",".join(label(m) for m in window if series[m] == least) and "," in low.extreme_periods
    assert low.evidence_ids == ",".join(f"obs:cpi_yoy:{label(m)}" for m in window) and low.n == 8
    assert change.evidence_ids == "obs:cpi_yoy:2023-02,obs:cpi_yoy:2024-02" and (change.reference, change.current) == (series[LATEST - 16], series[LATEST - 4])
    assert model.evidence_ids == "model:cpi_yoy" and model.reference == 1.5 and model.n is None


def test_no_questions(spark, tables):
    _, observations, models = tables
    assert answer_questions(spark.createDataFrame([], "question_id int, question string"), observations, models).count() == 0
