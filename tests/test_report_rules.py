"""Wordings of official reports against the facts a reader takes from them."""

from __future__ import annotations

import pytest

from panelwright.operators.extract import plain_text, report_type, title_period
from panelwright.operators.report_rules import LIMITS, report_facts, rule_table
from pyspark.sql import functions as F

OVERVIEW = "国民经济运行情况"
FISCAL_TITLE = "2025年前三季度财政收支情况"
# (title, period, text, facts)
GOLD = [
    ("2021年9月份规模以上工业增加值增长3.1%", "2021-09", "9月份，规模以上工业增加值同比实际增长3.1%。", {"industrial_yoy": 3.1}),
    ("2025年全国固定资产投资基本情况", "2025-12", "2025年，全国固定资产投资（不含农户）485186亿元，比上年下降3.8%（详见附注7）。其中，民间固定资产投资比上年下降6.4%。制造业投资增长0.6%。"
     "基础设施投资（不含电力、热力、燃气及水生产和供应业）比上年下降2.2%。",
     {"fai_ytd_yoy": -3.8, "private_fai_ytd_yoy": -6.4, "manufacturing_fai_ytd_yoy": 0.6, "infrastructure_ex_utilities_ytd_yoy": -2.2}),
    ("2021年全国房地产开发投资增长4.4%", "2021-12", "2021年，全国房地产开发投资147602亿元，比上年增长4.4%。2021年，商品房销售面积179433万平方米，比上年增长1.9%。",
     {"real_estate_fai_ytd_yoy": 4.4, "housing_sales_area_ytd_yoy": 1.9}),
    ("2024年全国固定资产投资增长3.2%", "2024-12", "2024年，全国固定资产投资（不含农户）514374亿元，比上年增长3.2%。其中，民间固定资产投资257574亿元，下降0.1%。",
     {"fai_ytd_yoy": 3.2, "private_fai_ytd_yoy": -0.1}),
    ("2023年1—6月份全国固定资产投资基本情况", "2023-06", "1—6月份，全国固定资产投资（不含农户）243113亿元，同比增长3.8%。民间固定资产投资128570亿元，下降0.2%。制造业投资增长6.0%。",
     {"fai_ytd_yoy": 3.8, "private_fai_ytd_yoy": -0.2, "manufacturing_fai_ytd_yoy": 6.0}),
    ("2023年1—6月份全国房地产市场基本情况", "2023-06", "1—6月份，全国房地产开发投资58550亿元，同比下降7.9%。商品房销售面积59515万平方米，同比下降5.3%。",
     {"real_estate_fai_ytd_yoy": -7.9, "housing_sales_area_ytd_yoy": -5.3}),
    ("2025年1—2月份全国固定资产投资基本情况", "2025-02", "1—2月份，民间固定资产投资26717亿元，总量与去年同期基本持平。其中：民间投资0.0按构成分，制造业投资增长1.2%。",
     {"private_fai_ytd_yoy": 0.0, "manufacturing_fai_ytd_yoy": 1.2}),
    ("2025年1—2月份全国固定资产投资基本情况", "2025-02", "1—2月份，民间固定资产投资26717亿元，总量与去年同期基本持平。制造业投资增长1.2%。", {"manufacturing_fai_ytd_yoy": 1.2}),
    ("2023年全国固定资产投资增长3.0%", "2023-12", "2023年，全国固定资产投资（不含农户）503036亿元，比上年增长3.0%。其中，制造业投资增长6.5%；"
     "基础设施投资（不含电力、热力、燃气及水生产和供应业）增长5.9%。", {"fai_ytd_yoy": 3.0, "manufacturing_fai_ytd_yoy": 6.5, "infrastructure_ex_utilities_ytd_yoy": 5.9}),
    ("2026年8月份" + OVERVIEW, "2026-08", "1—8月份，社会消费品零售总额327569亿元，同比增长1.1%。8月份，社会消费品零售总额39824亿元，同比增长0.4%。", {"retail_yoy": 0.4}),
    ("一季度国民经济开局良好", "2025-03", "一季度，货物进出口总额103013亿元，同比增长1.3%。其中，出口61314亿元，增长6.9%；进口41700亿元，下降6.0%。"
     "3月份，进出口总额37663亿元，同比增长6.0%。其中，出口22515亿元，增长13.5%；进口15148亿元，下降3.5%。", {"export_yoy": 13.5, "import_yoy": -3.5}),
    ("1—2月份国民经济恢复好于预期", "2022-02", "1—2月份，货物进出口总额62044亿元，同比增长13.3%。其中，出口34716亿元，增长13.6%；进口27328亿元，增长12.9%。", {}),
    ("上半年国民经济企稳回升", "2022-06", "4月份，全国城镇调查失业率为6.1%；5、6月份连续回落，分别为5.9%、5.5%。6月份，本地户籍人口调查失业率为5.3%。", {"unemployment": 5.5}),
    ("1—7月份国民经济运行", "2026-07", "1—7月份，全国工业生产者出厂价格同比上涨1.8%。其中，7月份同比上涨3.5%，环比下降0.7%。", {"ppi_yoy": 3.5}),
    ("2026年上半年金融统计数据报告", "2026-06", "6月末，广义货币(M2)余额356.71万亿元,同比增长8%。狭义货币(M1)余额118.48万亿元,同比增长4%。", {"m1_yoy": 4.0, "m2_yoy": 8.0}),
    ("2024年6月金融统计数据报告", "2024-06", "狭义货币（M1）余额66.06万亿元，同比下降5%。上半年人民币贷款增加13.27万亿元。前6个月，人民币贷款累计增加132700亿元。注：前5个月人民币贷款增加1万亿元。",
     {"m1_legacy_yoy": -5.0, "loans_ytd": 13.27}),
    ("2026年1—8月份全国固定资产投资基本情况", "2026-08", "1—8月份，全国固定资产投资（不含农户）293092亿元，同比下降7.2%。工业投资同比下降2.9%。其中，制造业投资下降2.3%。"
     "基础设施投资（口径详见附注1）同比下降4.0%。1—8月份，民间固定资产投资同比下降10.1%。",
     {"fai_ytd_yoy": -7.2, "private_fai_ytd_yoy": -10.1, "manufacturing_fai_ytd_yoy": -2.3, "infrastructure_fai_ytd_yoy": -4.0}),
    ("2025年1—9月份全国固定资产投资基本情况", "2025-09", "1—9月份，全国固定资产投资（不含农户）371535亿元，同比下降0.5%。基础设施投资（不含电力、热力、燃气及水生产和供应业）同比增长1.1%。",
     {"fai_ytd_yoy": -0.5, "infrastructure_ex_utilities_ytd_yoy": 1.1}),
    ("2026年8月中国采购经理指数运行情况", "2026-08", "8月份，制造业采购经理指数（PMI）为49.8%。新订单指数为50.6%。8月份，非制造业商务活动指数为49.0%。",
     {"manufacturing_pmi": 49.8, "manufacturing_new_orders_pmi": 50.6, "nonmanufacturing_pmi": 49.0}),
    ("2021年10月中国采购经理指数运行情况", "2021-10", "10月份，中国制造业采购经理指数（PMI）为49.2%。新订单指数为48.8%。10月份，非制造业商务活动指数为52.4%。",
     {"manufacturing_pmi": 49.2, "manufacturing_new_orders_pmi": 48.8, "nonmanufacturing_pmi": 52.4}),
    ("2026年8月份居民消费价格同比上涨0.8%", "2026-08", "8月份，全国居民消费价格同比上涨0.8%。8月份，全国居民消费价格环比上涨0.4%。其中，食品价格环比下降1.4%。", {"cpi_yoy": 0.8, "cpi_mom": 0.4}),
    ("2026年8月份工业生产者出厂价格同比上涨3.8%", "2026-08", "8月份，全国工业生产者出厂价格同比上涨3.8%，环比上涨0.4%。工业生产者购进价格同比上涨5.8%，环比上涨0.3%。", {"ppi_yoy": 3.8, "ppi_mom": 0.4}),
    ("2023年6月份居民消费价格同比持平", "2023-06", "6月份，全国居民消费价格同比持平。6月份，全国居民消费价格环比持平。", {"cpi_yoy": 0.0, "cpi_mom": 0.0}),
    ("2023年6月份工业生产者出厂价格同比下降5.4%", "2023-06", "6月份，全国工业生产者出厂价格同比下降5.4%。工业生产者购进价格环比下降1.1%。", {"ppi_yoy": -5.4}),
    ("2023年5月份工业生产者出厂价格同比下降4.6%", "2023-05", "6月份，全国工业生产者出厂价格同比下降5.4%。", {}),
    ("2024年1—3月份规模以上工业企业利润增长", "2024-03", "1—3月份，全国规模以上工业企业实现利润总额15055亿元，同比增长4.3%。", {"industrial_profit_ytd_yoy": 4.3}),
    (FISCAL_TITLE, "2025-09", "全国一般公共预算收入163876亿元，同比增长0.5%。其中，全国税收收入132664亿元，比上年同期增长0.7%。全国一般公共预算支出208064亿元，比上年微增3.1%。"
     "全国政府性基金预算收入30706亿元，与去年同期持平，国有土地使用权出让收入22000亿元，同比增长5%，按自然口径计算下降4.2%。",
     {"fiscal_revenue_ytd": 163876, "fiscal_revenue_ytd_yoy": 0.5, "tax_revenue_ytd": 132664, "tax_revenue_ytd_yoy": 0.7, "fiscal_spending_ytd": 208064,
      "fiscal_spending_ytd_yoy": 3.1, "fund_revenue_ytd": 30706, "fund_revenue_ytd_yoy": 0.0, "land_revenue_ytd": 22000, "land_revenue_ytd_yoy": -4.2}),
]


def found(spark, cases):
    rows = [(k, title, None if period is None else int(period[:4]) * 12 + int(period[5:]) - 1, text) for k, (title, period, text) in enumerate(cases)]
    reports = spark.createDataFrame(rows, "report_id long, title string, period int, text string")
    return report_facts(reports.select("*", report_type(F.col("title")).alias("kind"))).collect()


def test_gold_wordings(spark):
    rows = found(spark, [case[:3] for case in GOLD])
    assert {r.status for r in rows} == {"ok"}
    for k, (*_, expected) in enumerate(GOLD):
        assert {r.key: r.value for r in rows if r.report_id == k} == expected, GOLD[k]


@pytest.mark.parametrize("text, expected", [
    ("工业生产者出厂价格同比下降0.8%，环比由上月上涨0.2%转为下降0.2%；工业生产者购进价格环比上涨0.1%。", -0.2),
    ("工业生产者出厂价格和购进价格环比分别下降0.2%、0.3%。", -0.2),
    ("工业生产者出厂价格同比下降2.9%。工业生产者出厂价格环比继续持平。工业生产者购进价格环比上涨0.1%。", 0.0),
    ("工业生产者出厂价格同比下降2.1%；环比由上月持平转为上涨0.1%。", 0.1),
    ("工业生产者出厂价格同比下降2.2%；工业生产者出厂价格和购进价格环比均上涨0.1%。", 0.1),
])
def test_month_rates_after_turns(spark, text, expected):
    rows = found(spark, [("2024年1月份工业生产者出厂价格", "2024-01", text)])
    assert [r.value for r in rows if r.key == "ppi_mom"] == [expected]


def test_refusals(spark):
    fiscal = "全国一般公共预算收入100亿元，同比增长1%。税收收入{}亿元。全国一般公共预算支出90亿元。{}国有土地使用权出让收入50亿元。"
    rows = found(spark, [
        (FISCAL_TITLE, "2025-09", fiscal.format(110, "全国政府性基金预算收入60亿元。")), (FISCAL_TITLE, "2025-09", fiscal.format(90, "全国政府性基金预算收入40亿元。")),
        (FISCAL_TITLE, "2025-09", fiscal.format(90, "")), (FISCAL_TITLE, "2025-09", "全国一般公共预算收入100亿元。"),
        ("2025年3月金融统计数据报告", "2025-03", "一季度人民币贷款增加9.78万亿元。前三个月人民币贷款累计增加9.8万亿元。"),
        ("2025年3月金融统计数据报告", "2025-03", "一季度人民币贷款增加978万亿元。"), ("2025年3月金融统计数据报告", "2025-03", None), ("2025年3月金融统计数据报告", None, "同比")])
    by = {k: {r.key: (r.value, r.status) for r in rows if r.report_id == k} for k in range(8)}
    assert {s for _, s in by[0].values()} == {s for _, s in by[1].values()} == {"part exceeds whole"}
    assert {s for _, s in by[2].values()} == {"ok"} and {s for _, s in by[3].values()} == {"incomplete"}
    assert by[4] == {"loans_ytd": (None, "conflict")} and by[5] == {"loans_ytd": (978.0, "out of range")} and by[6] == by[7] == {}


def test_every_key_has_limits(spark):
    keys = {r.key for r in rule_table(spark).select("key").distinct().collect()} | {"ppi_mom", "loans_ytd", "m1_legacy_yoy"}
    assert keys <= set(LIMITS) and len(LIMITS) == 39


def test_text_of_a_page_gives_the_same(spark):
    title, period, text, expected = GOLD[1]
    page = spark.createDataFrame([("<div>" + text.replace("，", "， \n") + "</div>",)], "html string")
    rows = found(spark, [(title, period, page.select(plain_text(F.col("html"))).first()[0])])
    assert {r.key: r.value for r in rows} == expected


def test_period_from_the_address(spark):
    cases = [("12月份居民消费价格变动情况", "", "https://x.example/sj/202401/t1.html", "2023-12"), ("3月份居民消费价格变动情况", "", "https://x.example/202404/t1.html", "2024-03"),
             ("3月份居民消费价格变动情况", "2022-04-11", "https://x.example/202404/t1.html", "2022-03"), ("2021年5月份情况", "", "https://x.example/202404/t1.html", "2021-05"),
             ("5月份情况", "", "https://x.example/t1.html", None), ("公报", "", "https://x.example/202404/t1.html", None)]
    frame = spark.createDataFrame([c[:3] for c in cases], "title string, published string, url string")
    got = [r[0] for r in frame.select(title_period(F.col("title"), F.col("published"), F.col("url"))).collect()]
    assert got == [c[3] for c in cases]
