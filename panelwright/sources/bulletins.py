"""Reports of every kind written from the numbers of ``report_src``, and the facts that must be read back from them."""

from __future__ import annotations

import re

# one report a row: (report type, title, text, {key: number it states}). {+c} is a signed change, {=c} one that may be flat, {.u} a level,
# {y} and {m} year and month. Decoys state the same series of another month, period or scope.
BULLETINS = (
    ("overview", "{m}月份国民经济运行情况", "1—{m}月份，全国规模以上工业增加值同比增长9.9%。{m}月份，全国规模以上工业增加值同比{+c1}。{m}月份，全国居民消费价格（CPI）同比{+c2}。"
     "{m}月份，全国城镇调查失业率为{.u}%。1—{m}月份，货物进出口总额9亿元，同比增长9%。其中，出口5亿元，增长9%；进口4亿元，下降9%。"
     "{m}月份，进出口总额9亿元，同比增长9%。其中，出口5亿元，{+c2}；进口4亿元，{+c3}。附表：{m}月份，社会消费品零售总额7亿元，同比增长7%。",
     {"industrial_yoy": "c1", "cpi_yoy": "c2", "unemployment": "u", "export_yoy": "c2", "import_yoy": "c3"}),
    ("industry", "{y}年{m}月份规模以上工业增加值增长", "1—{m}月份，规模以上工业增加值同比增长9.9%。{m}月份，规模以上工业增加值同比实际{+c2}。", {"industrial_yoy": "c2"}),
    ("retail", "{y}年{m}月份社会消费品零售总额增长", "{m}月份，社会消费品零售总额{amt}亿元，同比{=c1}。", {"retail_yoy": "c1"}),
    ("investment", "{y}年1—{m}月份全国固定资产投资基本情况", "1—{m}月份，全国固定资产投资（不含农户）{amt}亿元，同比{=c1}。民间固定资产投资同比{+c2}。制造业投资{+c3}。"
     "基础设施投资（不含电力、热力、燃气及水生产和供应业）同比{+c2}。",
     {"fai_ytd_yoy": "c1", "private_fai_ytd_yoy": "c2", "manufacturing_fai_ytd_yoy": "c3", "infrastructure_ex_utilities_ytd_yoy": "c2"}),
    ("estate", "{y}年1—{m}月份全国房地产市场基本情况", "1—{m}月份，全国房地产开发投资{amt}亿元，同比{=c3}。新建商品房销售面积{amt}万平方米，同比{+c1}。",
     {"real_estate_fai_ytd_yoy": "c3", "housing_sales_area_ytd_yoy": "c1"}),
    ("cpi", "{y}年{m}月份居民消费价格变动", "{m}月份，全国居民消费价格同比{=c2}。{m}月份，全国居民消费价格环比{=c3}。其中，食品价格环比下降1.4%。", {"cpi_yoy": "c2", "cpi_mom": "c3"}),
    ("ppi", "{y}年{m}月份工业生产者出厂价格变动", "{m}月份，全国工业生产者出厂价格同比{=c1}，环比由上月上涨0.2%转为{=c3}。工业生产者购进价格环比上涨8.8%。",
     {"ppi_yoy": "c1", "ppi_mom": "c3"}),
    ("profit", "{y}年1—{m}月份规模以上工业企业利润增长", "1—{m}月份，全国规模以上工业企业实现利润总额{amt}亿元，同比{=c1}。", {"industrial_profit_ytd_yoy": "c1"}),
    ("pmi", "{y}年{m}月中国采购经理指数运行情况", "{m}月份，中国制造业采购经理指数（PMI）为4{.u}%。新订单指数为5{.u}%。{m}月份，非制造业商务活动指数为3{.u}%。",
     {"manufacturing_pmi": "u + 400", "manufacturing_new_orders_pmi": "u + 500", "nonmanufacturing_pmi": "u + 300"}),
    ("annual", "20{m2}年全国房地产开发投资增长", "{y}年，全国房地产开发投资{amt}亿元，比上年{+c3}。{y}年，商品房销售面积{amt}万平方米，比上年{+c2}。",
     {"real_estate_fai_ytd_yoy": "c3", "housing_sales_area_ytd_yoy": "c2"}),
    ("money", "{y}年{m}月金融统计数据报告", "广义货币（M2）余额{amt}万亿元，同比{+c1}。狭义货币(M1)余额{amt}万亿元,同比{+c2}。社会融资规模存量为{amt}万亿元，同比{+c3}。前{m}个月，人民币贷款增加{.u}万亿元。",
     {"m2_yoy": "c1", "m1_legacy_yoy": "c2", "tsf_stock_yoy": "c3", "loans_ytd": "u"}),
    ("fiscal", "20{m2}年一季度财政收支情况", "全国一般公共预算收入{amt}亿元，同比{+c2}。全国税收收入1亿元，与上年同期持平。全国一般公共预算支出{amt}亿元，同比增长9.9%，按自然口径计算{+c3}。",
     {"fiscal_revenue_ytd_yoy": "c2", "tax_revenue_ytd_yoy": "0", "fiscal_spending_ytd_yoy": "c3"}),
)


def _text(template: str) -> str:
    """SQL text of a template over the prepared columns of ``bulletin_sql``."""
    parts = []
    for token in re.split(r"(\{[^}]*\})", template):
        name = token[1:-1]
        if token.startswith("{"):
            parts.append({"+": f"change_{name[1:]}", "=": f"flat_{name[1:]}", ".": f"digits_{name[1:]}"}.get(name[0], name))
        elif token:
            parts.append(f"'{token}'")
    return f"concat({', '.join(parts)})"


def bulletin_sql() -> str:
    digits = [f"concat(CAST(floor(abs({c}) / 10) AS INT), '.', abs({c}) % 10) AS digits_{c}" for c in ("c1", "c2", "c3", "u")]
    changes = [f"concat(CASE WHEN {c} < 0 THEN '下降' ELSE '增长' END, digits_{c}, '%') AS change_{c}" for c in ("c1", "c2", "c3")]
    flat = [f"CASE WHEN {c} = 0 THEN '持平' ELSE change_{c} END AS flat_{c}" for c in ("c1", "c2", "c3")]
    case = lambda column: " ".join(f"WHEN {k} THEN {_text(b[column])}" for k, b in enumerate(BULLETINS))
    return f"""WITH bulletin_digits AS (SELECT *, (s + mid) % {len(BULLETINS)} AS form_no, lpad(CAST(m AS STRING), 2, '0') AS m2, {", ".join(digits)} FROM report_src),
bulletin_changes AS (SELECT *, {", ".join(changes)} FROM bulletin_digits), bulletin_flat AS (SELECT *, {", ".join(flat)} FROM bulletin_changes)
SELECT doc_id, mid, CASE form_no {case(1)} END AS title, concat('<div class="content">', CASE form_no {case(2)} END, '</div>') AS html FROM bulletin_flat"""


def facts_sql(limits: dict[str, tuple[float, float]]) -> str:
    """SQL of the facts: values as stated, their status by the limits, annual reports in December only."""
    rows = []
    for k, (kind, _, _, facts) in enumerate(BULLETINS):
        kinds = {"annual": "annual estate"}.get(kind, kind)
        when = f"(s + mid) % {len(BULLETINS)} = {k}" + (" AND m = 12" if kind == "annual" else "")
        stated = {key: f"({source}) / 10.0" for key, source in facts.items()}
        refused = "false"
        if kind == "fiscal":
            stated |= {"fiscal_revenue_ytd": "amt", "fiscal_spending_ytd": "amt", "tax_revenue_ytd": "1"}
            refused = "amt < 1"
        for key, source in stated.items():
            low, high = limits[key]
            rows.append(f"SELECT doc_id AS report_id, '{kinds}' AS kind, '{key}' AS key, mid AS period, CAST(round({source}, 3) AS DOUBLE) + 0.0 AS value, "
                        f"CASE WHEN {refused} THEN 'part exceeds whole' WHEN {source} BETWEEN {low} AND {high} THEN 'ok' ELSE 'out of range' END AS status FROM report_src WHERE {when}")
    return "\nUNION ALL ".join(rows)
