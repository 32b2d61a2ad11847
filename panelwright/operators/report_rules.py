"""Facts of official reports by a table of rules: kind of report, key, wording and reading.

A rule meets only the reports of its kinds. The month of the report is put into the wording, so a sentence about another month
or a cumulative period cannot match. Patterns are columns: all rules run in one pass over the texts, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators.extract import DOWN, scoped_month_change

# A change, an amount, and how a reading continues a wording: (pattern, group of the direction, group of the number);
# without groups the value is zero.
CHANGE = r"(增长|上涨|下降|下跌|减少)(\d+(?:\.\d+)?)%"
NUMBER = r"\d+(?:\.\d+)?"
READINGS: dict[str, tuple[tuple[str, int, int], ...]] = {
    "monthly": ((r"同比" + CHANGE, 1, 2),),
    "yearly": ((r"(?:同比|比上年同期)(?:实际)?" + CHANGE, 1, 2), (r"(?:同比|与上年同期)持平", 0, 0)),
    "in context": ((r"(?:同比)?" + CHANGE, 1, 2),),
    "direct": ((CHANGE, 1, 2), (r"(?:基本)?持平", 0, 0)),
    "annual": ((r"(?:比上年|同比)" + CHANGE, 1, 2),),
    "annual in context": ((r"(?:比上年|同比)?" + CHANGE, 1, 2),),
    "level": ((r"(\d+(?:\.\d+)?)%", 0, 1),),
    "amount": ((r"(\d+(?:\.\d+)?)亿元", 0, 1),),
    "first": (("", 1, 2),), "second": (("", 3, 4),), "number": (("", 0, 1),), "none": (("", 0, 0),),
}

# Wordings. {m} is the month of the report, {month} and {bare} that month and not the end of a range.
MONTH, BARE = r"(?<![0-9—－-]){m}月份", r"(?<![0-9—－-]){m}月份?"
FIXED = r"全国固定资产投资（不含农户）"
POWER = r"基础设施投资（不含电力、热力、燃气及水生产和供应业）"
PRIVATE = r"民间固定资产投资(?:\d+(?:\.\d+)?亿元)?[，,]?"
TRADE = (r"[，,]?(?:货物)?进出口总额\d+(?:\.\d+)?亿元.{0,130}?其中[，,]?出口\d+(?:\.\d+)?亿元[，,]?(?:同比)?(增长|下降|上涨|下跌|减少)(\d+(?:\.\d+)?)%"
         r"[^。]{0,80}?[；;，,]进口\d+(?:\.\d+)?亿元[，,]?(?:同比)?(增长|下降|上涨|下跌|减少)(\d+(?:\.\d+)?)%")
PAIRED_RATES = r"全国城镇调查失业率为\d+(?:\.\d+)?%；\d+、" + MONTH + r"(?:连续)?(?:回落|上升|下降)，分别为\d+(?:\.\d+)?%、(\d+(?:\.\d+)?)%"
CUMULATED_FIRST = r"全国工业生产者出厂价格同比(?:增长|上涨|下降)\d+(?:\.\d+)?%。其中，" + MONTH + r"同比(增长|上涨|下降)(\d+(?:\.\d+)?)%"
# Fixed values: (kind of report, key, wording, reading); of several rules for a key the first that matches counts.
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("overview", "industrial_yoy", MONTH + r"，?全国规模以上工业增加值", "monthly"),
    ("overview", "retail_yoy", MONTH + r"，?社会消费品零售总额\d+(?:\.\d+)?亿元[，,]", "monthly"),
    ("overview", "cpi_yoy", MONTH + r"，?全国居民消费价格(?:（CPI）)?", "monthly"),
    ("overview", "ppi_yoy", MONTH + r"，?全国工业生产者出厂价格", "monthly"),
    ("overview", "ppi_yoy", CUMULATED_FIRST, "first"),
    ("overview", "export_yoy", MONTH + TRADE, "first"),
    ("overview", "import_yoy", MONTH + TRADE, "second"),
    ("overview", "fai_ytd_yoy", FIXED + r"\d+(?:\.\d+)?亿元，同比(增长|下降)(\d+(?:\.\d+)?)%", "first"),
    ("overview", "unemployment", MONTH + r"，?全国城镇调查失业率为", "level"),
    ("overview", "unemployment", PAIRED_RATES, "number"),
    ("overview", "manufacturing_pmi", MONTH + r"，?制造业采购经理指数为", "level"),
    ("industry", "industrial_yoy", BARE + r"，?规模以上工业增加值", "yearly"),
    ("retail", "retail_yoy", BARE + r"，?社会消费品零售总额\d+(?:\.\d+)?亿元[，,]", "yearly"),
    ("investment", "fai_ytd_yoy", FIXED + r"\d+(?:\.\d+)?亿元[，,]", "yearly"),
    ("investment", "private_fai_ytd_yoy", PRIVATE, "in context"),
    ("investment", "private_fai_ytd_yoy", r"(?=.*(?:其中：)?民间投资0(?:\.0+)?(?:按构成分|分产业看)).*" + PRIVATE + r"(?:总量)?与去年同期(?:基本)?持平", "none"),
    ("investment", "manufacturing_fai_ytd_yoy", r"制造业投资", "in context"),
    ("investment", "infrastructure_fai_ytd_yoy", r"基础设施投资（口径详见附注\d+）", "yearly"),
    ("investment", "infrastructure_ex_utilities_ytd_yoy", POWER, "in context"),
    ("estate", "real_estate_fai_ytd_yoy", r"全国房地产开发投资\d+(?:\.\d+)?亿元[，,]", "yearly"),
    ("estate", "housing_sales_area_ytd_yoy", r"(?:新建)?商品房销售面积\d+(?:\.\d+)?万平方米[，,]?", "in context"),
    ("cpi", "cpi_yoy", BARE + r"，?全国居民消费价格", "yearly"),
    ("cpi", "cpi_mom", BARE + r"，?全国居民消费价格环比", "direct"),
    ("ppi", "ppi_yoy", BARE + r"，?全国工业生产者出厂价格", "yearly"),
    ("profit", "industrial_profit_ytd_yoy", r"全国规模以上工业企业实现利润总额\d+(?:\.\d+)?亿元[，,]", "yearly"),
    ("pmi", "manufacturing_pmi", BARE + r"，?(?:中国)?制造业采购经理指数(?:（PMI）)?为", "level"),
    ("pmi", "manufacturing_new_orders_pmi", r"新订单指数为", "level"),
    ("pmi", "nonmanufacturing_pmi", BARE + r"，?非制造业商务活动指数为", "level"),
    ("annual investment", "fai_ytd_yoy", FIXED + r"\d+(?:\.\d+)?亿元[，,]", "annual"),
    ("annual investment", "private_fai_ytd_yoy", r"民间固定资产投资(?:\d+(?:\.\d+)?亿元[，,]?)?", "annual in context"),
    ("annual investment", "manufacturing_fai_ytd_yoy", r"制造业投资", "annual in context"),
    ("annual investment", "infrastructure_ex_utilities_ytd_yoy", POWER, "annual in context"),
    ("annual estate", "real_estate_fai_ytd_yoy", r"全国房地产开发投资\d+(?:\.\d+)?亿元[，,]", "annual"),
    ("annual estate", "housing_sales_area_ytd_yoy", r"(?:新建)?商品房销售面积\d+(?:\.\d+)?万平方米[，,]", "annual"),
    ("annual profit", "industrial_profit_ytd_yoy", r"全国规模以上工业企业实现利润总额\d+(?:\.\d+)?亿元[，,]", "annual"),
    ("money", "m1_yoy", r"狭义货币[（(]M1[）)]余额\d+(?:\.\d+)?万亿元[，,。]?", "monthly"),
    ("money", "m2_yoy", r"广义货币[（(]M2[）)]余额\d+(?:\.\d+)?万亿元[，,。]?", "monthly"),
    ("money", "tsf_stock_yoy", r"社会融资规模存量为\d+(?:\.\d+)?万亿元[，,。]?", "monthly"),
)
# Fiscal series. The amount follows the name; its rate stands in the 36 signs behind it, on the natural basis if given.
FISCAL = (("fiscal_revenue_ytd", "全国一般公共预算收入"), ("fiscal_spending_ytd", "全国一般公共预算支出"), ("tax_revenue_ytd", "税收收入"),
          ("fund_revenue_ytd", "全国政府性基金预算收入"), ("land_revenue_ytd", "国有土地使用权出让收入"))
FISCAL_RATES = ((r"按自然口径计算(增长|下降)(\d+(?:\.\d+)?)%", 1, 2), (r"^[，；。]?(?:同比|比上年同期|比上年)(增长|下降|微增)(\d+(?:\.\d+)?)%", 1, 2),
                (r"^[，；。]?(?:同比|比上年同期|比上年|与去年同期|与上年同期)持平", 0, 0))
# Where the text of a kind ends, titles of annual reports, months in words, names of whole quarters.
ENDS = (("overview", r"注[:：]|附表[:：]|\d{4}年\d+月份主要指标数据"), ("money", r"注1[:：]|注："))
ANNUAL_TITLE = r"^20\d{2}年(?:全国)?(?:固定资产投资|房地产市场|房地产开发投资|规模以上工业企业利润)"
MONTH_WORDS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")
QUARTER_ENDS = ((3, "一季度"), (6, "上半年"), (9, "前三季度"), (12, "全年"))
#: First month whose narrow money has the present definition.
M1_SINCE = 2025 * 12
# Plausible range of every key.
LIMITS: dict[str, tuple[float, float]] = {
    "industrial_yoy": (-50, 80), "retail_yoy": (-50, 80), "fai_ytd_yoy": (-50, 80), "private_fai_ytd_yoy": (-80, 150),
    "manufacturing_fai_ytd_yoy": (-80, 150), "infrastructure_fai_ytd_yoy": (-80, 150), "infrastructure_ex_utilities_ytd_yoy": (-80, 150),
    "real_estate_fai_ytd_yoy": (-80, 150), "housing_sales_area_ytd_yoy": (-80, 150), "industrial_profit_ytd_yoy": (-100, 300),
    "export_yoy": (-70, 150), "import_yoy": (-70, 150), "unemployment": (0, 30), "export_usd": (0, 10000), "import_usd": (0, 10000),
    "export_usd_yoy": (-80, 200), "import_usd_yoy": (-80, 200), "cpi_yoy": (-20, 30), "cpi_mom": (-10, 10), "ppi_yoy": (-50, 80),
    "ppi_mom": (-15, 15), "manufacturing_pmi": (20, 80), "manufacturing_new_orders_pmi": (20, 80), "nonmanufacturing_pmi": (20, 80),
    "m1_yoy": (-50, 100), "m1_legacy_yoy": (-50, 100), "m2_yoy": (-50, 100), "tsf_stock_yoy": (-50, 100), "loans_ytd": (0, 100),
    "fiscal_revenue_ytd": (0, 300000), "fiscal_revenue_ytd_yoy": (-60, 80), "fiscal_spending_ytd": (0, 400000), "fiscal_spending_ytd_yoy": (-60, 80),
    "tax_revenue_ytd": (0, 250000), "tax_revenue_ytd_yoy": (-60, 80), "fund_revenue_ytd": (0, 150000), "fund_revenue_ytd_yoy": (-80, 100),
    "land_revenue_ytd": (0, 120000), "land_revenue_ytd_yoy": (-80, 100),
}


def rule_table(spark: SparkSession) -> DataFrame:
    """(kind, key, within, tries): one row per kind and key; ``tries`` are the patterns in the order in which they are asked.

    A try is (pattern, direction group, number group); ``within`` is a pattern whose first group bounds the text, or null.
    """
    rows: dict[tuple[str, str], tuple[str | None, list]] = {}
    for kind, key, wording, reading in RULES:
        rows.setdefault((kind, key), (None, []))[1].extend((wording + tail, sign, number) for tail, sign, number in READINGS[reading])
    for key, name in FISCAL:
        rows["fiscal", key] = (None, [(f"{name}({NUMBER})亿元", 0, 1)])
        rows["fiscal", f"{key}_yoy"] = (f"{name}{NUMBER}亿元(.{{0,36}})", list(FISCAL_RATES))
    return spark.createDataFrame(
        [(kind, key, within, tries) for (kind, key), (within, tries) in rows.items()],
        "kind string, key string, within string, tries array<struct<pattern: string, sign: int, number: int>>")


def report_kind(title: Column, period: Column, kind: Column) -> Column:
    """The kind whose rules a report follows: its type, the annual form of the type, money or fiscal; null for none."""
    annual = title.rlike(ANNUAL_TITLE) & kind.isin("investment", "estate", "profit")
    return (F.when(title.contains("金融统计数据报告"), "money").when(title.rlike(r"^20\d{2}年.*财政收支情况$"), "fiscal")
            .when(annual, F.when(period % 12 == 11, F.concat(F.lit("annual "), kind))).otherwise(kind))


def loan_amounts(text: Column, period: Column) -> Column:
    """Distinct cumulative loan amounts, in trillions, under the wordings that name the report's own period."""
    month = (period % 12 + 1).cast("string")
    word = F.element_at(F.array(*map(F.lit, MONTH_WORDS)), period % 12 + 1)
    spans = [F.concat(F.lit(r"(?:今年)?前(?:"), month, F.lit("|"), word, F.when(month == "2", F.lit("|两")).otherwise(F.lit("")), F.lit(")个月")),
             F.concat(F.lit("1[—－-]"), month, F.lit("月"))]
    spans.append(F.when(month == "1", F.lit(r"(?<![0-9—－-])1月份?")))
    spans += [F.when(month == str(m), F.lit(name)) for m, name in QUARTER_ENDS]
    pattern = F.concat(F.lit("(?:"), F.concat_ws("|", *spans), F.lit(r")[，,]?人民币贷款(?:累计)?增加"))
    numbers = F.regexp_extract_all(text, F.concat(pattern, F.lit(r"(\d+(?:\.\d+)?)(?:万亿元|亿元)")), F.lit(1))
    units = F.regexp_extract_all(text, F.concat(pattern, F.lit(r"\d+(?:\.\d+)?(万亿元|亿元)")), F.lit(1))
    return F.array_distinct(F.zip_with(numbers, units, lambda n, u: rounded(
        n.try_cast("double") / F.when(u == "亿元", 10000.0).otherwise(1.0), 3)))


def _reading(text: Column, attempt: Column) -> Column:
    """Value of one try: zero, a level, or a signed change; null without a match."""
    found = lambda group: F.call_function("regexp_extract", text, attempt["pattern"], group)
    number = found(attempt["number"]).try_cast("double")
    return (F.when(attempt["number"] == 0, F.when(F.rlike(text, attempt["pattern"]), F.lit(0.0)))
            .when(attempt["sign"] == 0, number).when(found(attempt["sign"]).isin(*DOWN), -number).otherwise(number))


def report_facts(reports: DataFrame) -> DataFrame:
    """(report_id, kind, key, period, value, status) of every fact that the rules find, at most one row per report and key.

    ``reports`` has report_id, title, kind (the report type), period (month as a number) and text (plain, without white space). ``status`` is
    ``ok``; ``out of range`` outside the key's limits; ``conflict`` where a report states several cumulative loans (its value is null then);
    ``part exceeds whole`` for all fiscal facts of a report whose taxes exceed its revenue or whose land sales exceed its fund, and
    ``incomplete`` where total revenue or spending is missing: such reports are refused whole. Reports of no kind, without a
    period or without text give no rows.

    The rule table is a literal and goes to every task; a report meets the rules of its own kind only, and nothing is shuffled.
    """
    spark = reports.sparkSession
    kind = report_kind(F.col("title"), F.col("period"), F.col("kind"))
    known = reports.select("report_id", "period", kind.alias("kind"), "text").where("kind IS NOT NULL AND period IS NOT NULL AND text IS NOT NULL")
    ends = F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.split("text", e, 2), 1)) for k, e in ENDS], F.col("text"))
    known = known.withColumn("text", ends)
    month = (F.col("period") % 12 + 1).cast("string")

    # the rules of a kind are one array: a report's facts stay in its row, so that it can be refused as a whole
    rules = rule_table(spark).groupBy("kind").agg(F.collect_list(F.struct("key", "within", "tries")).alias("rules"))

    def fact(rule: Column) -> Column:
        scope = F.when(rule["within"].isNull(), F.col("text")).otherwise(F.call_function("regexp_extract", F.col("text"), rule["within"], F.lit(1)))
        tried = F.transform(rule["tries"], lambda t: _reading(scope, F.struct(
            F.replace(t["pattern"], F.lit("{m}"), month).alias("pattern"), t["sign"].alias("sign"), t["number"].alias("number"))))
        return F.struct(rule["key"].alias("key"), F.get(F.filter(tried, lambda v: v.isNotNull()), F.lit(0)).alias("value"), F.lit(False).alias("conflict"))

    # a generator evaluates what it yields once, whatever uses it later
    once = lambda column: F.explode(F.array(column))
    ruled = known.join(F.broadcast(rules), "kind", "left")
    found = F.coalesce(F.transform("rules", fact), F.array().cast("array<struct<key: string, value: double, conflict: boolean>>"))
    ruled = ruled.withColumn("loans", once(F.when(F.col("kind") == "money", loan_amounts(F.col("text"), F.col("period")))))
    loans = F.col("loans")
    clause = F.when(F.col("kind") == "ppi", scoped_month_change(F.col("text")))
    single = F.size(loans) == 1
    more = F.array(F.struct(F.lit("loans_ytd").alias("key"), F.when(single, F.get(loans, F.lit(0))).alias("value"), (F.size(loans) > 1).alias("conflict")),
                   F.struct(F.lit("ppi_mom").alias("key"), clause.alias("value"), F.lit(False).alias("conflict")))
    facts = F.filter(F.concat(found, more), lambda f: f["value"].isNotNull() | F.coalesce(f["conflict"], F.lit(False)))
    ruled = ruled.select("report_id", "kind", "period", once(facts).alias("facts"))
    ruled = ruled.select("*", once(F.map_from_entries(F.transform("facts", lambda f: F.struct(f["key"], f["value"])))).alias("by_key"))
    values = F.col("by_key")
    part = (F.coalesce(values["tax_revenue_ytd"], F.lit(0.0)) > values["fiscal_revenue_ytd"]) | (
        F.coalesce(values["land_revenue_ytd"], F.lit(0.0)) > F.coalesce(values["fund_revenue_ytd"], F.lit(float("inf"))))
    refused = F.when(F.col("kind") == "fiscal", F.when(values["fiscal_revenue_ytd"].isNull() | values["fiscal_spending_ytd"].isNull(), "incomplete").when(part, "part exceeds whole"))
    low, high = (F.create_map(*[F.lit(x) for k, v in LIMITS.items() for x in (k, float(v[side]))]) for side in (0, 1))
    listed = ruled.select("report_id", "kind", "period", refused.alias("refused"), F.explode("facts").alias("f")).select("report_id", "kind", "period", "refused", "f.*")
    status = (F.when(F.col("conflict"), "conflict").when(F.col("refused").isNotNull(), F.col("refused"))
              .when(F.col("value").between(low[F.col("key")], high[F.col("key")]), "ok").otherwise("out of range"))
    key = F.when((F.col("key") == "m1_yoy") & (F.col("period") < M1_SINCE), "m1_legacy_yoy").otherwise(F.col("key"))
    return listed.select("report_id", "kind", key.alias("key"), "period", rounded("value", 3).alias("value"), status.alias("status"))
