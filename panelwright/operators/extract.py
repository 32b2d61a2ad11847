"""Facts from report pages.

Every rule is a built-in string expression over the whole text, evaluated for all pages and rules in one scan.
Wordings and formats of the reports are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, rounded

# Direction words and the sign they carry.
DOWN = ("下降", "下跌", "减少")
CHANGE = r"(增长|上涨|下降|下跌|减少)(\d+(?:\.\d+)?)%"

# Report types in the order they are tried, as conditions on the title.
REPORT_TYPES = (
    ("overview", r"^(?!.*公报)(?=.*(?:国民经济|上半年经济运行))(?=.*(?:月份|上半年|一季度|前三季度)).*"),
    ("industry", r"规模以上工业增加值"),
    ("retail", r"社会消费品零售总额"),
    ("investment", r"^(?=.*全国固定资产投资)(?=.*(?:基本情况|增长|下降)).*"),
    ("estate", r"全国房地产市场基本情况|全国房地产开发投资"),
    ("cpi", r"^(?=.*居民消费价格)(?=.*月份).*"),
    ("ppi", r"^(?=.*工业生产者出厂价格)(?=.*月份).*"),
    ("pmi", r"中国采购经理指数运行情况"),
    ("profit", r"规模以上工业企业利润"),
)

# Fact rules (key, wording before the change, is a flat wording possible).
FACT_RULES = (
    ("cpi_yoy", r"(?<![0-9—－-])\d{1,2}月份，?全国居民消费价格(?:（CPI）)?同比", True),
    ("retail_yoy", r"(?<![0-9—－-])\d{1,2}月份，?社会消费品零售总额\d+(?:\.\d+)?亿元[，,]同比", True),
)
LEVEL_RULES = (("unemployment", r"全国城镇调查失业率为(\d+(?:\.\d+)?)%"),)

# Plausible range per fact.
LIMITS = (("cpi_yoy", -20.0, 30.0), ("retail_yoy", -50.0, 80.0), ("unemployment", 0.0, 30.0))

# Year and month of publication in a report's address.
ADDRESS_MONTH = r"/((?:19|20)\d{2})(\d{2})/"

# Signs of an access-verification page.
BLOCK_MARKERS = ("Please enable JavaScript", "__jsl_clearance", "acw_sc__v2")


def plain_text(html: Column) -> Column:
    """Markup, scripts and white space removed, minus signs unified."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, "[ \\t\\n\\r\\f 　]+", "")
    return F.regexp_replace(text, "[−－]", "-")


def with_text(pages: DataFrame) -> DataFrame:
    """Plain text of every page, computed once: a generator keeps later filters from repeating it."""
    return pages.withColumn("text", F.explode(F.array(plain_text(F.col("html")))))


def quarantine(pages: DataFrame, markers: tuple[str, ...], largest: int = 2_000_000) -> DataFrame:
    """Why a page is not usable, checked in fixed order over the whole page; NULL for usable pages. ``largest`` is in bytes."""
    html = F.col("html")
    blocked = F.contains(html, F.lit("document.cookie"))
    for marker in markers:
        blocked = blocked | F.contains(html, F.lit(marker))
    reason = (
        F.when(F.octet_length(html) > largest, "oversized").when(blocked, "access verification")
        .when(~F.contains(html, F.lit("<a ")) & ~F.contains(html, F.lit("<article")), "not an article")
    )
    return pages.withColumn("reason", reason)


def report_type(title: Column) -> Column:
    return F.coalesce(*[F.when(title.rlike(pattern), name) for name, pattern in REPORT_TYPES])


def publication_date(html: Column) -> Column:
    """Date of the meta tag, else the date in the directory text; zero-padded, empty when absent."""
    meta = r'(?i)<meta name="PubDate" content="((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})'
    listing = r"((?:19|20)\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"

    def parts(pattern: str) -> Column:
        year = F.regexp_extract(html, pattern, 1)
        text = F.concat_ws("-", year, F.lpad(F.regexp_extract(html, pattern, 2), 2, "0"),
                           F.lpad(F.regexp_extract(html, pattern, 3), 2, "0"))
        return F.when(year != "", text)

    return F.coalesce(parts(meta), parts(listing), F.lit(""))


def title_period(title: Column, published: Column, url: Column | None = None) -> Column:
    """Month a title speaks about; without a year the publication date decides, or without one the month in the address
    (``/YYYYMM/``), rolled back over new year."""
    stated = F.regexp_extract(title, r"((?:19|20)\d{2})年", 1)
    folder = lambda k: F.lit(None).cast("int") if url is None else F.regexp_extract(url, ADDRESS_MONTH, k).try_cast("int")
    year = F.coalesce(stated.try_cast("int"), F.substring(published, 1, 4).try_cast("int"), folder(1))
    released = F.coalesce(F.substring(published, 6, 2).try_cast("int"), folder(2))
    number = F.regexp_extract(title, r"(?:\d+[—－-])?(\d{1,2})月份?", 1).try_cast("int")
    annual = title.rlike(
        r"^(?:19|20)\d{2}年(?:全国)?(?:固定资产投资|房地产市场|房地产开发投资|规模以上工业企业利润|金融统计数据报告)")
    month = (
        F.when(number.isNotNull(), number).when(F.contains(title, F.lit("上半年")), 6)
        .when(F.contains(title, F.lit("一季度")), 3).when(F.contains(title, F.lit("前三季度")), 9).when(annual, 12)
    )
    back = (stated == "") & (month > released)
    return F.when(month.between(1, 12), month_label((year - back.cast("int")) * 12 + month - 1))


def signed(direction: Column, number: Column) -> Column:
    value = number.try_cast("double")
    return F.when(direction.isin(*DOWN), -value).otherwise(value)


def first_change(text: Column, wording: str, flat: bool = True) -> Column:
    """Signed change after a wording; a flat wording is zero, no match is NULL."""
    found = F.array(F.regexp_extract(text, wording + CHANGE, 0))  # the text is searched once, direction and number are read from what was found
    value = F.get(F.transform(found, lambda c: signed(F.regexp_extract(c, CHANGE + "$", 1), F.regexp_extract(c, CHANGE + "$", 2))), F.lit(0))
    return F.coalesce(value, F.when(text.rlike(wording + "持平"), 0.0)) if flat else value


def pattern_facts(documents: DataFrame) -> DataFrame:
    """One row per document and rule that matched (``text`` is plain text)."""
    text = F.col("text")
    facts = [F.struct(F.lit(k).alias("key"), first_change(text, w, f).alias("value")) for k, w, f in FACT_RULES]
    facts += [
        F.struct(F.lit(k).alias("key"), F.regexp_extract(text, p, 1).try_cast("double").alias("value"))
        for k, p in LEVEL_RULES
    ]
    return documents.select("doc_id", F.explode(F.array(*facts)).alias("f")).select("doc_id", "f.*").filter(
        "value IS NOT NULL"
    )


def scoped_month_change(text: Column) -> Column:
    """Producer output-price month rate: only between a mention of it and the next mention of either index.

    The introduction ends at the first numbered section. After a turn ("from ... to ...") the new direction
    counts.
    """
    intro = F.substring_index(text, "一、", 1)
    # text after each mention of the output index, cut at the next input mention
    segments = F.transform(
        F.split(intro, "工业生产者出厂价格"), lambda x: F.substring_index(x, "工业生产者购进价格", 1))
    after = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(1)))

    def rate(segment: Column) -> Column:
        phrase = F.regexp_extract(segment, r"环比([^；。]{0,45})", 1)
        turned = F.when(F.contains(phrase, F.lit("转为")), F.regexp_extract(phrase, "转为(.*)$", 1)).otherwise(phrase)
        return first_change(turned, r"(?:分别|均|继续|基本)?")

    return F.get(F.filter(F.transform(after, rate), lambda v: v.isNotNull()), F.lit(0))


def cumulative_amount(text: Column) -> Column:
    """Distinct cumulative loan amounts in trillions under the allowed period wordings."""
    pattern = r"(?:(?:今年)?前(?:\d{1,2}|两)个月|1[—－-]\d{1,2}月|一季度|上半年|前三季度|全年)[，,]?人民币贷款(?:累计)?增加"
    amounts = F.regexp_extract_all(text, F.lit(pattern + r"(\d+(?:\.\d+)?)(?:万亿元|亿元)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(pattern + r"\d+(?:\.\d+)?(万亿元|亿元)"), F.lit(1))
    return F.array_distinct(F.zip_with(amounts, units, lambda a, u: rounded(
        a.try_cast("double") / F.when(u == "亿元", 10000.0).otherwise(1.0), 3)))


def cumulative_facts(documents: DataFrame) -> DataFrame:
    """The single cumulative amount, or a conflict when a document states several."""
    found = documents.select("doc_id", cumulative_amount(F.col("text")).alias("v")).filter("size(v) > 0")
    single = F.size("v") == 1
    return found.select("doc_id", F.when(single, F.get("v", F.lit(0))).alias("value"), (~single).alias("conflict"))


def amount_and_rate(text: Column, series: str) -> tuple[Column, Column]:
    """Amount after the series name, and the rate in the clause behind it, natural basis first."""
    head = series + r"(\d+(?:\.\d+)?)亿元"
    amount = F.regexp_extract(text, head, 1).try_cast("double")
    clause = F.regexp_extract(text, head + r"(.{0,36})", 2)
    natural = r"按自然口径计算(增长|下降)(\d+(?:\.\d+)?)%"
    plain = r"^[，；。]?(?:同比|比上年同期|比上年)(增长|下降|微增)(\d+(?:\.\d+)?)%"
    flat = clause.rlike(r"^[，；。]?(?:同比|比上年同期|比上年|与去年同期|与上年同期)持平")
    rate = F.coalesce(
        signed(F.regexp_extract(clause, natural, 1), F.regexp_extract(clause, natural, 2)),
        signed(F.regexp_extract(clause, plain, 1), F.regexp_extract(clause, plain, 2)), F.when(flat, 0.0),
    )
    return amount, rate


def amount_rate_pairs(documents: DataFrame) -> DataFrame:
    """Revenue and tax with their rates and the check that the part does not exceed the whole."""
    revenue, revenue_rate = amount_and_rate(F.col("text"), "全国一般公共预算收入")
    tax, tax_rate = amount_and_rate(F.col("text"), "全国税收收入")
    return documents.select(
        "doc_id", revenue.alias("revenue"), revenue_rate.alias("revenue_rate"), tax.alias("tax"),
        tax_rate.alias("tax_rate"),
    ).filter("revenue IS NOT NULL").withColumn("subtotal_ok", F.coalesce(F.col("tax") <= F.col("revenue"), F.lit(True)))


def guarded(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """Keep values within the limits of their key, rounded to three digits."""
    return facts.join(F.broadcast(limits), "key").filter(F.col("value").between(F.col("low"), F.col("high"))).select(
        "doc_id", "key", rounded("value", 3).alias("value")
    )


def page_links(pages: DataFrame, path: str) -> DataFrame:
    """Links whose address matches, one row per address with its longest title, overview pages first.

    The longest title is a ``max`` over an ordered struct, so an address linked from everywhere is reduced
    before it is shuffled.
    """
    anchors = F.regexp_extract_all("html", F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    links = pages.select(F.explode(anchors).alias("a")).select(
        F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"),
        F.trim(F.regexp_replace("a", "<[^>]*>", "")).alias("title"),
    ).filter(F.col("href").rlike(path))
    best = links.groupBy("href").agg(
        F.max(F.struct(F.length("title").alias("n"), "title")).alias("b"), F.count("*").alias("links")
    )
    return best.select("href", F.col("b.title").alias("title"), "links").withColumn(
        "overview", F.lower("href").startswith("/the")
    )


def html_table_cells(pages: DataFrame) -> DataFrame:
    """Rectangular cells of every table (doc_id, table_no, row_no, col_no, text) with row and column spans expanded.

    Nested tables are tables of their own; ``report_tables.table_cells`` says too which spans it has not taken at their word.
    """
    from panelwright.operators.report_tables import table_cells

    return table_cells(pages.select("doc_id", "html")).drop("reject")


def table_values(cells: DataFrame) -> DataFrame:
    """Values under a month header and a rate header, next to a known row label; conflicts are flagged.

    Cells are read once and dealt by document once; the headers of a column and the labels of a row are windows over one table.
    """
    text = F.col("text")
    month = F.substring_index(text, ".", 1).cast("int") * 12 + F.substring_index(text, ".", -1).cast("int") - 1
    told = cells.where("doc_id IS NOT NULL").select(
        "doc_id", "table_no", "row_no", "col_no",
        F.when(text.rlike(r"^(?:19|20)\d{2}\.\d{1,2}$"), month).alias("mid"),
        F.when(text.rlike("^(环比|同比)涨跌幅"), F.when(text.startswith("环比"), "mom").otherwise("yoy")).alias("basis"),
        F.when(F.col("col_no") == 0, F.when(text == "居民消费价格", "cpi").when(text == "工业生产者出厂价格", "ppi")).alias("series"),
        F.when(F.col("col_no") > 0, F.replace(text, F.lit("−"), F.lit("-")).try_cast("double")).alias("value"))
    dealt = told.where("mid IS NOT NULL OR basis IS NOT NULL OR series IS NOT NULL OR value IS NOT NULL").repartition("doc_id")
    column, row = (Window.partitionBy("doc_id", "table_no", c) for c in ("col_no", "row_no"))
    met = dealt.withColumns({"mids": F.collect_set("mid").over(column), "bases": F.collect_set("basis").over(column)}).where(
        "series IS NOT NULL OR value IS NOT NULL").withColumn("labels", F.collect_set("series").over(row)).where("value IS NOT NULL")
    found = met.select("doc_id", "mids", "bases", F.explode("labels").alias("series"), "value").select(
        "doc_id", "mids", F.explode("bases").alias("basis"), "series", "value").select(
        "doc_id", F.explode("mids").alias("mid"), F.concat_ws("_", "series", "basis").alias("key"), "value")
    return found.groupBy("doc_id", "key", "mid").agg(
        F.max("value").alias("value"), (F.min("value") != F.max("value")).alias("conflict"))


def cross_source_conflicts(narrative: DataFrame, table: DataFrame) -> DataFrame:
    """Documents whose text and table state different values for one key."""
    stated = table.select("doc_id", "key", F.col("value").alias("table_value"))
    return narrative.withColumnRenamed("value", "narrative_value").join(stated, ["doc_id", "key"]).filter(
        F.abs(F.col("narrative_value") - F.col("table_value")) > 1e-9
    )


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """https, an allowed host, no user name and no port."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    return authority.isin(hosts) & ~F.contains(authority, F.lit("@")) & ~F.contains(authority, F.lit(":"))
