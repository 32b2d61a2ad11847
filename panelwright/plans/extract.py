from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import extract as op
from panelwright.operators import report_rules as rules
from panelwright.operators import report_tables as tables
from panelwright.plans.registry import query
from panelwright.sources.bulletins import facts_sql
from panelwright.sources.statements import statement_facts_sql

HOSTS = ["blog.tionsh.example.net", "ththther.example.org", "www.ththhe.example.com", "m.ththth.example.net", "blog.ththon.example.net"]


def texts(inp):
    return op.with_text(inp.articles).select("doc_id", "title", "text")


@query("page_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\n\r\f\x{00a0}\x{3000}]+', '', 'g'), '[−－]', '-', 'g') AS t FROM b)
SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM c""")
def page_text(inp):
    text = op.plain_text(F.col("html"))
    return inp.pages.select("page_id", text.alias("t")).select(
        "page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("quarantine_pages", """
SELECT page_id, CASE WHEN octet_length(encode(html)) > 2000000 THEN 'oversized' WHEN contains(html, 'document.cookie') OR contains(html, 'Please enable JavaScript') OR contains(html, '__jsl_clearance')
  OR contains(html, 'acw_sc__v2') OR contains(html, 'cheap-pills') THEN 'access verification' WHEN NOT contains(html, '<a ') AND NOT contains(html, '<article') THEN 'not an article' ELSE 'usable' END AS reason FROM pages""")
def quarantine_pages(inp):
    checked = op.quarantine(inp.pages, (*op.BLOCK_MARKERS, "cheap-pills"))
    return checked.select("page_id", F.coalesce("reason", F.lit("usable")).alias("reason"))


@query("classify_title", """
SELECT doc_id, CASE form WHEN 0 THEN 'overview' WHEN 1 THEN 'cpi' WHEN 2 THEN 'profit' WHEN 3 THEN 'overview' WHEN 4 THEN 'retail' WHEN 5 THEN 'estate' END AS report_type FROM report_src""")
def classify_title(inp):
    return inp.articles.select("doc_id", op.report_type(F.col("title")).alias("report_type"))


@query("title_period", """
SELECT doc_id, CASE form WHEN 0 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 1 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 2 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0')
  WHEN 3 THEN y || '-06' WHEN 4 THEN y || '-09' WHEN 5 THEN y || '-12' END AS period FROM report_src""")
def title_period(inp):
    return inp.articles.select(
        "doc_id", op.title_period(F.col("title"), op.publication_date(F.col("html"))).alias("period"))


@query("extract_dates", "SELECT doc_id, py || '-' || lpad(CAST(pm AS VARCHAR), 2, '0') || '-' || lpad(CAST(pd AS VARCHAR), 2, '0') AS published FROM report_src")
def extract_dates(inp):
    return inp.articles.select("doc_id", op.publication_date(F.col("html")).alias("published"))


@query("pattern_facts", """
SELECT doc_id, 'cpi_yoy' AS key, round(c1 / 10.0, 1) + 0.0 AS value FROM report_src UNION ALL SELECT doc_id, 'retail_yoy', round(c2 / 10.0, 1) + 0.0 FROM report_src
UNION ALL SELECT doc_id, 'unemployment', round(u / 10.0, 1) + 0.0 FROM report_src""")
def pattern_facts(inp):
    return op.pattern_facts(texts(inp)).withColumn("value", rounded("value", 1))


@query("scoped_clause_fact", "SELECT doc_id, round(c3 / 10.0, 1) + 0.0 AS ppi_mom FROM report_src")
def scoped_clause_fact(inp):
    return texts(inp).select("doc_id", rounded(op.scoped_month_change(F.col("text")), 1).alias("ppi_mom"))


@query("cumulative_amount_fact", """
WITH a AS (SELECT doc_id, round(amt / 10000.0, 3) AS v1, round((amt + CASE WHEN s % 9 = 4 THEN 777 ELSE 0 END) / 10000.0, 3) AS v2 FROM report_src)
SELECT doc_id, CASE WHEN v1 = v2 THEN v1 + 0.0 END AS value, v1 <> v2 AS conflict FROM a""")
def cumulative_amount_fact(inp):
    return op.cumulative_facts(texts(inp))


@query("amount_and_rate_pairs", """
WITH a AS (SELECT *, CASE WHEN s % 11 = 5 THEN amt + 10 ELSE CAST(floor(amt * 4 / 5) AS BIGINT) END AS t FROM report_src)
SELECT doc_id, CAST(amt AS DOUBLE) AS revenue, round(CASE WHEN s % 3 = 0 THEN c1 ELSE c2 END / 10.0, 1) + 0.0 AS revenue_rate, CAST(t AS DOUBLE) AS tax, 0.0::DOUBLE AS tax_rate, t <= amt AS subtotal_ok FROM a""")
def amount_and_rate_pairs(inp):
    return op.amount_rate_pairs(texts(inp)).withColumn("revenue_rate", rounded("revenue_rate", 1))


@query("guardrail_filter", """
SELECT doc_id, 'cpi_yoy' AS key, round(c1 / 10.0, 3) + 0.0 AS value FROM report_src WHERE c1 BETWEEN -50 AND 150 UNION ALL SELECT doc_id, 'unemployment', round(u / 10.0, 3) + 0.0 FROM report_src WHERE u BETWEEN 35 AND 60""")
def guardrail_filter(inp):
    limits = inp.spark.createDataFrame(
        [("cpi_yoy", -5.0, 15.0), ("unemployment", 3.5, 6.0)], "key string, low double, high double")
    return op.guarded(op.pattern_facts(texts(inp)), limits).withColumn("value", rounded("value", 3))


@query("page_links", r"""
WITH a AS (SELECT unnest(regexp_extract_all(html, '(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS a FROM pages),
l AS (SELECT regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS title FROM a)
SELECT href, arg_max(title, (length(title), title)) AS title, count(*) AS links, starts_with(lower(href), '/the') AS overview FROM l WHERE regexp_matches(href, '^/[A-Za-z]+$') GROUP BY href""")
def page_links(inp):
    return op.page_links(inp.pages, "^/[A-Za-z]+$")


@query("html_table_cells", """
WITH a AS (SELECT *, c1 + CASE WHEN s % 10 = 3 THEN 1 ELSE 0 END AS t1 FROM report_src)
SELECT doc_id, 0::INT AS table_no, r::INT AS row_no, c::INT AS col_no, CASE WHEN r < 2 AND c = 0 THEN '指标' WHEN r = 0 THEN y || '.' || m WHEN r = 1 AND c = 1 THEN '环比涨跌幅（%）' WHEN r = 1 THEN '同比涨跌幅（%）'
  WHEN c = 0 AND r = 2 THEN '居民消费价格' WHEN c = 0 THEN '工业生产者出厂价格' WHEN r = 3 AND c = 2 THEN '—'
  ELSE (CASE WHEN (CASE WHEN r = 3 THEN c3 WHEN c = 1 THEN c2 ELSE t1 END) < 0 THEN '−' ELSE '' END) || CAST(abs(CASE WHEN r = 3 THEN c3 WHEN c = 1 THEN c2 ELSE t1 END) // 10 AS VARCHAR) || '.'
    || CAST(abs(CASE WHEN r = 3 THEN c3 WHEN c = 1 THEN c2 ELSE t1 END) % 10 AS VARCHAR) END AS text
FROM a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS r) CROSS JOIN (SELECT unnest([0, 1, 2]) AS c)""")
def html_table_cells(inp):
    return op.html_table_cells(inp.articles)


@query("table_series_values", """
SELECT doc_id, 'cpi_mom' AS key, mid, round(c2 / 10.0, 1) + 0.0 AS value, false AS conflict FROM report_src
UNION ALL SELECT doc_id, 'cpi_yoy', mid, round((c1 + CASE WHEN s % 10 = 3 THEN 1 ELSE 0 END) / 10.0, 1) + 0.0, false FROM report_src UNION ALL SELECT doc_id, 'ppi_mom', mid, round(c3 / 10.0, 1) + 0.0, false FROM report_src""")
def table_series_values(inp):
    return op.table_values(op.html_table_cells(inp.articles)).withColumn("value", rounded("value", 1))


@query("cross_source_conflicts", """
SELECT doc_id, 'cpi_yoy' AS key, round(c1 / 10.0, 1) + 0.0 AS narrative_value, round((c1 + 1) / 10.0, 1) + 0.0 AS table_value FROM report_src WHERE s % 10 = 3""")
def cross_source_conflicts(inp):
    facts = op.pattern_facts(texts(inp))
    table = op.table_values(op.html_table_cells(inp.articles))
    return op.cross_source_conflicts(facts, table).select(
        "doc_id", "key", rounded("narrative_value", 1).alias("narrative_value"), rounded("table_value", 1).alias("table_value"))


@query("url_allowlist", f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 7 = 3 THEN regexp_replace(url, '://', '://user@') WHEN page_id % 11 = 5 THEN regexp_replace(url, '(://[^/]+)', '\\1:8443') ELSE url END AS url FROM pages)
SELECT page_id, url, coalesce(starts_with(url, 'https://') AND split_part(split_part(split_part(substr(url, 9), '/', 1), '?', 1), '#', 1) IN {tuple(HOSTS)}, false) AS allowed FROM u""")
def url_allowlist(inp):
    page = F.col("page_id")
    url = F.when(page % 7 == 3, F.regexp_replace("url", "://", "://user@")).when(
        page % 11 == 5, F.regexp_replace("url", "(://[^/]+)", "$1:8443")).otherwise(F.col("url"))
    return inp.pages.select("page_id", url.alias("url")).withColumn("allowed", op.url_allowed(F.col("url"), HOSTS))


@query("report_facts", facts_sql(rules.LIMITS))
def report_facts(inp):
    written = inp.bulletins.select("doc_id", "mid", "html", F.explode(F.array("title")).alias("title"))  # written once
    pages = op.with_text(written).select(F.col("doc_id").alias("report_id"), "title", F.col("mid").alias("period"), "text")
    return rules.report_facts(pages.withColumn("kind", op.report_type(F.col("title"))))


@query("table_layout_facts", statement_facts_sql(rules.LIMITS))
def table_layout_facts(inp):
    written = inp.statements.select("doc_id", "layout", "mid", F.explode(F.array("html")).alias("html"))  # written once
    return tables.table_facts(written.select(F.col("doc_id").alias("report_id"), "layout", F.col("mid").alias("period"), "html"))


@query("table_cells_lateral", """
SELECT page_id, CAST(number - 1 AS INT) AS table_no, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no,
  CASE WHEN number = 1 AND col_no = 1 THEN 'see' || 'name' || CAST(page_id AS VARCHAR) || 'host' || CAST(page_id % 7 AS VARCHAR) WHEN number = 1 THEN 'page'
       WHEN col_no = 0 THEN CASE row_no WHEN 0 THEN 'name' ELSE 'host' END ELSE CASE row_no WHEN 0 THEN CAST(page_id AS VARCHAR) ELSE CAST(page_id % 7 AS VARCHAR) END END AS text,
  CASE WHEN number = 1 AND col_no = 1 AND page_id % 3 = 1 THEN 'span ''2px''' END AS reject
FROM pages, (SELECT unnest([1, 1, 2, 2, 2, 2]) AS number, unnest([0, 0, 0, 1, 0, 1]) AS row_no, unnest([0, 1, 0, 0, 1, 1]) AS col_no)""")
def table_cells_lateral(inp):
    """Cells of a table within a table that is put before every page; some have a span that no reader takes."""
    page = F.col("page_id").cast("string")
    span = F.when(F.col("page_id") % 3 == 1, F.lit(" colspan='2px'")).otherwise(F.lit(""))
    inner = F.concat(F.lit("<table><tr><th>name</th><td>"), page, F.lit("</td></tr><tr><th>host</th><td>"), (F.col("page_id") % 7).cast("string"), F.lit("</td></tr></table>"))
    bare = F.regexp_replace("html", r"(?i)</?(?:table|tr|td|th)\b[^>]*>", "")
    html = F.concat(F.lit("<table><tr><td>page</td><td"), span, F.lit(">see "), inner, F.lit("</td></tr></table>"), bare)
    return tables.table_cells(inp.pages.select("page_id", html.alias("html")))
