"""Cells and layouts of report tables: nested and broken tables, spans, and the values under their headers."""

from __future__ import annotations

import time

from panelwright.operators.extract import cross_source_conflicts, first_change, html_table_cells, table_values
from panelwright.operators.report_tables import cells_of, table_cells, table_facts
from pyspark.sql import functions as F

TRADE = """单位：亿元人民币<table><tr><td>项目</td><td>3月</td><td>1至3月累计</td><td>3月与上月环比增减±%</td><td>3月与去年同期同比增减±%</td><td>1至3月累计与去年同期同比增减±%</td></tr>
<tr><td>进出口总值</td><td>{total}</td><td>9</td><td>1.0</td><td>6.0</td><td>1.3</td></tr><tr><td>出口总值</td><td>22,515.0</td><td>9</td><td>1</td><td>13.5</td><td>6.9</td></tr>
<tr><td>进口总值</td><td>15,148.3</td><td>9</td><td>1</td><td>-3.5</td><td>-6.0</td></tr><tr><td>进出口差额</td><td>7,366.7</td><td>9</td><td>-</td><td>-</td><td>-</td></tr></table>"""
STOCK = """<table><tr><td>社会融资规模存量统计表</td><td>单位：万亿元人民币</td></tr></table><table><tr><td rowspan="2">项目</td><td colspan="2">2021.1</td><td colspan="2">2021.2</td><td colspan=2>2021.3</td></tr>
<tr><td>存量</td><td>增速（%）</td><td>存量</td><td>增速(%)</td><td>存量</td><td>增速（%）</td></tr><tr><td>社会融资规模存量AFRE(stock)</td><td>290.0</td><td>13.0</td><td>291.4</td><td>13.3</td><td>—</td><td>—</td></tr>
<tr><td>人民币贷款</td><td>175.41</td><td>99</td><td>176.76</td><td>98</td><td></td><td></td></tr></table>"""
PRICE = """<table class=outer><tr><td>正文<table><tr><td>指标</td><td>环比涨跌幅（%）</td><td>同比涨跌幅（%）</td></tr><tr><td>一、工业生产者出厂价格</td><td>−0.2</td><td>-2.5</td></tr>
<tr><td>工业生产者购进价格</td><td>0.3</td><td>-1.9</td></tr></table></td></tr></table>"""


def backcast(rates):
    return ("2025年1月份启用修订口径，按可比口径回溯2024年。<table><tr><td></td>" + "".join(f"<td>2024.{m}</td>" for m in range(1, len(rates) + 1))
            + "</tr><tr><td>同比增速</td>" + "".join(f"<td>{r}%</td>" for r in rates) + "</tr></table>")


def grid(page):
    out = {}
    for t, r, c, text, _ in cells_of(page):
        out.setdefault(t, {}).setdefault(r, {})[c] = text
    return {t: [[row[c] for c in sorted(row)] for _, row in sorted(rows.items())] for t, rows in out.items()}


def test_spans_fill_the_rectangle():
    page = "<table><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><td>c</td><td rowspan=9>d</td></tr><tr><td>e<td>f</table>"
    assert grid(page) == {0: [["a", "b", "b"], ["a", "c", "d"], ["e", "f", "d"]]}


def test_nested_tables_are_whole():
    page = "<table><tr><td>one<table><tr><td>in<td>ner</tr><tr><td>x</td></tr></table>two</td><td>three</td></tr><tr><td>end</td></tr></table>"
    assert grid(page) == {0: [["oneinnerxtwo", "three"], ["end"]], 1: [["in", "ner"], ["x"]]}


def test_bad_spans_are_noted_and_bounded():
    rows = list(cells_of("<table><tr><td rowspan='2px'>a</td><td colspan=0>b</td><td colspan=100000>c</td></tr></table>"))
    assert [(r[2], r[3], r[4]) for r in rows[:2]] == [(0, "a", "span '2px'"), (1, "b", "span 0")]
    assert len(rows) == 102 and rows[-1][4] == "span 100000"


def test_broken_markup_is_read_once():
    assert grid("<td>stray</td><table><td>a</td><tr><td>b &amp; c<script><td>no</td></script><!-- <td>no</td> --></table></table><tr>") == {0: [["a"], ["b&c"]]}
    start = time.process_time()
    for part in ("<a ", "<table><tr><td>", "<td", "<!--", "<script>", "</table>"):
        list(cells_of("<table>" + part * 3000))
    assert time.process_time() - start < 20


def test_cells_beside_their_page(spark):
    pages = spark.createDataFrame([(1, "x", PRICE), (2, "y", None), (3, "z", "no tables"), (4, "w", "<TABLE><TR><TD>q</TABLE>")], "page_id int, text string, html string")
    rows = table_cells(pages.withColumnRenamed("text", "note")).collect()
    assert {r.page_id for r in rows} == {1, 4} and [(r.note, r.text) for r in rows if r.page_id == 4] == [("w", "q")]
    assert table_cells(pages.limit(0).drop("text")).count() == 0


def facts(spark, cases):
    rows = [(k, layout, int(p[:4]) * 12 + int(p[5:]) - 1, html) for k, (layout, p, html) in enumerate(cases)]
    got = table_facts(spark.createDataFrame(rows, "report_id int, layout string, period int, html string")).collect()
    month = lambda p: None if p is None else f"{p // 12}-{p % 12 + 1:02d}"
    return [{(r.key, month(r.period)): r.value if r.status == "ok" else r.status for r in got if r.report_id == k} for k in range(len(cases))]


def test_four_layouts(spark):
    got = facts(spark, [("trade", "2025-03", TRADE.format(total="37,663.4")), ("stock", "2021-03", STOCK), ("price", "2024-01", PRICE),
                        ("backcast", "2025-01", backcast(range(1, 13)))])
    assert got[0] == {("export_yoy", "2025-03"): 13.5, ("import_yoy", "2025-03"): -3.5}
    assert got[1] == {("tsf_stock_yoy", "2021-01"): 13.0, ("tsf_stock_yoy", "2021-02"): 13.3}
    assert got[2] == {("ppi_mom", "2024-01"): -0.2, ("ppi_yoy", "2024-01"): -2.5}
    assert got[3] == {("m1_yoy", f"2024-{m:02d}"): float(m) for m in range(1, 13)}


def test_refused_tables(spark):
    twice = PRICE + PRICE.replace("-2.5", "-2.6")
    got = facts(spark, [("trade", "2025-03", TRADE.format(total="37,664.4")), ("trade", "2025-04", TRADE.format(total="37,663.4")), ("backcast", "2025-01", backcast(range(1, 12))),
                        ("stock", "2021-03", STOCK.replace("万亿元人民币", "亿美元")), ("stock", "2022-03", STOCK), ("price", "2024-01", twice),
                        ("price", "2024-01", PRICE.replace("<td>指标", "<td rowspan='2px'>指标")), ("price", "2024-01", PRICE.replace("-2.5", "n/a")),
                        ("price", "2024-01", PRICE.replace("-2.5", "-92.5")), ("trade", "2025-03", TRADE.format(total="37,663.4").replace("进口总值", "进 口"))])
    assert set(got[0].values()) == {"not reconciled"} and got[1] == {(None, None): "nothing found"} and set(got[2].values()) == {"incomplete"} and len(got[2]) == 11
    assert set(got[3].values()) == {"wrong page"} and set(got[4].values()) == {"no month"} and set(got[5].values()) == {"conflict"}
    assert set(got[6].values()) == {"bad span"} and got[7] == {("ppi_mom", "2024-01"): -0.2, ("ppi_yoy", "2024-01"): "bad value"}
    assert got[8][("ppi_yoy", "2024-01")] == "out of range" and set(got[9].values()) == {"incomplete"}


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_made_by_batches(spark):
    pages = spark.createDataFrame([("a", "<table>" + "<tr><td colspan=10>x<td>y</tr>" * 5000 + "</table>"), ("b", PRICE), ("c", "no table"), (None, "<table><td>q</table>")], "doc_id string, html string")
    cells = table_cells(pages.coalesce(1))
    assert "MapInArrow" in plan(cells) and "PythonUDTF" not in plan(cells)
    rows = [tuple(r) for r in cells.collect()]
    assert sorted(rows, key=str) == sorted(((k, *c) for k, p in pages.collect() if p != "no table" for c in cells_of(p)), key=str) and len(rows) == 55000 + 10 + 1


def test_facts_read_a_page_once(spark):
    rows = [(1, "price", 24288, PRICE), (2, "price", 24288, "<table><td>x</table>"), (2, "price", 24288, "none"), (3, "price", 24288, None), (None, "price", 24288, PRICE), (4, "other", 24288, PRICE)]
    found = table_facts(spark.createDataFrame(rows, "report_id int, layout string, period int, html string"))
    assert plan(found).count("MapInArrow") == 1
    price = [("ppi_mom", -0.2, "ok"), ("ppi_yoy", -2.5, "ok")]
    nothing = (None, None, "nothing found")
    expected = [(1, *f) for f in price] + [(2, *nothing)] * 2 + [(3, *nothing), (None, *nothing)] + [(None, *f) for f in price]
    assert sorted(((r.report_id, r.key, r.value, r.status) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_values_are_found_in_one_pass(spark):
    page = """<table><tr><th rowspan=2>指标<th colspan=2>2024.1<th>2024.2<th>2024.2</tr><tr><th>环比涨跌幅（%）<th>同比涨跌幅（%）<th>同比涨跌幅（%）<th>同比涨跌幅（%）</tr>
<tr><td>居民消费价格<td>−0.2<td>1.5<td>2.5<td>2.6</tr><tr><td>食品<td>9<td>9<td>9<td>9</tr></table>"""
    found = table_values(html_table_cells(spark.createDataFrame([("a", page), ("b", page), (None, page)], "doc_id string, html string")))
    assert plan(found).count("MapInArrow") == 1
    mid = 2024 * 12
    for doc in "ab":
        assert {(r.key, r.mid, r.value, r.conflict) for r in found.collect() if r.doc_id == doc} == {
            ("cpi_mom", mid, -0.2, False), ("cpi_yoy", mid, 1.5, False), ("cpi_yoy", mid + 1, 2.6, True)}
    assert found.count() == 6


def test_text_and_table_are_compared_in_one_pass(spark):
    texts = [("居民消费价格同比上涨1.5%，同比下降2%", 1.5), ("居民消费价格同比持平，居民消费价格同比减少0.5%", -0.5), ("居民消费价格同比持平", 0.0), ("居民消费价格环比上涨1%", None), (None, None)]
    stated = spark.createDataFrame([(str(k), "cpi_yoy", *t) for k, t in enumerate(texts)], "doc_id string, key string, text string, expected double").withColumn("value", first_change(F.col("text"), "居民消费价格同比"))
    assert all(r.value == r.expected for r in stated.collect()) and plan(stated).count("regexp_extract(text") == 1  # the text is searched once
    page = "<table><tr><th>指标<th>2024.1</tr><tr><th><th>同比涨跌幅（%）</tr><tr><td>居民消费价格<td>1.6</tr></table>"
    cells = html_table_cells(spark.createDataFrame([("0", page), ("1", page.replace("1.6", "-0.5"))], "doc_id string, html string"))
    both = cross_source_conflicts(stated.where("value IS NOT NULL").select("doc_id", "key", "value"), table_values(cells))
    assert plan(both).count("MapInArrow") == 1 and [(r.doc_id, r.narrative_value, r.table_value) for r in both.collect()] == [("0", 1.5, 1.6)]
