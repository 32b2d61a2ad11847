"""Report pages with a table in one of four layouts, written from the numbers of ``report_src``, and the facts they state."""

from __future__ import annotations

#: Order of the layouts in the fixture: report number modulo four.
NAMES = ("price", "stock", "backcast", "trade")
_TENTHS = "concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, CAST(floor(abs({c}) / 10) AS INT), '.', abs({c}) % 10)"


def statement_sql() -> str:
    """(doc_id, layout, mid, html): every seventh price table has a refused span, every fifth trade table does not add up."""
    digits = ", ".join(f"{_TENTHS.format(c=c)} AS d{c}" for c in ("c1", "c2", "c3"))
    months = ", ".join(f"'<td>2024.{m}</td>'" for m in range(1, 13))
    rates = ", ".join(f"'<td>', {_TENTHS.format(c=f'(c1 + {m})')}, '%</td>'" for m in range(1, 13))
    return f"""WITH statement_digits AS (SELECT *, (s + mid) % 4 AS form_no, {digits} FROM report_src),
statement_amounts AS (SELECT *, concat(amt, '.0') AS exports, concat(amt + 7, '.0') AS imports, concat(2 * amt + 7 + CASE WHEN s % 5 = 2 THEN 1 ELSE 0 END, '.0') AS total FROM statement_digits)
SELECT doc_id, mid, CASE form_no WHEN 0 THEN 'price' WHEN 1 THEN 'stock' WHEN 2 THEN 'backcast' ELSE 'trade' END AS layout, CASE form_no
WHEN 0 THEN concat('<table><tr><td>正文<table><tr><th rowspan="', CASE WHEN s % 7 = 3 THEN '1px' ELSE '1' END, '">指标</th><th>环比涨跌幅（%）</th><th>同比涨跌幅（%）</th></tr><tr><td>居民消费价格</td><td>', dc3, '</td><td>', dc2, '</td></tr>
<tr><td>食品</td><td>9.9</td><td>9.9</td></tr></table></td></tr></table>')
WHEN 1 THEN concat('<p>社会融资规模存量统计表，万亿元人民币</p><table><tr><td rowspan=2>项目</td><td colspan=2>', y, '.', m, '</td><td colspan=2>', y, '.', m % 12 + 1, '</td></tr><tr><td>存量</td><td>增速（%）</td><td>存量</td><td>增速(%)</td></tr>
<tr><td>社会融资规模存量</td><td>1.0</td><td>', dc1, '</td><td>1.0</td><td>—</td></tr><tr><td>人民币贷款</td><td>1.0</td><td>99</td><td>1.0</td><td>98</td></tr></table>')
WHEN 2 THEN concat('2025年1月份启用修订口径，按可比口径回溯2024年。<table><tr><td></td>', {months}, '</tr><tr><td>同比增速</td>', {rates}, '</tr></table>')
ELSE concat('<p>单位：亿元人民币</p><table><tr><td>项目</td><td>', m, '月</td><td>1至', m, '月累计</td><td>', m, '月与去年同期同比增减±%</td></tr><tr><td>进出口总值</td><td>', total, '</td><td>9</td><td>1.0</td></tr><tr><td>出口总值</td><td>',
exports, '</td><td>9</td><td>', dc1, '</td></tr><tr><td>进口总值</td><td>', imports, '</td><td>9</td><td>', dc2, '</td></tr><tr><td>进出口差额</td><td>-7.0</td><td>9</td><td>-</td></tr></table>') END AS html FROM statement_amounts"""


def statement_facts_sql(limits: dict[str, tuple[float, float]]) -> str:
    def row(form: int, key: str, value: str, period: str = "mid", refused: str = "") -> str:
        low, high = limits[key]
        return (f"SELECT doc_id AS report_id, '{key}' AS key, CAST({period} AS INT) AS period, CAST(round({value} / 10.0, 3) AS DOUBLE) + 0.0 AS value, "
                f"CASE {refused} WHEN {value} / 10.0 BETWEEN {low} AND {high} THEN 'ok' ELSE 'out of range' END AS status FROM report_src WHERE (s + mid) % 4 = {form}")

    span, sums = "WHEN s % 7 = 3 THEN 'bad span'", "WHEN s % 5 = 2 THEN 'not reconciled'"
    rows = [row(0, "cpi_mom", "c3", refused=span), row(0, "cpi_yoy", "c2", refused=span), row(1, "tsf_stock_yoy", "c1"),
            *(row(2, "m1_yoy", f"(c1 + {m})", str(2024 * 12 + m - 1)) for m in range(1, 13)), row(3, "export_yoy", "c1", refused=sums), row(3, "import_yoy", "c2", refused=sums)]
    return "\nUNION ALL ".join(rows)
