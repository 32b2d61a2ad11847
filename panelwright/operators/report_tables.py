"""Tables of report pages: cells as a lateral table function, and values found by their headers in four layouts."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.expressions import rounded
from panelwright.operators.report_rules import LIMITS

#: Columns or rows that a cell may span; what says more is taken as the nearest bound and noted.
MOST_SPANNED = 100
_PARTS = re.compile(r"([^<]+)|<(?:!--.*?-->|(script|style)\b[^>]*>.*?</\2\s*>|(/?)(table|tr|td|th)\b([^<>]*)>|[^<>]*>)?", re.I | re.S)
_TABLE = re.compile(r"<(?:!--.*?-->|(script|style)\b[^>]*>.*?</\1\s*>|(table)\b[^<>]*>)", re.I | re.S)
_SPAN = re.compile(r"""\b(rowspan|colspan)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _span(value: str | None) -> tuple[int, str | None]:
    """(cells spanned, what is wrong with the attribute)."""
    if value is None:
        return 1, None
    if not re.fullmatch(r"\s*\d{1,9}\s*", value):
        return 1, f"span {value[:20]!r}"
    n = int(value)
    return min(max(n, 1), MOST_SPANNED), None if 1 <= n <= MOST_SPANNED else f"span {n}"


def _spans(attributes: str) -> tuple[int, int, str | None]:
    """(rows, columns, what is wrong) of a cell's attributes."""
    spans = {m[1].lower(): next(v for v in m.groups()[1:] if v is not None) for m in _SPAN.finditer(attributes)}
    (height, tall), (width, wide) = _span(spans.get("rowspan")), _span(spans.get("colspan"))
    return height, width, tall or wide


def _next_table(page: str, at: int) -> int | None:
    """Where the tag that opens the next table ends; comments, scripts and styles are passed over."""
    return next((match.end() for match in _TABLE.finditer(page, at) if match[2]), None)


class _Open:
    """A table that is being read: its rows are handed out as soon as they end."""

    def __init__(self, number: int):
        self.number, self.row_no, self.cells = number, -1, None
        self.hanging: dict[int, tuple[str, int, str | None]] = {}  # column -> text, rows still to fill, fault

    def end_row(self) -> Sequence[tuple[int, int, int, str, str | None]]:
        if self.cells is None:
            return ()
        self.row_no += 1
        row = {c: (text, fault) for c, (text, _, fault) in self.hanging.items()}
        if row:
            self.hanging = {c: (text, left - 1, fault) for c, (text, left, fault) in self.hanging.items() if left > 1}
        column = 0
        for words, height, width, fault in self.cells:
            text = "".join("".join(words).split())
            while column in row:
                column += 1
            for c in range(column, column + width):
                row[c] = (text, fault)
                if height > 1:
                    self.hanging[c] = (text, height - 1, fault)
            column += width
        self.cells = None
        return [(self.number, self.row_no, c, *row[c]) for c in sorted(row)]


def cells_of(page: str) -> Iterator[tuple[int, int, int, str, str | None]]:
    """(table_no, row_no, col_no, text, reject) of every cell of every table, in the order in which rows end.

    One pass with a stack of open tables: a nested table is a table of its own, numbered where it opens, and its text belongs
    to the cell around it as well. Row and column spans are expanded over the rows that exist. Ends that are missing are
    taken from what follows. White space goes, character references are read.
    """
    opened = at = 0
    while (first := _next_table(page, at)) is not None:
        stack = [_Open(opened)]
        opened += 1
        at = len(page)
        for match in _PARTS.finditer(page, first):
            kind = match.lastindex
            if kind == 5:
                _, _, end, tag, attributes = match.groups()
                tag = tag.lower()
                if tag == "td" or tag == "th":
                    if not end:
                        table = stack[-1]
                        if table.cells is None:
                            table.cells = []
                        table.cells.append(([], *_spans(attributes)) if attributes else ([], 1, 1, None))
                elif tag == "tr":
                    yield from stack[-1].end_row()
                    if not end:
                        stack[-1].cells = []
                elif not end:
                    stack.append(_Open(opened))
                    opened += 1
                else:
                    yield from stack.pop().end_row()
                    if not stack:
                        at = match.end()
                        break
            elif kind == 1 or match.end() - match.start() == 1:
                words = entities.unescape(match[0])
                for table in stack:
                    if table.cells:
                        table.cells[-1][0].append(words)
        while stack:
            yield from stack.pop().end_row()


#: Cells of a page that Python hands over in one list, and rows of a batch.
HANDED = 4096
_CELL = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("table_no", "row_no", "col_no")), *(T.StructField(c, T.StringType()) for c in ("text", "reject"))])


def _cell_lists(batches: Iterator):
    """Rows of (other columns, html) as (other columns, list of cells); a page of many cells gives several rows."""
    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        beside = batch.column_names[:-1]
        rows, ends, cells = [], [0], []

        def out():
            columns = zip(*cells) if cells else [()] * len(kinds)
            fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_CELL.names)
            kept = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(beside))]
            return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=batch.schema.names)

        for k, page in enumerate(batch.column(len(beside))):
            for cell in cells_of(page.as_py()):
                if len(cells) - ends[-1] == HANDED:
                    rows.append(k)
                    ends.append(len(cells))
                    if len(cells) >= 8 * HANDED:
                        yield out()
                        rows, ends, cells = [], [0], []
                cells.append(cell)
            if len(cells) > ends[-1]:
                rows.append(k)
                ends.append(len(cells))
            if len(cells) >= 8 * HANDED:
                yield out()
                rows, ends, cells = [], [0], []
        if rows:
            yield out()


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with one row per table cell: table_no, row_no, col_no, text and reject.

    ``reject`` says what is wrong with a cell's span (it is then taken as the nearest of 1 to 100); readers refuse the table.
    Only pages with a table reach Python, a batch at a time; their cells come back in lists of at most ``HANDED``, which a
    lateral join with a table function makes rows. A page without tables, or a null one, gives none.
    """
    names = [c for c in pages.columns if c != html]
    listed = max(["_cells", *(f"_{c}" for c in names)], key=len)  # longer than any column's name
    once = pages.select(*names, F.explode(F.array(html)).alias(listed))  # a page that is made by an expression is made once
    kept = once.where(F.col(listed).rlike(r"(?i)<table\b"))
    kind = T.StructType([*kept.select(*names).schema.fields, T.StructField(listed, T.ArrayType(_CELL))])
    return kept.mapInArrow(_cell_lists, kind).lateralJoin(pages.sparkSession.tvf.inline(F.col(listed).outer())).select(*names, *_CELL.names)


# ---- layouts -----------------------------------------------------------------------------------------------------

# Fixed values. Of each layout: the texts its page must have, the month in a header (year, month as groups; {y} is the report's year), headers that
# name what a column holds ({m} is the report's month), the rows that count (label, key of each kind of column), how a value is written, signs
# of an absent value, and how many months there must be.
LAYOUTS: dict[str, dict] = {
    "price": {"page": (), "month": None, "columns": ((r"环比涨跌幅", "mom"), (r"^(?!.*月).*同比涨跌幅", "yoy")),
              "rows": ((r"^居民消费价格$", {"mom": "cpi_mom", "yoy": "cpi_yoy"}), (r"^(?:一、)?工业生产者出厂价格$", {"mom": "ppi_mom", "yoy": "ppi_yoy"})),
              "value": r"^([+-]?\d+(?:\.\d+)?)$", "absent": None, "months": None},
    "stock": {"page": ("社会融资规模存量统计表", "万亿元人民币"), "month": r"^({y})[.](\d{1,2})$", "columns": ((r"^增速(?:（%）|\(%\))$", "rate"),),
              "rows": ((r"^社会融资规模存量(?:AFRE\(stock\))?$", {"rate": "tsf_stock_yoy"}),), "value": r"^(-?\d+(?:\.\d+)?)$", "absent": r"^[—-]?$", "months": None},
    "backcast": {"page": ("2025年1月份", "按可比口径回溯", "2024年"), "month": r"^(2024)[.](\d{1,2})$", "columns": ((r"^2024[.]\d{1,2}$", "rate"),),
                 "rows": ((r"^同比增速$", {"rate": "m1_yoy"}),), "value": r"^(-?\d+(?:\.\d+)?)%$", "absent": None, "months": 12},
    "trade": {"page": ("亿元人民币",), "month": None, "columns": ((r"^{m}月$", "amount"), (r"^{m}月与去年同期同比增减±%$", "rate")),
              "rows": ((r"^进出口总值$", {"amount": "total"}), (r"^出口总值$", {"amount": "exports", "rate": "export_yoy"}),
                       (r"^进口总值$", {"amount": "imports", "rate": "import_yoy"}), (r"^进出口差额$", {"amount": "balance"})),
              "value": r"^(-?\d+(?:\.\d+)?)%?$", "absent": None, "months": None},
}
#: Rounding that the sums of a trade table may show.
TRADE_ROUNDING = 0.21


def _by_layout(make) -> Column:
    """``make(layout)`` for the layout of the row; null where it gives None."""
    out = None
    for name, layout in LAYOUTS.items():
        value = make(layout)
        if value is not None:
            out = F.when(F.col("layout") == name, value) if out is None else out.when(F.col("layout") == name, value)
    return out


def table_facts(reports: DataFrame) -> DataFrame:
    """(report_id, key, period, value, status) of the values that the tables of reports state under their headers.

    ``reports`` has report_id, layout (a name of ``LAYOUTS``), period (month as a number) and html. A column's month and
    kind are those of the last header above a cell, in its own column, so headers may have several rows. ``status`` is ``ok``; ``wrong page`` where
    the texts of the layout are missing; ``bad span`` where a span of the table is refused; ``no month`` without a month above; ``bad value`` for
    other signs than a number; ``nothing found`` (one row) for a report of a layout without such a cell; ``out of range``; ``conflict`` where tables differ; ``incomplete`` without all months or rows of
    the layout; ``not reconciled`` where the sums of a trade table do not agree. The last three refuse all values of the report. Values are null
    where none can be read.

    Cells are made once and dealt by report once; headers are windows over a table's columns, labels over its rows, so a window
    holds one table. A mark of every report goes beside its values, and stays alone where nothing is found.
    """
    year, month = F.floor(F.col("period") / 12).cast("string"), (F.col("period") % 12 + 1).cast("string")
    page = F.regexp_replace("html", r"<[^>]*>|\s+", "")
    told = _by_layout(lambda l: F.array(*[F.contains(page, F.lit(t)) for t in l["page"]]) if l["page"] else None)
    known = reports.where(F.col("layout").isin(*LAYOUTS)).select(
        "report_id", "layout", "period", F.coalesce(~F.exists(told, lambda t: ~t), F.lit(True)).alias("right_page"), "html")
    cells = table_cells(known)
    text = F.col("text")
    filled = lambda pattern: F.replace(F.replace(F.lit(pattern), F.lit("{y}"), year), F.lit("{m}"), month) if "{y}" in pattern or "{m}" in pattern else F.lit(pattern)
    group = lambda pattern, k: F.call_function("regexp_extract", text, filled(pattern), F.lit(k)).try_cast("int")
    stated = _by_layout(lambda l: l["month"] and F.when(group(l["month"], 2).between(1, 12), group(l["month"], 1) * 12 + group(l["month"], 2) - 1))
    kind = _by_layout(lambda l: F.coalesce(*[F.when(F.rlike(text, filled(p)), name) for p, name in l["columns"]]))
    label = _by_layout(lambda l: F.coalesce(*[F.when(text.rlike(p), k) for k, (p, _) in enumerate(l["rows"])]))
    table = ["report_id", "table_no"]
    above = Window.partitionBy(*table, "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    row = Window.partitionBy(*table, "row_no")
    cells = cells.withColumns({"stated": stated, "kind": kind, "label": F.when(F.col("col_no") == 0, label), "refused": F.col("reject").isNotNull()}).repartition("report_id")
    cells = cells.withColumns({
        "month": F.last("stated", ignorenulls=True).over(above), "column_kind": F.last("kind", ignorenulls=True).over(above),
        "row_label": F.max("label").over(row), "refused": F.max("refused").over(Window.partitionBy(*table))})
    keys = [(n, k, c, key, *map(float, LIMITS.get(key, ()) or (float("-inf"), float("inf")))) for n, l in LAYOUTS.items() for k, (_, own) in enumerate(l["rows"]) for c, key in own.items()]
    keys = F.broadcast(reports.sparkSession.createDataFrame(keys, "layout string, row_label int, column_kind string, key string, low double, high double"))
    written = F.replace(text, F.lit(","), F.lit(""))
    value = _by_layout(lambda l: F.regexp_extract(F.regexp_replace(written, "[−－]", "-"), l["value"], 1).try_cast("double"))
    absent = F.coalesce(_by_layout(lambda l: l["absent"] and text.rlike(l["absent"])), F.lit(False))
    needs_month = F.col("layout").isin(*[n for n, l in LAYOUTS.items() if l["month"]])
    found = cells.where(F.col("row_label").isNotNull() & (F.col("col_no") > 0) & F.col("kind").isNull() & ~absent).join(keys, ["layout", "row_label", "column_kind"]).withColumn("value", value)
    status = (F.when(~F.col("right_page"), "wrong page").when(F.col("refused"), "bad span").when(needs_month & F.col("month").isNull(), "no month")
              .when(F.col("value").isNull(), "bad value").when(~F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True)), "out of range"))
    found = found.select("report_id", "layout", "key", F.when(needs_month, F.col("month")).otherwise(F.col("period")).alias("period"), rounded("value", 3).alias("value"), status.alias("fault"))
    marks = known.select("report_id", F.lit(True).alias("mark"))
    one = found.unionByName(marks, allowMissingColumns=True).groupBy("report_id", "layout", "key", "period").agg(
        F.max("value").alias("value"), F.max("fault").alias("fault"), (F.min("value") != F.max("value")).alias("differs"), F.count("mark").alias("marks"))
    whole = Window.partitionBy("report_id")
    amount = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).over(whole)
    one = one.withColumns({"differs": F.max(F.coalesce("differs", F.lit(False))).over(whole), "n": F.count("key").over(whole),
                           **{k: amount(k) for k in ("total", "exports", "imports", "balance")}})
    off = (F.abs(F.col("total") - F.col("exports") - F.col("imports")) > TRADE_ROUNDING) | (F.abs(F.col("balance") - F.col("exports") + F.col("imports")) > TRADE_ROUNDING)
    months = _by_layout(lambda l: F.lit(l["months"]) if l["months"] else None)
    needed = F.when(F.col("layout") == "trade", F.lit(sum(len(keys) for _, keys in LAYOUTS["trade"]["rows"]))).otherwise(months)
    refused = (F.when(F.col("differs"), "conflict").when(F.col("n") < needed, "incomplete").when((F.col("layout") == "trade") & off, "not reconciled"))
    nothing = F.when((F.col("n") == 0) | F.col("report_id").isNull(), F.array_repeat(F.lit("nothing found"), F.col("marks").cast("int")))
    told = F.when(F.col("key").isNull(), nothing).when(~F.col("key").isin("total", "exports", "imports", "balance"), F.array(F.coalesce("fault", refused, F.lit("ok"))))
    return one.select("report_id", "key", "period", "value", F.explode(told).alias("status"))
