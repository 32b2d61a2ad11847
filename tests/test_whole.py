"""Queries that once did a part of their job, against statements of the whole job."""

import pytest

from panelwright.operators import financial, flows, panel
from panelwright.plans.registry import inputs, with_views
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
HISTORY = """
WITH ix AS (SELECT country_code AS c, mid, 'nominal' AS measure, nominal AS value FROM index_series
  UNION ALL SELECT country_code, mid, 'real_value', real_value FROM index_series),
s AS (SELECT 'policy' AS series, 10 AS k, country_code AS code, 'policy_rate' AS measure, CAST(floor(mid / 12) AS INT) AS y, mid AS id,
    value, obs_status, CAST(NULL AS DOUBLE) AS value_12m_ago, CAST(NULL AS DOUBLE) AS change_12m_pct FROM policy_series
  UNION ALL SELECT 'credit', 20, CAST(nk AS VARCHAR), measure, CAST(floor(qid / 4) AS INT), qid, value, NULL, NULL, NULL FROM credit_series
  UNION ALL SELECT 'index', 6, a.c, a.measure, CAST(floor(a.mid / 12) AS INT), a.mid, a.value, NULL, b.value, 100 * (a.value / nullif(b.value, 0) - 1)
    FROM ix a LEFT JOIN ix b ON a.c = b.c AND a.measure = b.measure AND a.mid = b.mid + 12)
SELECT s.series, s.code, e.y AS selected_year, measure, id, round(value, 6) + 0.0 AS value, obs_status,
  round(value_12m_ago, 6) + 0.0 AS value_12m_ago, round(change_12m_pct, 6) + 0.0 AS change_12m_pct
FROM s JOIN (SELECT DISTINCT series, code, y FROM s) e ON e.series = s.series AND e.code = s.code AND s.y BETWEEN e.y - k + 1 AND e.y"""


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_history_windows_are_whole(spark, connection):
    import __spark_entry__ as entry

    assert compare(entry.queries()["history_window"](spark, SF), connection, with_views(HISTORY)) == []


@pytest.mark.parametrize("name, years", [("policy", 10), ("credit", 20), ("index", 6)])
def test_history_window_edge(spark, name, years):
    rows = spark.createDataFrame([("A", y * 4) for y in range(1970, 2000)], "code string, id int")
    got = financial.history_window(rows, "id", 4, financial.HISTORY_YEARS[name]).filter("selected_year = 1999")
    assert sorted(r.id // 4 for r in got.collect()) == list(range(2000 - years, 2000))


SECTION_STARTS = [1, 6, 15, 16, 25, 28, 39, 41, 44, 47, 50, 64, 68, 71, 72, 84, 86, 90, 93, 94, 97]


def test_every_chapter_has_its_section(spark):
    chapters = spark.createDataFrame([(f"{k:02d}",) for k in range(1, 100)], "hs2 string")
    got = {int(r.hs2): r.section for r in flows.range_lookup(chapters, flows.section_names(spark)).collect()}
    assert len(got) == 99 and got[98] is None and got[99] is None and got[15] == "动植物油脂" and got[97] == "艺术品与古物"
    starts = [k for k in range(1, 98) if k == 1 or got[k] != got[k - 1]]
    assert starts == SECTION_STARTS and len({got[k] for k in range(1, 98)}) == 21


def test_sections_of_the_query(spark, connection):
    import __spark_entry__ as entry

    cases = " ".join(f"WHEN CAST(hs2 AS INT) BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in flows.SECTIONS)
    sql = f"SELECT year, hs2, CASE {cases} END AS section, round(sum(trade_usd), 4) + 0.0 AS trade_usd FROM flow_edges GROUP BY ALL"
    assert compare(entry.queries()["range_lookup"](spark, SF), connection, with_views(sql)) == []


def test_profile_has_every_country_and_indicator(spark):
    macro = inputs(spark, SF).macro_long
    seen = macro.filter("country_code IS NOT NULL").select("country_code", "indicator_code").distinct()
    got = panel.macro_profile(macro, 5).select("country_code", "indicator_code").distinct()
    assert seen.select("country_code").distinct().count() > 5 and seen.exceptAll(got).count() == 0
