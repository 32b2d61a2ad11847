"""The edge table over several runs, and totals of one pass."""

from pyspark.sql import functions as F

from panelwright.operators import flows
from panelwright.sources import flow_files

SCHEMA = "year int, country_code string, partner_code string, hs2 string, trade_usd double"


def test_a_vanished_year_is_kept_and_marked(spark):
    path = flow_files.fresh_path(spark, "edges")
    raw = spark.createDataFrame([(2020, 1.0), (2021, 2.0), (2022, 3.0)], "year int, raw_usd double")
    runs = [[(2020, 1.0), (2021, 2.0)], [(2021, 2.0), (2022, 3.0)], [(2020, 5.0), (2021, 2.0), (2022, 3.0)]]
    audits, files = [], []
    for run in runs:
        edges = spark.createDataFrame([(y, "A", "B", "01", v) for y, v in run], SCHEMA)
        audits.append({r.year: (r.total_usd, r.current) for r in flow_files.write_edges(edges, path, raw).collect()})
        files.append(set(spark.read.parquet(path).filter("year = 2021").inputFiles()))
    assert audits == [{2020: (1.0, True), 2021: (2.0, True)}, {2020: (1.0, False), 2021: (2.0, True), 2022: (3.0, True)},
                      {2020: (5.0, True), 2021: (2.0, True), 2022: (3.0, True)}]
    assert {f for f in files[0] if "year=2021" in f} == {f for f in files[2] if "year=2021" in f}
    assert {r.year: r.trade_usd for r in spark.read.parquet(path).collect()} == {2020: 5.0, 2021: 2.0, 2022: 3.0}


def test_totals_see_unknown_codes(spark):
    raw = spark.createDataFrame([(1, 2, "010101", 1.0, 2000), (2, 1, "020101", 2.0, 2000), (1, 9, "010101", 4.0, 2001), (1, 2, None, 8.0, 2002)],
                                "i int, j int, k string, v double, t int")
    dim = spark.createDataFrame([(1, "AAA", "a"), (2, "BBB", "b")], "numeric_code int, iso3 string, name string")
    got = {r.year: (r.raw, r.pairs_ok, r.chapters_ok) for r in flows.totals_reconcile(raw, dim).collect()}
    assert got == {2000: (3000.0, True, True), 2001: (4000.0, False, False), 2002: (8000.0, True, True)}
    assert flows.totals_reconcile(raw.limit(0), dim).count() == 0
    plan = flows.totals_reconcile(raw.filter(F.col("v") > 0), dim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") <= 3  # the flows once, the dimension twice
