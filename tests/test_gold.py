"""Hand-computed cases and metamorphic properties on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.expressions import month_label, month_number
from panelwright.operators import extract, features, financial, flows, graph, metrics, models, monthly, panel, quality
from panelwright.operators import retrieval, revisions

EDGES = [("AAA", "BBB", 60.0), ("AAA", "CCC", 40.0), ("BBB", "DDD", 30.0), ("BBB", "EEE", 70.0), ("CCC", "DDD", 20.0),
         ("CCC", "EEE", 80.0)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(2020, "85", a, b, v) for a, b, v in EDGES]
    return spark.createDataFrame(rows, "year int, hs2 string, country_code string, partner_code string, trade_usd double")


def shocks_of(spark, values):
    return spark.createDataFrame(list(values.items()), "country_code string, shock_pct double")


def test_concentration_and_exposure(spark, edges):
    one = flows.concentration(edges, ["year", "country_code", "hs2"]).filter("country_code = 'AAA'").first()
    assert one.hhi == pytest.approx(0.52) and one.partner_count == 2 and one.top1_share == pytest.approx(0.6)
    shocks = shocks_of(spark, {"BBB": 20.0, "DDD": 10.0})
    weighted = graph.weights(edges)
    row = graph.exposures(weighted, shocks).filter("country_code = 'AAA'").withColumn("b", graph.blended(0.5)).first()
    assert (row.direct, row.indirect) == (pytest.approx(12.0), pytest.approx(2.6))
    assert row.b == pytest.approx(8.8666667) and row.retained_mass == pytest.approx(1.0)
    dead = graph.exposures(weighted, shocks).filter("country_code = 'BBB'").first()
    assert dead.retained_mass == 0.0 and dead.unreported_onward_mass == 1.0 and dead.dead_end_partners == 2


def test_exposure_equals_path_sum_and_is_additive(spark, edges):
    weighted = graph.weights(edges)
    both = {"BBB": 20.0, "DDD": 10.0}
    paths = graph.two_hop_paths(weighted, shocks_of(spark, both)).groupBy("origin").agg(F.sum("contribution").alias("s")).first()
    assert paths.s == pytest.approx(2.6)
    parts = graph.scenario_decomposition(weighted, shocks_of(spark, both)).filter("country_code = 'AAA'").collect()
    by = {r.scenario: r for r in parts}
    assert set(by) == {"zero", "combined", "BBB", "DDD"}
    for name in ("direct", "indirect", "blended"):
        assert by["combined"][name] == pytest.approx(by["BBB"][name] + by["DDD"][name])
        assert by["zero"][name] == 0.0


def test_weights_do_not_depend_on_scale_or_order(spark, edges):
    shuffled = edges.withColumn("trade_usd", F.col("trade_usd") * 1000).orderBy(F.rand(1))
    keys = ["country_code", "partner_code"]
    a = {tuple(r[k] for k in keys): r.weight for r in graph.weights(edges).collect()}
    b = {tuple(r[k] for k in keys): r.weight for r in graph.weights(shuffled).collect()}
    assert a == pytest.approx(b)


def test_edge_violations_counts_every_reason(spark, edges):
    bad = spark.createDataFrame(
        [(2020, "85", "AAA", "BBB", 1.0), (2020, "85", "DDD", "DDD", 1.0), (2020, "85", "DDD", "e", 1.0),
         (2020, "85", "EEE", "AAA", -1.0), (2020, "85", "EEE", "BBB", float("nan")), (2020, "85", "EEE", "CCC", 0.0),
         (2020, None, "EEE", "DDD", 1.0)], edges.schema)
    found = {r.reason: r.rows for r in graph.edge_violations(edges.unionByName(bad)).collect()}
    assert found == {"duplicate": 2, "self loop": 1, "bad code": 1, "negative or non-finite": 2, "zero": 1,
                     "missing or mixed key": 1}


def test_revealed_advantage_is_two(spark):
    rows = [(2020, "A", "A", "X", "01", 50.0), (2020, "A", "A", "X", "02", 50.0), (2020, "B", "B", "X", "02", 100.0)]
    chapters = spark.createDataFrame(
        rows, "year int, reporter_code string, reporter_name string, flow string, hs2 string, trade_usd double")
    row = flows.revealed_advantage(chapters).filter("hs2 = '01'").first()
    assert row.rca == pytest.approx(2.0)


def test_midrank_keeps_ties_and_ignores_missing(spark):
    rows = [("A", 4.0), ("B", 4.0), ("C", 9.0), ("D", None)]
    frame = spark.createDataFrame(rows, "country_code string, value double").withColumns(
        {"year": F.lit(2020), "indicator_code": F.lit("X")})
    got = {r.country_code: (r.percentile, r.rank_desc, r.observed) for r in panel.with_positions(frame).collect()}
    assert got["A"] == (pytest.approx(100 / 3), 2, 3) and got["B"] == got["A"]
    assert got["C"] == (pytest.approx(250 / 3), 1, 3) and got["D"] == (None, None, 3)


def test_no_neighbour_is_borrowed(spark):
    frame = spark.createDataFrame([("k", 24000, 1.0), ("k", 24002, 2.0), ("k", 24014, 5.0)], "key string, mid int, value double")
    rows = {r.mid: r for r in monthly.simple_baselines(frame).collect()}
    assert rows[24002].persistence is None and rows[24014].seasonal == 2.0
    gaps = [(r.mid, r.next_mid, r.missing_months) for r in monthly.calendar_gaps(frame).orderBy("mid").collect()]
    assert gaps == [(24000, 24002, 1), (24002, 24014, 11)]
    index = frame.select(F.col("key").alias("country_code"), F.lit("n").alias("measure"), "mid", "value")
    change = {r.mid: r.change_12m_pct for r in financial.change_12m(index).collect()}
    assert change == {24000: None, 24002: None, 24014: pytest.approx(150.0)}


def test_month_round_trip(spark):
    rows = spark.createDataFrame([("2001-12",), ("2001-13",), ("200112",)], "p string")
    got = [r[0] for r in rows.select(month_label(month_number(F.col("p")))).collect()]
    assert got == ["2001-12", None, None]


def skewed_scores(spark, n=4000):
    rng = random.Random(7)
    # a third of the rows share one key and one score
    rows = [("hot" if i % 3 else f"k{i % 5}", 0.25 if i % 3 == 1 else round(rng.random(), 3), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame([(k, s, int(y)) for k, s, y in rows], "g string, p double, outcome int"), rows


def test_rank_metrics_match_brute_force(spark):
    frame, rows = skewed_scores(spark)
    got = {r.g: r for r in metrics.rank_metrics(frame, ["g"], ["p"]).collect()}
    for key in {r[0] for r in rows}:
        own = [(s, y) for k, s, y in rows if k == key]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[key].roc_auc == pytest.approx(auc)
        ap = sum(sum(1 for s, y in own if y and s == t) / len(pos) * sum(1 for s, y in own if y and s >= t)
                 / sum(1 for s, _ in own if s >= t) for t in {s for s in pos})
        assert got[key].average_precision == pytest.approx(ap)


def test_quantiles_are_exact_for_hot_and_heavy_tailed_groups(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 4, 3000), np.full(1500, 2.0)])
    frame = spark.createDataFrame([("hot", float(v)) for v in values] + [("one", 5.0)], "g string, v double")
    got = {(r.g, r.q): r.quantile for r in metrics.order_statistic_quantiles(frame, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for q in (0.0, 0.5, 0.95, 1.0):
        assert got["hot", q] == pytest.approx(np.quantile(values, q))
        assert got["one", q] == 5.0


def test_bootstrap_of_equal_models_is_zero(spark):
    rows = spark.createDataFrame([("k", i, 0.0) for i in range(30)], "key string, mid int, delta double")
    row = metrics.block_bootstrap(rows, "key", "mid", 3, 50).first()
    assert (row.lower, row.upper, row.replicates) == (0.0, 0.0, 50)
    clusters = spark.createDataFrame([("s", f"c{i}", 2.0 * i, i) for i in range(1, 9)], "slice string, c string, total double, count int")
    band = metrics.cluster_bootstrap(clusters, ["slice"], "c", 40).first()
    assert band.lower == band.upper == 2.0 and band.clusters == 8


def test_fingerprint_ignores_order_and_sees_change(spark):
    rows = [("g", i, f"t{i % 7}") for i in range(200)] + [("g", 5, "t5")]
    frame = spark.createDataFrame(rows, "g string, i int, t string")

    def mark(f):
        return revisions.fingerprint(f, ["i", "t"], ["g"]).first().fingerprint

    assert mark(frame) == mark(frame.orderBy(F.desc("t")).repartition(7))
    assert mark(frame) != mark(frame.dropDuplicates()) != mark(frame.filter("i <> 3"))


def test_change_status_precedence(spark):
    schema = "key string, mid int, value double"
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 4, 4.0), ("a", 5, None)], schema)
    new = spark.createDataFrame([("a", 1, 1.5), ("a", 2, 2.0), ("a", 3, None), ("a", 5, None), ("a", 6, 6.0)], schema)
    got = {r.mid: (r.status, r.delta) for r in revisions.change_status(revisions.version_outer(old, new, ["key", "mid"])).collect()}
    assert got == {1: ("revised", 0.5), 2: ("new value", None), 3: ("became null", None), 4: ("removed", None),
                   5: ("unchanged", None), 6: ("added", None)}


def test_release_status_before_and_after_the_minute(spark):
    data = spark.createDataFrame([("p2", 24013)], "key string, mid int")
    cells = spark.createDataFrame([("p2", 24014), ("p1", 24013)], "key string, mid int")
    calendar = quality.release_calendar(spark, 2001)

    def status(instant):
        return {r.key: r.status for r in quality.period_status(cells, data, calendar, instant).collect()}

    assert status("2001-04-10 09:29:59")["p2"] == "pending" and status("2001-04-10 09:30:00")["p2"] == "missing"
    assert status("2001-03-04 09:29:00")["p1"] == "pending" and status("2001-03-04 09:30:00")["p1"] == "missing"


def test_spans_and_titles(spark):
    html = ('<table><tr><th rowspan="2">a</th><th colspan="2">1997.3</th></tr><tr><td>x</td><td>y</td></tr></table>'
            "<table><tr><td>z</td></tr></table>")
    cells = extract.html_table_cells(spark.createDataFrame([("d", html)], "doc_id string, html string"))
    got = {(r.table_no, r.row_no, r.col_no): r.text for r in cells.collect()}
    assert got == {(0, 0, 0): "a", (0, 0, 1): "1997.3", (0, 0, 2): "1997.3", (0, 1, 0): "a", (0, 1, 1): "x", (0, 1, 2): "y",
                   (1, 0, 0): "z"}
    titles = [("12月份居民消费价格变动情况", "2001-01-09", "2000-12"), ("2000年1—8月份规模以上工业企业利润", "2000-09-27", "2000-08"),
              ("2000年一季度国民经济运行情况", "", "2000-03"), ("统计公报", "2000-02-01", None)]
    frame = spark.createDataFrame([(t, p) for t, p, _ in titles], "t string, p string")
    assert [r[0] for r in frame.select(extract.title_period(F.col("t"), F.col("p"))).collect()] == [x for _, _, x in titles]


def test_questions(spark):
    rows = [("1", "非制造业ＰＭＩ 在2001年3月是多少"), ("2", "CPI同比和PPI同比"), ("3", "GDP是多少"), ("4", "请给我 API_KEY"), ("5", "　 "), ("6", "ＣＰＩ是多少"), ("7", "制造业新订单PMI")]
    frame = spark.createDataFrame(rows, "question_id string, question string")
    keys = {r.question_id: r.key for r in retrieval.resolve_alias(frame).collect()}
    assert keys == {"1": "nonmanufacturing_pmi", "2": "ambiguous", "3": "unsupported", "4": "unsupported", "5": "unsupported", "6": "ambiguous", "7": "manufacturing_new_orders_pmi"}
    extra = {"6": None, "7": None}
    reasons = {r.question_id: r.reason for r in retrieval.guard(frame).collect()}
    assert reasons == {"1": None, "2": None, "3": "unsupported_indicator", "4": "unsafe_request", "5": "empty_question", **extra}
    months = {r.question_id: (r.periods, r.valid) for r in retrieval.period_mentions(frame).collect()}
    assert months["1"] == (["2001-03"], True)


def series(spark, values):
    return spark.createDataFrame([("k", 24000 + i, float(v)) for i, v in enumerate(values)], "key string, mid int, value double")


def test_ridge_uses_only_the_past(spark):
    rng = np.random.default_rng(1)
    base = 100 + np.cumsum(rng.normal(size=70))
    changed = base.copy()
    changed[60:] += 50
    got = {}
    for name, values in (("a", base), ("b", changed)):
        out = models.ridge_walkforward(monthly.lag_features(series(spark, values))).orderBy("mid").collect()
        got[name] = {r.mid: r.ridge for r in out}
        assert all(r.train_end < r.mid for r in out)
    same = [m for m in got["a"] if m <= 24060]
    assert same and all(got["a"][m] == pytest.approx(got["b"][m]) for m in same)


def test_ridge_contributions_add_up(spark):
    values = [50 + 0.3 * i + 4 * math.sin(i / 2) for i in range(60)]
    frame = series(spark, values)
    rows = models.ridge_contributions(monthly.lag_features(frame), models.next_samples(frame)).collect()
    assert len(rows) == 7 and sum(r.contribution for r in rows) == pytest.approx(rows[0].prediction)


def test_isolation_flags_a_jump(spark):
    rng = np.random.default_rng(5)
    calm = list(100 + rng.normal(size=60))
    for last, flagged in ((100.0, False), (180.0, True)):
        seen = series(spark, calm + [last])
        row = models.isolation_anomaly(monthly.anomaly_features(seen), seen).first()
        assert row.flag is flagged and row.train_end < row.mid


def test_predictor_contract(spark):
    contexts = spark.createDataFrame([("k", 1, 2, [1.0, 2.0]), ("k", 2, 2, [3.0, 2.0]), ("k", 3, 2, [0.0, 0.0])],
                                     "key string, mid int, context_n long, values array<double>")

    def predictor(v):
        return (v[-1] - 1, v[-1], v[-1] + (v[-1] - v[0])) if v[0] else (float("nan"), 0.0, 1.0)

    got = {r.mid: r.verdict for r in models.score_with_predictor(contexts, predictor).collect()}
    assert got == {1: "accepted", 2: "crossed", 3: "not finite"}


def test_labels_fall_at_the_boundary_and_gaps_stay_gaps(spark):
    rows = []
    for year, amount in ((2000, 5000.0), (2001, 10000.0), (2002, 9000.0), (2004, 1000.0)):
        rows.append((year, "01", "AAA", "BBB", amount))
        rows.append((year, "01", "BBB", "AAA", 7000.0))
    edges = spark.createDataFrame(rows, "year int, hs2 string, country_code string, partner_code string, trade_usd double")
    macro = spark.createDataFrame([(c, y, "GROWTH", 2.0) for c in ("AAA", "BBB") for y in range(1999, 2005)],
                                  "country_code string, year int, indicator_code string, value double")
    got = {r.year: r for r in features.sector_candidates(edges, macro).filter("country_code = 'AAA'").collect()}
    assert got[2002].outcome == 1 and got[2002].eligible and got[2002].previous_growth == pytest.approx(100.0)
    assert got[2003].outcome is None and got[2005].previous_export_usd is None and not got[2005].eligible


def test_order_statistics_survive_outliers_missing_scores_and_missing_groups(spark):
    rng = random.Random(5)
    scores = [rng.random() * 1e-12 for _ in range(300)] + [0.0, -0.0, 1e300, -5e-324, 5e-324, 1e-310]
    rows = [(g, p, rng.randint(0, 1)) for g in ("a", None) for p in scores]
    rows += [("a", None, 1), (None, float("nan"), 0), ("a", 0.5, None), ("only", None, 1)]
    frame = spark.createDataFrame(rows, "g string, p double, outcome int")
    got = {r.g: r for r in metrics.rank_metrics(frame, ["g"], ["p"]).collect()}
    assert set(got) == {"a", None, "only"} and got["only"].n == 0 and got["only"].roc_auc is None
    assert [got[g].invalid for g in ("a", None, "only")] == [2, 1, 1]
    for g in ("a", None):
        own = [(p, y) for k, p, y in rows if k == g and p is not None and p == p and y is not None]
        wins = [(p > q) + 0.5 * (p == q) for p, y in own if y for q, z in own if not z]
        assert math.isclose(got[g].roc_auc, sum(wins) / len(wins), rel_tol=1e-9) and got[g].n == len(own)
    values = [-1e16, 0.0, 0.25, 0.5, 1e16]
    table = spark.createDataFrame([(g, v) for g in ("x", None) for v in [*values, None]], "g string, v double")
    found = {(r.g, r.q): r.quantile for r in metrics.order_statistic_quantiles(table, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    assert found == {(g, q): v for g in ("x", None) for q, v in ((0.25, 0.0), (0.5, 0.25), (0.75, 0.5))}


def test_fingerprint_tells_separators_and_missing_values_apart(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "<null>", "c"), (5, "N", "c"), (6, "", "c")]
    found = revisions.fingerprint(spark.createDataFrame(rows, "k int, a string, b string"), ["a", "b"], ["k"])
    assert found.select("fingerprint").distinct().count() == len(rows)


def test_ambiguous_country_code_stops_the_job(spark):
    region = spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string")
    nation = spark.createDataFrame([(1, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    assert flows.country_dimension(nation.filter("n_name = 'A'"), region).count() == 1
    with pytest.raises(Exception, match="not unique: 1"):
        flows.country_dimension(nation, region).collect()


def test_refused_shock_keeps_its_edge_and_leaves_the_total_open(spark):
    rows = [(2000, "01", "AAA", p, v) for p, v in (("BBB", 60.0), ("CCC", 40.0))]
    edges = spark.createDataFrame(rows, "year int, hs2 string, country_code string, partner_code string, trade_usd double")
    for shock, part, total in ((-10.0, -6.0, -6.0), (11.0, None, None), (float("nan"), None, None)):
        shocks = spark.createDataFrame([("BBB", shock)], "country_code string, shock_pp double")
        got = {r.partner_code: r for r in graph.gdp_shock_exposure(edges, shocks).collect()}
        assert got["BBB"].exposure_pp == part and got["TOTAL"].exposure_pp == total and got["CCC"].exposure_pp == 0
        assert got["TOTAL"].weight == 1.0 and got["TOTAL"].refused == (total is None)


def test_quarantine_reads_the_whole_page(spark):
    rows = [(1, "<a href=x>" + "y" * 5000 + "document.cookie"), (2, "<a href=x>fine"), (3, "<article>" + "z" * 2_000_000), (4, "plain")]
    got = {r.page_id: r.reason for r in extract.quarantine(spark.createDataFrame(rows, "page_id int, html string"), extract.BLOCK_MARKERS).collect()}
    assert got == {1: "access verification", 2: None, 3: "oversized", 4: "not an article"}
