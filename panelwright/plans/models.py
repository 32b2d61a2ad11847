from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import features as feat
from panelwright.operators import metrics
from panelwright.operators import models as op
from panelwright.operators import monthly as mo
from panelwright.operators import panel as panel_op
from panelwright.plans.features import sector_rows
from panelwright.plans.registry import query
from panelwright.session import materialized

TARGETS = [1999, 2000, 2001]


def model_rows(inp):
    return op.prepared(materialized(sector_rows(inp)))


@query("walkforward_logistic")
def walkforward_logistic(inp):
    scored = op.walkforward_classifier(model_rows(inp), TARGETS, "logistic")
    return scored.withColumn("logistic", F.round("logistic", 4))


@query("walkforward_gbt_classifier")
def walkforward_gbt_classifier(inp):
    rows = model_rows(inp)
    full = op.walkforward_classifier(rows, TARGETS, "joint_trees")
    trade = op.walkforward_classifier(rows, TARGETS, "trade_only_trees").drop("outcome")
    scored = full.join(trade, feat.KEYS)
    return metrics.probability_metrics(scored, ["year"], ["joint_trees", "trade_only_trees"])


@query("geo_holdout_eval")
def geo_holdout_eval(inp):
    rows = model_rows(inp)
    held = rows.select("country_code").distinct().filter(panel_op.hash_holdout(F.col("country_code")))
    return op.geographic_holdout(rows, held, 2000)


def panel_with_median(inp):
    center = panel_op.trailing_median(inp.macro_long, "GROWTH").select("country_code", "year", F.col("center").alias("median5"))
    return materialized(feat.panel_lags(inp.macro_long).join(center, ["country_code", "year"], "left").withColumn(
        "median5", F.coalesce("median5", "lag_own_gdp")))


@query("walkforward_gbt_regressor")
def walkforward_gbt_regressor(inp):
    panel = materialized(feat.panel_lags(inp.macro_long))
    return op.walkforward_panel(panel, TARGETS)


@query("reference_panel_models")
def reference_panel_models(inp):
    scored = op.walkforward_panel(panel_with_median(inp), TARGETS, methods=("trees", "ridge", "residual_trees"))
    split = F.when(F.col("year") < 2001, "development").otherwise("holdout")
    errors = metrics.long_errors(scored.withColumn("split", split), ["country_code", "split"],
                                 ["persistence", "median5", "trees", "ridge", "residual_trees"], "actual")
    return metrics.mae_rmse(errors, ["split", "method"])


@query("permutation_importance")
def permutation_importance(inp):
    return op.permutation_importance(model_rows(inp), 2000)


@query("ridge_walkforward")
def ridge_walkforward(inp):
    return op.ridge_walkforward(mo.lag_features(inp.monthly_obs))


@query("ridge_contributions")
def ridge_contributions(inp):
    return op.ridge_contributions(mo.lag_features(inp.monthly_obs), op.next_samples(inp.monthly_obs))


@query("mixture_regime_risk")
def mixture_regime_risk(inp):
    return op.mixture_regime_risk(mo.cycle_features(inp.monthly_obs, 3), 3, 36, 18)


@query("candidate_logistic_risk")
def candidate_logistic_risk(inp):
    return op.candidate_logistic_risk(mo.cycle_features(inp.monthly_obs, 3), 3, 36, 18)


@query("isolation_anomaly")
def isolation_anomaly(inp):
    return op.isolation_anomaly(mo.anomaly_features(inp.monthly_obs), inp.monthly_obs)


def persistence_band(values):
    """Contract example: last value with the spread of the last year; crossed when the year was falling."""
    return values[-1] - 1.0, values[-1], values[-1] + (values[-1] - values[-12])


@query("score_with_predictor", """
WITH p AS (SELECT a.key, a.mid, count(b.mid) AS context_n, arg_max(b.value, b.mid) AS y, list(b.value ORDER BY b.mid) AS l, max(b.mid) AS last FROM monthly_obs a JOIN monthly_obs b ON a.key = b.key AND b.mid < a.mid GROUP BY a.key, a.mid)
SELECT key, mid, context_n, round(y - 1, 6) + 0.0 AS p10, round(y, 6) + 0.0 AS p50, round(y + (y - l[len(l) - 11]), 6) + 0.0 AS p90, CASE WHEN y - l[len(l) - 11] >= 0 THEN 'accepted' ELSE 'crossed' END AS verdict
FROM p WHERE context_n BETWEEN 36 AND 60 AND last = mid - 1""")
def score_with_predictor(inp):
    scored = op.score_with_predictor(mo.prefix_context(inp.monthly_obs), persistence_band)
    return scored.withColumns({c: rounded(c, 6) for c in ("p10", "p50", "p90")})
