"""Pooled models with one feature, whose fits have a closed form that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import pooled as po
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs

K, ONE = pn.K, ["quantity"]

FRAME = f"""{pn.LINE}, num AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q_idx) AS rn FROM line),
  t AS (SELECT CAST(h AS INTEGER) AS horizon, o.entity, o.q_idx, o.quantity AS x, y.price AS y FROM num o CROSS JOIN range(1, 4) AS g(h) JOIN num y ON y.entity = o.entity AND y.rn = o.rn + h)"""
MOMENTS = "count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c"
SLOPE = "sign(c) * greatest(abs(c / sqrt(vx)) - a * l, 0) / (1 + a * (1 - l)) / sqrt(vx)"
ALPHA = ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(po.ALPHAS))
RATIO = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(po.L1_RATIOS))
NETS = f"""{FRAME}, cal0 AS (SELECT horizon, q_idx, row_number() OVER (PARTITION BY horizon ORDER BY q_idx) - 1 AS k, count(*) OVER (PARTITION BY horizon) AS n FROM (SELECT DISTINCT horizon, q_idx FROM t)),
  f AS (SELECT horizon, q_idx, CAST(CASE WHEN n // 5 = 0 OR k < n - 4 * (n // 5) THEN 0 ELSE (k - (n - 4 * (n // 5))) // (n // 5) + 1 END AS INTEGER) AS fold FROM cal0),
  rws AS (SELECT t.*, fold FROM t JOIN f USING (horizon, q_idx)), blk AS (SELECT horizon, fold, {MOMENTS} FROM rws GROUP BY 1, 2),
  trn AS (SELECT b.horizon, b.fold, {MOMENTS} FROM (SELECT horizon, fold FROM blk WHERE fold > 0) b JOIN rws ON rws.horizon = b.horizon AND rws.fold < b.fold GROUP BY 1, 2),
  grid AS (SELECT ai * {len(po.L1_RATIOS)} + ri AS i, a, l FROM (VALUES {ALPHA}) AS u(ai, a) CROSS JOIN (VALUES {RATIO}) AS v(ri, l)),
  tried AS (SELECT trn.*, grid.i, a, l, {SLOPE} AS w FROM trn CROSS JOIN grid),
  rated AS (SELECT horizon, i, a, l, avg(blk.vy - 2 * w * blk.c + w * w * blk.vx + pow(blk.my - (tried.my - w * tried.mx) - w * blk.mx, 2)) AS mse FROM tried JOIN blk USING (horizon, fold) GROUP BY 1, 2, 3, 4),
  best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mse, i) = 1),
  every AS (SELECT * FROM trn UNION ALL SELECT horizon, 0, {MOMENTS} FROM t GROUP BY 1),
  nets AS (SELECT horizon, fold, a, l, mse, n, {SLOPE} AS w, my - ({SLOPE}) * mx AS b0 FROM every JOIN best USING (horizon))"""


def one_feature(spark, d):
    panel = pn.line_panel(spark, d)
    frame = po.with_time_folds(po.direct_frame(panel, K, "price", ONE, [1, 2, 3]))
    return panel, frame, po.tune_direct(frame, ONE)


@query(
    "one_feature_nets",
    f"WITH {NETS} SELECT horizon, fold, {r('a', 'alpha')}, {r('l', 'l1_ratio')}, {r('mse', 'cv_mse')}, n AS train_rows, {r('b0', 'intercept')}, {r('w', 'b_quantity')}, true AS converged FROM nets",
)
def one_feature_nets(spark, d):
    """The whole grid of 70 penalties tuned over four chronological folds, with one feature."""
    f = one_feature(spark, d)[2]
    return f.select("horizon", "fold", "alpha", "l1_ratio", "cv_mse", "train_rows", "intercept", F.col("coefficients")[0].alias("b_quantity"), "converged")


@query(
    "one_feature_residuals",
    f"WITH {NETS} SELECT entity, q_idx AS origin_q, horizon, fold, {r('y - b0 - w * x', 'residual')} FROM rws JOIN nets USING (horizon, fold) WHERE fold > 0",
)
def one_feature_residuals(spark, d):
    """Out-of-fold residuals under the fit of each block's own earlier rows."""
    _, frame, fits = one_feature(spark, d)
    return po.oof_residuals(frame, fits, K, ONE)


@query(
    "one_feature_forecasts",
    f"""WITH {NETS}, last AS (SELECT * FROM line QUALIFY q_idx = max(q_idx) OVER (PARTITION BY entity))
        SELECT entity, q_idx AS origin_q, horizon, CAST(q_idx + horizon AS INTEGER) AS target_q, {r('b0 + w * quantity', 'forecast')} FROM last CROSS JOIN (SELECT * FROM nets WHERE fold = 0)""",
)
def one_feature_forecasts(spark, d):
    """All horizons from each entity's latest row."""
    panel, _, fits = one_feature(spark, d)
    return po.predict_latest(panel, fits, K, ONE, [1, 2, 3])


@query("one_feature_terms", f"WITH {NETS} SELECT horizon, count(*) FILTER (abs(w) > 1e-9) AS nonzero, count(*) AS terms FROM nets WHERE fold = 0 GROUP BY 1")
def one_feature_terms(spark, d):
    """Non-zero terms of the final fits."""
    return po.nonzero_coefficients(one_feature(spark, d)[2], ONE)


A, L = 0.01, 0.5
WALK = f"""{FRAME}, o AS (SELECT DISTINCT horizon, q_idx AS origin_q FROM t WHERE q_idx >= 1995 * 4),
  m AS (SELECT o.horizon, origin_q, {MOMENTS} FROM o JOIN t ON t.horizon = o.horizon AND t.q_idx + t.horizon <= origin_q GROUP BY 1, 2 HAVING count(*) >= 8),
  k AS (SELECT horizon, origin_q, n, {SLOPE} AS w, my - ({SLOPE}) * mx AS b0 FROM m, (SELECT {A}::DOUBLE AS a, {L}::DOUBLE AS l)),
  walk AS (SELECT t.entity, 'elastic_net' AS model, origin_q, horizon, CAST(origin_q + horizon AS INTEGER) AS target_q, y AS actual, b0 + w * x AS forecast, y - b0 - w * x AS error, n AS train_rows
     FROM t JOIN k USING (horizon) WHERE t.q_idx = k.origin_q)"""


def walk(spark, d):
    frame = po.direct_frame(pn.line_panel(spark, d), K, "price", ONE, [1, 2, 3])
    return po.walk_forward_nets(frame, K, ONE, A, L, 1995 * 4)


@query("walk_forward_nets", f"WITH {WALK} SELECT entity, model, origin_q, horizon, target_q, {rs('actual forecast error')}, train_rows, true AS converged FROM walk")
def walk_forward_nets(spark, d):
    """An elastic net refitted at every origin from running sums, scored on the quarter it targets."""
    return walk(spark, d).drop("train_mean")


@query(
    "net_against_mean",
    f"""WITH {WALK}, h AS (SELECT w.*, avg(t.y) AS mean_y FROM walk w JOIN t ON t.horizon = w.horizon AND t.q_idx + t.horizon <= w.origin_q GROUP BY ALL)
        SELECT horizon, count(*) AS n, {r('sqrt(avg(error * error))', 'rmse_net')}, {r('sqrt(avg((actual - mean_y) * (actual - mean_y)))', 'rmse_mean')} FROM h GROUP BY 1""",
)
def net_against_mean(spark, d):
    """The refitted net compared with the pooled mean known at the same origins, on a shared grid."""
    rmse = lambda e: F.sqrt(F.avg(e * e))
    net, mean = rmse(F.col("error")), rmse(F.col("actual") - F.col("train_mean"))
    return walk(spark, d).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), net.alias("rmse_net"), mean.alias("rmse_mean"))


@query(
    "ordinal_pair_sums",
    f"WITH {pn.POLICY} SELECT entity, count(*) AS n, count(*) AS proper, count(*) AS likeliest FROM policy GROUP BY 1",
)
def ordinal_pair_sums(spark, d):
    """One pair fitted on all rows: each of them has three probabilities that add up to one, and the class is the likeliest."""
    rows = pn.policy(spark, d)
    p = po.predict_ordinal_pair(po.fit_ordinal_pair(rows, ["headline", "activity", "rate_lag1"], "actual_action", one_sided=True), rows)
    three = [F.col(c) for c in ("p_cut", "p_hold", "p_hike")]
    proper = (F.abs(sum(three[1:], three[0]) - 1) < 1e-9) & (F.least(*three) >= 0)
    named = F.when(F.col("predicted_action") == "cut", three[0]).when(F.col("predicted_action") == "hike", three[2]).otherwise(three[1])
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(proper).alias("proper"), F.count_if(named >= F.greatest(*three) - 1e-12).alias("likeliest"))


STUMP = {"trees": 1, "depth": 1, "step": 0.5, "subsample": 1.0, "columns": 1.0, "min_weight": 1.0}
WORTH = "pow(greatest(abs({g}) - 0.1, 0), 2) / ({h} + 2)"
LEAF = "(-sign({g}) * greatest(abs({g}) - 0.1, 0) / ({h} + 2) * 0.5)"


@query(
    "boosted_stumps",
    f"""WITH {pn.POLICY}, cal AS (SELECT q_idx, row_number() OVER (ORDER BY q_idx) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT q_idx FROM policy)),
        rws AS (SELECT entity, q_idx, [round(headline), rate_lag1] AS xs, CASE actual_action WHEN 'cut' THEN 0 WHEN 'hold' THEN 1 ELSE 2 END AS code,
            CASE WHEN n // 5 = 0 OR k < n - 4 * (n // 5) THEN 0 ELSE (k - (n - 4 * (n // 5))) // (n // 5) + 1 END AS fold FROM policy JOIN cal USING (q_idx)),
        bins AS (SELECT m AS fold, side, i, xs[i] AS x, sum(0.5 - (code > side)::INT) AS g, count(*) * 0.25 AS h FROM rws, range(1, 5) AS a(m), range(0, 2) AS b(side), range(1, 3) AS c(i) WHERE rws.fold < m GROUP BY 1, 2, 3, 4),
        cuts AS (SELECT fold, side, i, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER v AS g, sum(h) OVER v AS h FROM bins WINDOW w AS (PARTITION BY fold, side, i ORDER BY x), v AS (PARTITION BY fold, side, i)),
        best AS (SELECT *, round({WORTH.format(g="gl", h="hl")} + {WORTH.format(g="(g - gl)", h="(h - hl)")} - {WORTH.format(g="g", h="h")}, 9) AS gain, hl >= 1 AND h - hl >= 1 AS fits FROM cuts
            QUALIFY row_number() OVER (PARTITION BY fold, side ORDER BY CASE WHEN fits THEN gain ELSE 0 END DESC, i, x) = 1),
        scored AS (SELECT entity, q_idx, side, 1 / (1 + exp(-CASE WHEN NOT fits OR gain <= 0 THEN {LEAF.format(g="g", h="h")} WHEN xs[i] <= x THEN {LEAF.format(g="gl", h="hl")} ELSE {LEAF.format(g="(g - gl)", h="(h - hl)")} END)) AS p FROM rws JOIN best USING (fold)),
        pair AS (SELECT entity, q_idx, max(p) FILTER (side = 0) AS a, least(max(p) FILTER (side = 1), max(p) FILTER (side = 0)) AS b FROM scored GROUP BY 1, 2)
        SELECT entity, q_idx, {r('1 - a', 'p_cut')}, {r('a - b', 'p_hold')}, {r('b', 'p_hike')}, CASE WHEN 1 - a >= a - b AND 1 - a >= b THEN 'cut' WHEN a - b >= b THEN 'hold' ELSE 'hike' END AS predicted_action FROM pair""",
)
def boosted_stumps(spark, d):
    """One boosting round of one split for both sides of four chronological folds, whose best cuts SQL can find."""
    rows = pn.policy(spark, d).withColumn("headline", F.round("headline"))
    out = po.walk_forward_ordinal_pair(rows, ["headline", "rate_lag1"], "actual_action", one_sided=True, **STUMP)
    return out.select("entity", "q_idx", "p_cut", "p_hold", "p_hike", "predicted_action")
