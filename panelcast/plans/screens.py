"""Predictor-screening and pooled-model queries on the line panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import pooled as po
from panelcast.operators import profile as pf
from panelcast.operators import reshape
from panelcast.operators import screening as sc
from panelcast.operators.align import over_time
from panelcast.operators.features import add_lags
from panelcast.plans import panels as pn
from panelcast.plans import decisions
from panelcast.plans.features import BOUNDS, REGIME
from panelcast.plans.registry import query, r, rs
from panelcast.sources.stage import staged

K = pn.K


def corr_sql(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query(
    "lag_correlations",
    f"""WITH {pn.LINE}, l AS (SELECT entity, price, lag(quantity) OVER w AS quantity, lag(discount) OVER w AS discount, lag(tax) OVER w AS tax FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx)),
        u AS (SELECT entity, price, v, x, note FROM l, LATERAL (VALUES ('quantity', quantity, 'used existing lag feature'), ('discount', discount, 'derived lag for export'), ('tax', tax, 'derived lag for export')) AS t(v, x, note))
        SELECT entity, v || '_lag1' AS variable, v AS source_variable, count(*) FILTER (x IS NOT NULL) AS observations, {r(corr_sql('price', 'x'), 'correlation')}, {r(f"abs({corr_sql('price', 'x')})", 'abs_correlation')}, note AS notes
        FROM u GROUP BY entity, v, note""",
)
def lag_correlations(spark, d):
    """Correlation with each driver one quarter earlier; a stored lag column is preferred."""
    p = add_lags(pn.line_panel(spark, d), K, {"quantity": [1]})
    return sc.lag_correlation(p, K, "price", [*pn.DRIVERS, "not_there"])


CCF = f"""{pn.LINE}, lu AS (SELECT entity, q_idx, price AS y, v AS variable, x, row_number() OVER (PARTITION BY entity, v ORDER BY q_idx) AS rn FROM line, LATERAL (VALUES ('quantity', quantity), ('discount', discount), ('tax', tax)) AS t(v, x)),
   ccf AS (SELECT a.entity, a.variable, CAST(k AS INTEGER) AS lag, count(*) AS n_obs, {corr_sql('a.y', 'b.x')} AS correlation FROM lu a CROSS JOIN range(-4, 5) AS g(k) JOIN lu b ON b.entity = a.entity AND b.variable = a.variable AND b.rn = a.rn - k GROUP BY 1, 2, 3)"""


def ccf(panel):
    return sc.lead_lag(panel, K, "price", pn.DRIVERS)


@query("lead_lag_correlations", f"WITH {CCF} SELECT entity, variable, lag, {r('correlation', 'correlation')}, n_obs FROM ccf")
def lead_lag_correlations(spark, d):
    """Correlations at lags -4 to 4."""
    return ccf(pn.line_panel(spark, d))


BEST = f"{CCF}, best_lag AS (SELECT entity, variable, arg_max(lag, abs(correlation)) AS lag, arg_max(correlation, abs(correlation)) AS correlation, any_value(n_obs) AS any_n FROM ccf WHERE lag > 0 GROUP BY 1, 2)"


@query("best_lags", f"WITH {BEST} SELECT b.entity, b.variable, b.lag, {r('b.correlation', 'correlation')}, n_obs FROM best_lag b JOIN ccf USING (entity, variable, lag)")
def best_lags(spark, d):
    """Strongest positive lag per driver."""
    return sc.best_lag(ccf(pn.line_panel(spark, d)), K)


@query(
    "strongest_drivers",
    f"WITH {BEST} SELECT entity, variable, lag, {r('correlation', 'correlation')}, {r('abs(correlation)', 'strength')} FROM best_lag",
)
def strongest_drivers(spark, d):
    """Best lags, strongest first."""
    b = best_lags(spark, d).withColumn("strength", F.abs("correlation")).drop("n_obs")
    return sc.strongest_first(b, "strength")


MATRIX = ["price", *pn.DRIVERS]


@query(
    "correlation_matrix",
    f"""WITH {pn.LINE}, u AS (SELECT entity, q_idx, v, x FROM line, LATERAL (VALUES ('price', price), ('quantity', quantity), ('discount', discount), ('tax', tax)) AS t(v, x))
        SELECT a.entity, a.v AS variable_a, b.v AS variable_b, {r(corr_sql('a.x', 'b.x'), 'correlation')}, count(*) AS n_obs FROM u a JOIN u b USING (entity, q_idx) GROUP BY 1, 2, 3 HAVING count(*) >= 24""",
)
def correlation_matrix(spark, d):
    """All pairwise correlations of complete rows."""
    return sc.corr_matrix(pn.line_panel(spark, d), K, MATRIX)


VIF = f"""{pn.LINE}, c AS (SELECT entity, count(*) AS n, corr(quantity, discount) AS ab, corr(quantity, tax) AS ac, corr(discount, tax) AS bc FROM line GROUP BY 1),
   vifs AS (SELECT entity, n, v AS variable, (1 - o * o) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc) AS vif FROM c, LATERAL (VALUES ('quantity', bc), ('discount', ac), ('tax', ab)) AS t(v, o))"""


@query("variance_inflation", f"WITH {VIF} SELECT entity, variable, n AS observations, {r('vif', 'vif')}, CASE WHEN vif > 10 THEN 'above 10 threshold' ELSE 'within 10 threshold' END AS notes FROM vifs")
def variance_inflation(spark, d):
    """Centred variance inflation factors from one moment aggregation."""
    return sc.vif(pn.line_panel(spark, d), K, pn.DRIVERS)


@query(
    "variance_inflation_uncentred",
    f"""WITH {pn.LINE}, c AS (SELECT entity, count(*) AS n, sum(quantity * discount) / sqrt(sum(quantity * quantity) * sum(discount * discount)) AS ab, sum(quantity * tax) / sqrt(sum(quantity * quantity) * sum(tax * tax)) AS ac,
              sum(discount * tax) / sqrt(sum(discount * discount) * sum(tax * tax)) AS bc FROM line GROUP BY 1),
        v AS (SELECT entity, n, v AS variable, (1 - o * o) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc) AS vif FROM c, LATERAL (VALUES ('quantity', bc), ('discount', ac), ('tax', ab)) AS t(v, o))
        SELECT entity, variable, n AS observations, {r('vif', 'vif', 3)}, CASE WHEN vif > 10 THEN 'above 10 threshold' ELSE 'within 10 threshold' END AS notes FROM v""", digits=3,
)
def variance_inflation_uncentred(spark, d):
    """Factors of a regression without a constant."""
    return sc.vif(pn.line_panel(spark, d), K, pn.DRIVERS, centered=False)


@query(
    "grouped_least_squares",
    f"""WITH {pn.LINE}, m AS (SELECT entity, count(*) AS n, avg(price) AS my, avg(quantity) AS m1, avg(tax) AS m2, var_pop(quantity) AS a, var_pop(tax) AS b, covar_pop(quantity, tax) AS c, covar_pop(quantity, price) AS p, covar_pop(tax, price) AS q, var_pop(price) AS v FROM line GROUP BY 1),
        s AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS b1, (a * q - c * p) / (a * b - c * c) AS b2 FROM m), f AS (SELECT *, n * (v - b1 * p - b2 * q) AS sse FROM s)
        SELECT entity, n, {r('my - b1 * m1 - b2 * m2', 'intercept')}, {r('b1', 'b_quantity')}, {r('b2', 'b_tax')}, {rs('sse')}, {r('1 - sse / (n * v)', 'r2')}, {r('n * (ln(2 * pi()) + ln(sse / n) + 1) + 3 * ln(n)', 'bic')} FROM f""",
)
def grouped_least_squares(spark, d):
    """Least squares per entity from sufficient statistics."""
    o = sc.grouped_ols(pn.line_panel(spark, d), K, "price", ["quantity", "tax"])
    b = F.col("coefficients")
    return o.select("entity", "n", "intercept", b[0].alias("b_quantity"), b[1].alias("b_tax"), "sse", "r2", "bic")


def granger(panel):
    return sc.granger_screen(panel, K, "price", pn.DRIVERS)


@query("predictive_lag_screen")
def predictive_lag_screen(spark, d):
    """Do a driver's lags add to the target's own lags?"""
    return granger(pn.line_panel(spark, d))


@query(
    "rolling_correlation",
    f"""WITH {pn.LINE}, x AS (SELECT entity, q_idx, count(*) OVER w AS n, covar_pop(price, quantity) OVER w / nullif(stddev_pop(price) OVER w * stddev_pop(quantity) OVER w, 0) AS c FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        SELECT entity, q_idx, {r('c', 'rolling_corr')} FROM x WHERE n = 12""",
)
def rolling_correlation(spark, d):
    """Correlation over the last 12 rows."""
    return sc.rolling_corr(pn.line_panel(spark, d), K, "price", "quantity", 12)


ROLL = f"""{pn.LINE}, rl0 AS (SELECT entity, q_idx, count(*) OVER w AS n, covar_pop(price, quantity) OVER w / nullif(stddev_pop(price) OVER w * stddev_pop(quantity) OVER w, 0) AS c FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
   rolled AS (SELECT entity, q_idx, c FROM rl0 WHERE n = 12),
   raw_s AS (SELECT entity, count(*) FILTER (s <> p) AS n FROM (SELECT entity, sign(c) AS s, lag(sign(c)) OVER (PARTITION BY entity ORDER BY q_idx) AS p FROM rolled WHERE c <> 0) GROUP BY 1),
   hard_s AS (SELECT entity, count(*) FILTER (s <> p) AS n FROM (SELECT entity, sign(c) AS s, lag(sign(c)) OVER (PARTITION BY entity ORDER BY q_idx) AS p FROM rolled WHERE abs(c) >= 0.2) GROUP BY 1),
   signs AS (SELECT e.entity, coalesce(a.n, 0) AS raw_sign_changes, coalesce(b.n, 0) AS strong_sign_changes FROM (SELECT DISTINCT entity FROM rolled) e LEFT JOIN raw_s a USING (entity) LEFT JOIN hard_s b USING (entity)),
   reg AS (SELECT entity, regime, count(*) AS n_obs, {corr_sql('price', 'quantity')} AS c FROM (SELECT *, {REGIME} AS regime FROM line) GROUP BY 1, 2)"""


@query("sign_changes", f"WITH {ROLL} SELECT * FROM signs")
def sign_changes(spark, d):
    """Sign changes of the rolling correlation, all and strong ones."""
    return sc.sign_changes(rolling_correlation(spark, d), K)


@query("regime_correlation", f"WITH {ROLL} SELECT entity, regime, n_obs, {r('CASE WHEN n_obs >= 8 THEN c END', 'regime_corr')} FROM reg")
def regime_correlation(spark, d):
    """Correlation per regime."""
    return sc.regime_corr(pn.line_panel(spark, d), K, "price", "quantity", BOUNDS)


@query(
    "stability_summary",
    f"""WITH {ROLL}, b AS (SELECT entity, count(*) AS rolling_windows, min(c) AS rolling_corr_min, max(c) AS rolling_corr_max, avg(abs(c)) AS mean_abs_rolling_corr, stddev_samp(c) AS rolling_corr_std, avg(CASE WHEN abs(c) < 0.2 THEN 1.0 ELSE 0.0 END) AS weak_window_share FROM rolled GROUP BY 1),
        o AS (SELECT entity, coalesce(max(abs(c)) FILTER (regime = 'late' AND n_obs >= 8) >= 0.2, false) AND coalesce(max(abs(c)) FILTER (regime <> 'late' AND n_obs >= 8) < 0.2, true) AS only_crisis FROM reg GROUP BY 1),
        j AS (SELECT *, concat_ws('; ', CASE WHEN strong_sign_changes > 0 THEN 'strong sign change' END, CASE WHEN weak_window_share > 0.5 THEN 'weak in more than half of rolling windows' END,
              CASE WHEN rolling_corr_std > 0.3 THEN 'large rolling-correlation variation' END, CASE WHEN only_crisis THEN 'signal concentrated in crisis periods' END) AS w FROM b JOIN signs USING (entity) JOIN o USING (entity))
        SELECT entity, rolling_windows, {rs('rolling_corr_min rolling_corr_max mean_abs_rolling_corr rolling_corr_std weak_window_share')}, raw_sign_changes, strong_sign_changes, only_crisis AS crisis_only_signal, w AS stability_warning, w <> '' AS unstable FROM j""",
)
def stability_summary(spark, d):
    """Stability of a relationship with a warning text."""
    p = staged(pn.line_panel(spark, d))
    regimes = sc.regime_corr(p, K, "price", "quantity", BOUNDS)
    return sc.stability_summary(
        sc.rolling_corr(p, K, "price", "quantity", 12), regimes, K, ["early", "middle"], ["late"]
    )


def release_lags(panel):
    """Assumed release lags, derived from each driver's mean level."""
    m = panel.agg(*[F.avg(c).alias(c) for c in pn.DRIVERS])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.when(F.col(c) > 10, 2).when(F.col(c) > 4.5, 1).otherwise(0).alias("min_safe_lag")) for c in pn.DRIVERS])
    return m.select(F.inline(cells))


LAGS = f"""{CCF}, asm0 AS (SELECT avg(quantity) AS quantity, avg(discount) AS discount, avg(tax) AS tax FROM line),
   asm AS (SELECT v AS variable, CASE WHEN x > 10 THEN 2 WHEN x > 4.5 THEN 1 ELSE 0 END AS min_safe_lag FROM asm0, LATERAL (VALUES ('quantity', quantity), ('discount', discount), ('tax', tax)) AS t(v, x)),
   feats AS (SELECT DISTINCT concat(variable, '_lag', k) AS feature, variable, CAST(k AS INTEGER) AS feature_lag FROM lu CROSS JOIN (VALUES (1), (2), (4)) AS g(k)),
   avail AS (SELECT f.*, a.min_safe_lag, feature_lag >= min_safe_lag AS origin_safe FROM feats f LEFT JOIN asm a USING (variable))"""


def lag_features(panel):
    """The stored lag features 1, 2 and 4 of every driver."""
    long = reshape.to_long(panel, ["entity", "q_idx"], pn.DRIVERS).select("variable").distinct()
    names = F.transform(F.array(F.lit("1"), F.lit("2"), F.lit("4")), lambda k: F.concat("variable", F.lit("_lag"), k))
    return long.select(F.explode(names).alias("feature"))


def checked(panel):
    return sc.availability_check(lag_features(panel), release_lags(panel))


@query("feature_availability", f"WITH {LAGS} SELECT feature, variable, feature_lag, min_safe_lag, origin_safe FROM avail")
def feature_availability(spark, d):
    """Is a feature's lag at least its series' assumed release lag?"""
    return checked(staged(pn.line_panel(spark, d))).select("feature", "variable", "feature_lag", "min_safe_lag", "origin_safe")


@query(
    "inherited_release_lags",
    f"WITH {LAGS} SELECT variable, min_safe_lag FROM asm UNION ALL SELECT variable || '_change', min_safe_lag FROM asm",
)
def inherited_release_lags(spark, d):
    """Derived series take over their source's release lag."""
    a = release_lags(staged(pn.line_panel(spark, d)))
    derived = a.select(F.concat("variable", F.lit("_change")).alias("variable"), F.col("variable").alias("source_variable"))
    return sc.extend_assumptions(a, derived)


CHOSEN = f"""{LAGS}, bl AS (SELECT entity, variable, arg_max(lag, abs(correlation)) AS best FROM ccf WHERE lag > 0 GROUP BY 1, 2),
   opt AS (SELECT b.entity, a.variable, a.feature, a.feature_lag, greatest(b.best, a.min_safe_lag) AS want FROM avail a JOIN bl b USING (variable) WHERE origin_safe),
   pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY CASE WHEN feature_lag = want THEN 0 WHEN feature_lag >= want THEN 1 ELSE 2 END, feature_lag) AS k FROM opt) WHERE k = 1),
   cover AS (SELECT entity, feature, variable, feature_lag, (n - feature_lag) / n AS coverage_pct, n FROM (SELECT entity, count(*) AS n FROM line GROUP BY 1) CROSS JOIN feats),
   chosen AS (SELECT p.entity, p.variable, p.feature, p.feature_lag, coverage_pct FROM pick p JOIN cover c USING (entity, feature) WHERE coverage_pct >= 0.5)"""


def feature_coverage(panel):
    lagged = add_lags(panel, K, {c: [1, 2, 4] for c in pn.DRIVERS})
    names = [f"{c}_lag{k}" for c in pn.DRIVERS for k in (1, 2, 4)]
    return pf.coverage_profile(lagged, K, names).withColumnRenamed("variable", "feature")


def chosen(panel):
    return sc.choose_safe_lag(checked(panel), sc.best_lag(ccf(panel), K), feature_coverage(panel), K)


@query("chosen_features", f"WITH {CHOSEN} SELECT entity, variable, feature, feature_lag, {r('coverage_pct', 'coverage_pct')} FROM chosen")
def chosen_features(spark, d):
    """One safe lagged feature per driver."""
    return chosen(staged(pn.line_panel(spark, d)))


@query(
    "substitute_choice",
    f"""WITH {pn.SPARSE}, c AS (SELECT entity, count(gappy) / count(*) AS a, count(late) / count(*) AS b FROM sparse GROUP BY 1)
        SELECT entity, CASE WHEN a >= b THEN 'gappy' ELSE 'late' END AS preferred, CASE WHEN a >= b THEN 'late' ELSE 'gappy' END AS alternative, {r('a', 'coverage_a')}, {r('b', 'coverage_b')} FROM c""",
)
def substitute_choice(spark, d):
    """Of two substitute columns the one with better coverage."""
    cover = pf.coverage_profile(pn.sparse_panel(spark, d), K, ["gappy", "late"])
    return sc.pick_alternative(cover, K, "gappy", "late")


def candidates(panel, tests=None):
    """Shortlist rows; without the F-screen every column has a SQL counterpart."""
    base = panel.select("entity").distinct().select(
        "entity", F.explode(F.array(*[F.lit(c) for c in pn.DRIVERS])).alias("variable"), F.lit(True).alias("has_lag_feature")
    )
    p = ccf(panel)
    picked = chosen(panel)
    vifs = sc.vif(panel, K, pn.DRIVERS)
    by_feature = picked.select("entity", "variable", "feature").join(vifs, [*K, "variable"]).select(
        "entity", F.col("feature").alias("variable"), "vif"
    )
    cover = pf.coverage_profile(panel, K, pn.DRIVERS)
    return sc.shortlist(base, K, p, tests, by_feature, picked, cover, checked(panel))


SHORT = f"""{CHOSEN}, cc AS (SELECT entity, count(*) AS n, corr(quantity, discount) AS ab, corr(quantity, tax) AS ac, corr(discount, tax) AS bc FROM line GROUP BY 1),
   vf AS (SELECT entity, v AS variable, (1 - o * o) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc) AS vif FROM cc, LATERAL (VALUES ('quantity', bc), ('discount', ac), ('tax', ab)) AS t(v, o)),
   short AS (SELECT e.entity, e.variable, c.feature, c.feature_lag, x.correlation AS candidate_corr, abs(x.correlation) AS abs_corr, CASE WHEN c.feature IS NOT NULL THEN vf.vif END AS vif, a.origin_safe
     FROM (SELECT DISTINCT entity, variable FROM lu) e LEFT JOIN chosen c USING (entity, variable) LEFT JOIN ccf x ON x.entity = e.entity AND x.variable = e.variable AND x.lag = c.feature_lag
     LEFT JOIN vf ON vf.entity = e.entity AND vf.variable = e.variable LEFT JOIN avail a ON a.feature = c.feature)"""


@query("candidate_shortlist", f"WITH {SHORT} SELECT entity, variable, feature, feature_lag, {rs('candidate_corr abs_corr vif')}, origin_safe FROM short")
def candidate_shortlist(spark, d):
    """Correlation, collinearity, coverage and availability of each candidate on one row."""
    return candidates(staged(pn.line_panel(spark, d))).select(
        "entity", "variable", "feature", "feature_lag", "candidate_corr", "abs_corr", "vif", "origin_safe"
    )


@query(
    "candidate_status",
    f"""WITH {SHORT}, s AS (SELECT *, CASE WHEN feature_lag IS NULL THEN 'no candidate lag selected after availability and sample screen' WHEN NOT coalesce(origin_safe, false) THEN 'unsafe under assumed publication lag' END AS blocker,
            coalesce(vif > 10, false) AS high, CASE WHEN abs_corr >= 0.2 THEN 'candidate-lag correlation signal' END AS sig FROM short)
        SELECT entity, variable, feature, CASE WHEN blocker IS NOT NULL THEN 'exclude' WHEN sig IS NULL THEN 'optional' WHEN abs_corr >= 0.4 AND NOT high THEN 'strong candidate' WHEN high THEN 'optional/shorter-sample candidate' ELSE 'candidate' END AS screening_status,
          concat_ws('; ', blocker, CASE WHEN high THEN 'high VIF in primary candidate matrix' END, CASE WHEN blocker IS NULL THEN coalesce(sig, 'weak candidate-lag screening signal') END) AS reason FROM s""",
)
def candidate_status(spark, d):
    """Screening status and reason of each candidate."""
    return sc.classify_candidates(candidates(staged(pn.line_panel(spark, d)))).select("entity", "variable", "feature", "screening_status", "reason")


@query("tested_candidate_status")
def tested_candidate_status(spark, d):
    """Screening status with the F-screen's p-values among the signals."""
    panel = staged(pn.line_panel(spark, d))
    return sc.classify_candidates(candidates(panel, granger(panel))).select(
        "entity", "variable", "feature", "candidate_p", "screening_status", "reason"
    )


@query(
    "screen_comparison",
    f"""WITH {CCF}, other AS (SELECT a.entity, a.variable, CAST(k AS INTEGER) AS lag, {corr_sql('a.y', 'b.x')} AS correlation FROM (SELECT entity, variable, rn, -y * rn AS y FROM lu) a CROSS JOIN range(1, 5) AS g(k) JOIN lu b ON b.entity = a.entity AND b.variable = a.variable AND b.rn = a.rn - k GROUP BY 1, 2, 3),
        x AS (SELECT entity, variable, arg_max(correlation, abs(correlation)) AS c FROM ccf WHERE lag > 0 GROUP BY 1, 2), y AS (SELECT entity, variable, arg_max(correlation, abs(correlation)) AS c FROM other GROUP BY 1, 2)
        SELECT entity, variable, {r('x.c', 'first_correlation')}, {r('1 - abs(x.c)', 'first_p')}, {r('y.c', 'second_correlation')}, {r('1 - abs(y.c)', 'second_p')}, {r('abs(y.c) - abs(x.c)', 'abs_corr_diff')}, (1 - abs(x.c) <= 0.6) <> (1 - abs(y.c) <= 0.6) AS signal_changed
        FROM x JOIN y USING (entity, variable)""",
)
def screen_comparison(spark, d):
    """Two targets' screens side by side."""
    p = staged(pn.line_panel(spark, d))
    row = F.row_number().over(over_time(K))
    other = p.withColumn("price", -F.col("price") * row)
    best = lambda x: sc.best_lag(sc.lead_lag(x, K, "price", pn.DRIVERS), K).withColumn("p", 1 - F.abs("correlation"))
    return reshape.compare_screens(best(p), best(other), [*K, "variable"], "first", "second", "correlation", "p", 0.6)


FEATURES = ["quantity", "discount", "tax"]


def pooled_frame(panel):
    return po.with_time_folds(po.direct_frame(panel, K, "price", FEATURES, [1, 2, 3]))


def fits(panel):
    return po.tune_direct(pooled_frame(panel), FEATURES)


@query("tuned_elastic_nets")
def tuned_elastic_nets(spark, d):
    """Best penalty per horizon by chronological cross-validation, with the fits it implies."""
    f = fits(pn.line_panel(spark, d))
    b = F.col("coefficients")
    return f.select("horizon", "fold", "alpha", "l1_ratio", "cv_mse", "train_rows", "intercept", *[b[i].alias(f"b_{c}") for i, c in enumerate(FEATURES)])


@query(
    "pooled_least_squares",
    f"""WITH {pn.LINE}, t AS (SELECT CAST(h AS INTEGER) AS horizon, o.quantity AS x, y.price AS y FROM (SELECT *, row_number() OVER w AS rn FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx)) o CROSS JOIN range(1, 4) AS g(h)
          JOIN (SELECT *, row_number() OVER w AS rn FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx)) y ON y.entity = o.entity AND y.rn = o.rn + h)
        SELECT horizon, count(*) AS train_rows, {r('regr_intercept(y, x)', 'intercept')}, {r('regr_slope(y, x)', 'b_quantity')} FROM t GROUP BY 1""",
)
def pooled_least_squares(spark, d):
    """The direct fits without a penalty and with one feature, pooled over entities."""
    frame = po.direct_frame(pn.line_panel(spark, d), K, "price", ["quantity"], [1, 2, 3])
    f = po.fit_direct(frame, ["quantity"], 0.0, 0.5)
    return f.select("horizon", "train_rows", "intercept", F.col("coefficients")[0].alias("b_quantity"))


@query("out_of_fold_residuals")
def out_of_fold_residuals(spark, d):
    """Residuals of every test block under the fit of its own earlier rows."""
    frame = pooled_frame(staged(pn.line_panel(spark, d)))
    return po.oof_residuals(frame, po.tune_direct(frame, FEATURES), K, FEATURES)


@query("latest_pooled_forecasts")
def latest_pooled_forecasts(spark, d):
    """All horizons from the latest complete row of each entity."""
    p = staged(pn.line_panel(spark, d))
    return po.predict_latest(p, fits(p), K, FEATURES, [1, 2, 3])


@query("nonzero_coefficients")
def nonzero_coefficients(spark, d):
    """Non-zero coefficients per horizon of the tuned fits."""
    return po.nonzero_coefficients(fits(pn.line_panel(spark, d)), FEATURES)


@query("ordinal_tree_pair")
def ordinal_tree_pair(spark, d):
    """Two boosted-tree classifiers on cumulative classes, combined ordinally; later rows under fits of earlier quarters."""
    out = po.walk_forward_ordinal_pair(staged(pn.policy(spark, d)), ["headline", "activity", "rate_lag1"], "actual_action", one_sided=True)
    return out.select("entity", "q_idx", "actual_action", "predicted_action", "p_cut", "p_hold", "p_hike")


@query(
    "vote_count_terms",
    f"WITH {decisions.CPRED} SELECT entity, model, count(*) FILTER (predicted_action = actual_action) AS nonzero, count(*) AS terms FROM cpred GROUP BY 1, 2",
)
def vote_count_terms(spark, d):
    """Correct predictions counted as non-zero terms per model."""
    c = decisions.class_predictions(spark, d).withColumn("ok", (F.col("predicted_action") == F.col("actual_action")).cast("double"))
    return pf.nonzero_by_group(c, ["entity", "model"], "ok")
