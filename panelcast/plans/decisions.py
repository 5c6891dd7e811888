"""Decision-rule and classifier-evaluation queries on the decision sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import bootstrap as bs
from panelcast.operators import profile as pf
from panelcast.operators import reshape
from panelcast.operators import rules
from panelcast.operators.align import over_time
from panelcast.plans import panels as pn
from panelcast.plans.backtests import IDX
from panelcast.plans.registry import normal_cdf_sql, query, r, rs

K = pn.K
BASE = ["entity", "q_idx"]
BAND_SQL = "CASE WHEN headline < 2 THEN 'cut' WHEN headline > 3 THEN 'hike' ELSE 'hold' END"


def _sign(e: str) -> str:
    return f"CASE WHEN {e} < 0 THEN 'cut' WHEN {e} = 0 THEN 'hold' WHEN {e} > 0 THEN 'hike' END"


@query("change_labels", f"WITH {pn.POLICY} SELECT entity, q_idx, {r('rate_change', 'rate_change')}, actual_action FROM policy")
def change_labels(spark, d):
    """Action label by the sign of the rate change."""
    return pn.policy(spark, d).select(*BASE, "rate_change", "actual_action")


@query("band_labels", f"WITH {pn.POLICY} SELECT entity, q_idx, {BAND_SQL} AS predicted_action FROM policy")
def band_labels(spark, d):
    """Band rule on the headline."""
    return pn.policy(spark, d).select(*BASE, rules.band_rule(F.col("headline")).alias("predicted_action"))


def _implied(star: str) -> str:
    return f"({star}) + headline + 0.5 * (headline - 2.5) + 0.5 * activity - rate_lag1"


FIXED_OVER = {
    "full": "avg(rate - headline) OVER (PARTITION BY entity)",
    "expanding": "avg(rate - headline) OVER (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}


def _fixed_query(mode):
    def run(spark, d):
        p = rules.fixed_rule(pn.policy(spark, d), K, "headline", "activity", "rate", "rate_lag1", mode)
        return p.select(*BASE, "r_star", "implied_change", "predicted_action")

    return run


for _mode, _over in FIXED_OVER.items():
    query(
        f"fixed_rule_{_mode}",
        f"""WITH {pn.POLICY}, x AS (SELECT *, {_over} AS r_star FROM policy), y AS (SELECT *, {_implied('r_star')} AS c FROM x)
            SELECT entity, q_idx, {r('r_star', 'r_star')}, {r('c', 'implied_change')}, {_sign('c')} AS predicted_action FROM y""",
    )(_fixed_query(_mode))

OLS = f"""{pn.POLICY}, o AS (SELECT *, headline - 2.5 AS gap FROM policy),
  m AS (SELECT *, count(*) OVER w AS n, avg(rate_change) OVER w AS my, avg(gap) OVER w AS m1, avg(activity) OVER w AS m2, var_pop(gap) OVER w AS s11, var_pop(activity) OVER w AS s22,
        var_pop(rate_change) OVER w AS syy, covar_pop(gap, activity) OVER w AS s12, covar_pop(gap, rate_change) OVER w AS s1y, covar_pop(activity, rate_change) OVER w AS s2y
        FROM o WINDOW w AS (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS coef_1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS coef_2 FROM m WHERE n >= 8),
  ols AS (SELECT *, my - coef_1 * m1 - coef_2 * m2 AS intercept, my - coef_1 * m1 - coef_2 * m2 + coef_1 * gap + coef_2 * activity AS predicted_change,
        sqrt(n * (syy - coef_1 * s1y - coef_2 * s2y) / (n - 3)) AS residual_se FROM c)"""
DEAD = "CASE WHEN predicted_change < -0.125 THEN 'cut' WHEN predicted_change > 0.125 THEN 'hike' ELSE 'hold' END"


def estimated(spark, d):
    p = pn.policy(spark, d).withColumn("gap", F.col("headline") - F.lit(rules.TARGET_MIDPOINT))
    return rules.expanding_ols(p, K, "rate_change", "gap", "activity", 8)


@query(
    "estimated_rule",
    f"""WITH {OLS} SELECT entity, q_idx, n AS train_rows, {rs('intercept coef_1 coef_2 predicted_change residual_se')},
        concat_ws(', ', CASE WHEN abs(coef_1) > 10 THEN 'coef_1' END, CASE WHEN abs(coef_2) > 10 THEN 'coef_2' END) AS unstable_coefficients, {DEAD} AS predicted_action FROM ols""",
)
def estimated_rule(spark, d):
    """Rule refitted by least squares before every quarter."""
    return estimated(spark, d).select(
        *BASE, "train_rows", "intercept", "coef_1", "coef_2", "predicted_change", "residual_se",
        "unstable_coefficients", "predicted_action",
    )


@query(
    "estimated_rule_probabilities",
    f"""WITH {OLS}, z AS (SELECT *, (-0.125 - predicted_change) / residual_se AS a, (0.125 - predicted_change) / residual_se AS b FROM ols),
        probs AS (SELECT *, {normal_cdf_sql('a')} AS ca, {normal_cdf_sql('b')} AS cb FROM z)
        SELECT entity, q_idx, {rs('predicted_change residual_se')}, {r('ca', 'p_cut')}, {r('cb - ca', 'p_hold')}, {r('1 - cb', 'p_hike')} FROM probs""",
)
def estimated_rule_probabilities(spark, d):
    """Normal class probabilities of the estimated rule."""
    p = rules.normal_band_probs(estimated(spark, d), "predicted_change", "residual_se")
    return p.select(*BASE, "predicted_change", "residual_se", "p_cut", "p_hold", "p_hike")


def votes(spark, d):
    """The four voters side by side, on rows where the estimated rule exists."""
    e = estimated(spark, d).withColumnRenamed("predicted_action", "estimated")
    e = e.withColumn("band", rules.band_rule(F.col("headline")))
    e = rules.fixed_rule(e, K, "headline", "activity", "rate", "rate_lag1").withColumnRenamed("predicted_action", "fixed")
    return e.withColumn("repeat", F.coalesce(F.lag("actual_action").over(over_time(K)), F.lit("hold")))


VOTERS = ["band", "fixed", "estimated", "repeat"]
VOTES = f"""{OLS}, v0 AS (SELECT *, {DEAD} AS estimated, {BAND_SQL} AS band, avg(rate - headline) OVER (PARTITION BY entity) AS r_star,
     coalesce(lag(actual_action) OVER (PARTITION BY entity ORDER BY q_idx), 'hold') AS repeat FROM ols),
   v1 AS (SELECT *, {_sign(_implied('r_star'))} AS fixed FROM v0),
   v2 AS (SELECT *, (band = 'cut')::INT + (fixed = 'cut')::INT + (estimated = 'cut')::INT + (repeat = 'cut')::INT AS c, (band = 'hold')::INT + (fixed = 'hold')::INT + (estimated = 'hold')::INT + (repeat = 'hold')::INT AS h,
      (band = 'hike')::INT + (fixed = 'hike')::INT + (estimated = 'hike')::INT + (repeat = 'hike')::INT AS k FROM v1),
   v3 AS (SELECT *, greatest(c, h, k) AS top FROM v2),
   votes AS (SELECT *, (c = top)::INT + (h = top)::INT + (k = top)::INT > 1 AS tie_break, CASE WHEN (c = top)::INT + (h = top)::INT + (k = top)::INT > 1 THEN band WHEN c = top THEN 'cut' WHEN h = top THEN 'hold' ELSE 'hike' END AS vote FROM v3)"""


@query("majority_vote", f"WITH {VOTES} SELECT entity, q_idx, band, fixed, estimated, repeat, tie_break, vote AS predicted_action FROM votes")
def majority_vote(spark, d):
    """Vote of four rules; ties follow the band rule."""
    return rules.majority_vote(votes(spark, d), VOTERS, "band").select(*BASE, *VOTERS, "tie_break", "predicted_action")


@query("invalid_votes", f"WITH {pn.LINE} SELECT entity, q_idx, 'raise' AS band FROM line WHERE NOT (tax < 4)")
def invalid_votes(spark, d):
    """Voter rows whose label is none of the three actions."""
    p = pn.line_panel(spark, d).select(*BASE, F.when(F.col("tax") < 4, "cut").otherwise("raise").alias("band"))
    return rules.invalid_votes(p, ["band"])


ORD = f"""{pn.LINE}, o AS (SELECT entity, q_idx, least(1.0, greatest(0.0, quantity - 25)) AS a, least(1.0, greatest(0.0, discount - 4.6)) AS b0 FROM line),
   o2 AS (SELECT entity, q_idx, a, least(b0, a) AS b FROM o),
   ordinal AS (SELECT entity, q_idx, 1 - a AS p_cut, a - b AS p_hold, b AS p_hike, CASE WHEN 1 - a >= a - b AND 1 - a >= b THEN 'cut' WHEN a - b >= b THEN 'hold' ELSE 'hike' END AS predicted_action FROM o2)"""


def ordinal(spark, d):
    p = pn.line_panel(spark, d).select(*BASE, (F.col("quantity") - 25).alias("a"), (F.col("discount") - 4.6).alias("b"))
    return rules.ordinal_combine(p, "a", "b").drop("a", "b")


@query("ordinal_classes", f"WITH {ORD} SELECT entity, q_idx, {rs('p_cut p_hold p_hike')}, predicted_action FROM ordinal")
def ordinal_classes(spark, d):
    """Two cumulative probabilities to three classes."""
    return ordinal(spark, d)


@query(
    "class_confidence",
    f"""WITH {ORD} SELECT entity, q_idx AS target_q, 'ordinal' AS model, predicted_action, {rs('p_cut p_hold p_hike')},
        {r("CASE predicted_action WHEN 'cut' THEN p_cut WHEN 'hold' THEN p_hold ELSE p_hike END", 'confidence')}, abs(p_cut + p_hold + p_hike - 1) <= 1e-5 AS consistent FROM ordinal""",
)
def class_confidence(spark, d):
    """Probability of the predicted class with consistency flags."""
    p = ordinal(spark, d).withColumn("model", F.lit("ordinal")).withColumnRenamed("q_idx", "target_q")
    return rules.confidence_table(p, K, ["ordinal"])


@query(
    "label_disagreements",
    f"""WITH {VOTES} SELECT entity, q_idx AS target_q, {r('headline', 'headline')}, band, estimated, concat(band, ' from point forecast vs ', estimated, ' from estimated rule') AS disagreement
        FROM votes WHERE band <> estimated""",
)
def label_disagreements(spark, d):
    """Rows where two derivations of the label differ."""
    v = votes(spark, d).withColumnRenamed("q_idx", "target_q")
    return rules.disagreements(v, K, "band", "estimated", "point forecast", "estimated rule", ["headline"])


SIZES = [1, 2, 3, 4, 8, 12, 16, 20, 24, 32]
AUDIT = f"""{pn.POLICY}, f AS (SELECT entity, q_idx, row_number() OVER w - 1 AS pos, count(*) FILTER (actual_action = 'cut') OVER b AS c, count(*) FILTER (actual_action = 'hold') OVER b AS h, count(*) FILTER (actual_action = 'hike') OVER b AS k
      FROM policy WINDOW w AS (PARTITION BY entity ORDER BY q_idx), b AS (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
   g AS (SELECT entity, CAST(s AS INTEGER) AS initial_size, pos >= s AS inside, q_idx, c, h, k FROM f CROSS JOIN (SELECT unnest({SIZES}) AS s)),
   audit0 AS (SELECT entity, initial_size, count(*) FILTER (inside) AS test_rows, min(q_idx) FILTER (inside) AS fq, min(c) FILTER (inside) AS min_train_cut, min(h) FILTER (inside) AS min_train_hold, min(k) FILTER (inside) AS min_train_hike,
      count(*) FILTER (inside AND (c = 0 OR h = 0 OR k = 0)) AS degenerate_folds, concat_ws(', ', CASE WHEN bool_or(inside AND c = 0) THEN 'cut' END, CASE WHEN bool_or(inside AND k = 0) THEN 'hike' END, CASE WHEN bool_or(inside AND h = 0) THEN 'hold' END) AS dc,
      min(c) FILTER (inside) AS min_gt_cut_negative, min(h + k) FILTER (inside) AS min_gt_cut_positive, min(c + h) FILTER (inside) AS min_gt_hold_negative, min(k) FILTER (inside) AS min_gt_hold_positive, count(*) FILTER (inside AND (c = 0 OR h + k = 0 OR k = 0 OR c + h = 0)) AS degenerate_binary_folds,
      concat_ws(', ', CASE WHEN bool_or(inside AND (c = 0 OR h + k = 0)) THEN 'Y>cut' END, CASE WHEN bool_or(inside AND (k = 0 OR c + h = 0)) THEN 'Y>hold' END) AS db FROM g GROUP BY 1, 2),
   audit AS (SELECT * EXCLUDE (fq, dc, db), {pn.label_sql('fq')} AS first_test_quarter, CASE WHEN test_rows = 0 THEN 'invalid_no_test_rows' WHEN dc = '' THEN 'none' ELSE dc END AS degenerate_classes,
      CASE WHEN test_rows = 0 THEN 'invalid_no_test_rows' WHEN db = '' THEN 'none' ELSE db END AS degenerate_binary_problems FROM audit0),
   chosen AS (SELECT entity, min(initial_size) FILTER (initial_size >= 8 AND test_rows > 0 AND degenerate_folds = 0 AND degenerate_binary_folds = 0) AS chosen_size FROM audit GROUP BY 1)"""


def audit(spark, d):
    return rules.split_audit(pn.policy(spark, d), K, "actual_action", SIZES)


@query("split_audit", f"WITH {AUDIT} SELECT * EXCLUDE (first_test_quarter), CASE WHEN test_rows > 0 THEN first_test_quarter END AS first_test_quarter FROM audit")
def split_audit(spark, d):
    """Class counts and degenerate folds per candidate initial window."""
    return audit(spark, d)


@query("chosen_split", f"WITH {AUDIT} SELECT c.entity, chosen_size, test_rows FROM chosen c LEFT JOIN audit a ON a.entity = c.entity AND a.initial_size = chosen_size")
def chosen_split(spark, d):
    """Smallest clean split at or above the floor."""
    return rules.choose_split(audit(spark, d), K, 8)


@query(
    "condensed_audit",
    f"""WITH {AUDIT}, m AS (SELECT a.*, chosen_size, max(initial_size) OVER p AS last_size, min(initial_size) FILTER (degenerate_folds = 0) OVER p AS first_clean FROM audit a JOIN chosen USING (entity) WINDOW p AS (PARTITION BY a.entity))
        SELECT entity, initial_size, test_rows, degenerate_folds, degenerate_classes, coalesce(initial_size = chosen_size, false) AS is_chosen FROM m
        WHERE degenerate_folds <> 0 OR initial_size = last_size OR initial_size = first_clean OR initial_size = chosen_size""",
)
def condensed_audit(spark, d):
    """Degenerate rows, first clean, chosen and last row of the audit."""
    a = audit(spark, d)
    return rules.condensed_audit(a, K, rules.choose_split(a, K, 8)).select(
        "entity", "initial_size", "test_rows", "degenerate_folds", "degenerate_classes", "is_chosen"
    )


CLASSIFIERS = [*VOTERS, "vote"]
CPRED = f"""{VOTES}, cpred AS (SELECT entity, q_idx AS target_q, actual_action, model, predicted_action FROM (SELECT * FROM votes), LATERAL (VALUES ('band', band), ('fixed', fixed), ('estimated', estimated), ('repeat', repeat), ('vote', vote)) AS x(model, predicted_action))"""


def class_predictions(spark, d):
    v = rules.majority_vote(votes(spark, d), VOTERS, "band").withColumnRenamed("predicted_action", "vote")
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted_action")) for m in CLASSIFIERS])
    return v.select(
        "entity", F.col("q_idx").alias("target_q"), "actual_action", "tie_break", "unstable_coefficients", F.inline(cells)
    )


@query("class_counts", f"WITH {pn.POLICY} SELECT entity, count(*) FILTER (actual_action = 'cut') AS cut, count(*) FILTER (actual_action = 'hold') AS hold, count(*) FILTER (actual_action = 'hike') AS hike FROM policy GROUP BY 1")
def class_counts(spark, d):
    """Counts per class, absent classes as zero."""
    return rules.class_counts(pn.policy(spark, d), K, "actual_action")


@query(
    "confusion_matrix",
    f"""WITH {CPRED} SELECT m.model, a.actual, count(*) FILTER (predicted_action = 'cut' AND c.actual_action = a.actual) AS cut, count(*) FILTER (predicted_action = 'hold' AND c.actual_action = a.actual) AS hold,
        count(*) FILTER (predicted_action = 'hike' AND c.actual_action = a.actual) AS hike FROM (SELECT DISTINCT model FROM cpred) m CROSS JOIN (VALUES ('cut'), ('hold'), ('hike')) AS a(actual) JOIN cpred c ON c.model = m.model GROUP BY 1, 2""",
)
def confusion_matrix(spark, d):
    """Actual by predicted class per model, pooled over entities."""
    return rules.confusion(class_predictions(spark, d), [])


def _f1(cls: str) -> str:
    return f"""coalesce(2.0 * count(*) FILTER (predicted_action = '{cls}' AND actual_action = '{cls}') / nullif(count(*) FILTER (predicted_action = '{cls}') + count(*) FILTER (actual_action = '{cls}'), 0), 0)"""


METRICS = f"SELECT entity, model, ({_f1('cut')} + {_f1('hold')} + {_f1('hike')}) / 3 AS macro_f1, avg(CASE WHEN predicted_action = actual_action THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM cpred GROUP BY 1, 2"


@query("class_metrics", f"WITH {CPRED}, scores AS ({METRICS}) SELECT entity, model, {rs('macro_f1 accuracy')}, n FROM scores")
def class_metrics(spark, d):
    """Macro-F1 and accuracy per model."""
    return rules.class_metrics(class_predictions(spark, d), K)


RANK_SQL = "CASE model WHEN 'band' THEN 0 WHEN 'fixed' THEN 1 WHEN 'estimated' THEN 2 WHEN 'repeat' THEN 3 ELSE 4 END"


@query(
    "ranked_classifiers",
    f"WITH {CPRED}, scores AS ({METRICS}) SELECT entity, model, {rs('macro_f1 accuracy')}, n, row_number() OVER (PARTITION BY entity ORDER BY round(macro_f1, 9) DESC, {RANK_SQL}) AS rank FROM scores",
)
def ranked_classifiers(spark, d):
    """Models ranked by macro-F1, ties by fixed order."""
    m = rules.class_metrics(class_predictions(spark, d), K).withColumn("macro_f1", F.round("macro_f1", 9))
    return rules.rank_class_metrics(m, K, CLASSIFIERS).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "rule_diagnostics",
    f"""WITH {VOTES} SELECT entity, count(*) AS ols_rows, count(*) FILTER (abs(coef_1) > 10 OR abs(coef_2) > 10) AS unstable_rows, count(*) FILTER (tie_break) AS tie_breaks,
        count(DISTINCT CASE WHEN abs(coef_1) > 10 OR abs(coef_2) > 10 THEN concat(abs(coef_1) > 10, abs(coef_2) > 10) END) AS unstable_kinds FROM votes GROUP BY 1""",
)
def rule_diagnostics(spark, d):
    """Unstable fits and tie breaks per entity."""
    return rules.diagnostics(class_predictions(spark, d), K, "estimated", "vote")


@query(
    "predicted_class_counts",
    f"WITH {CPRED} SELECT model, predicted_action, count(*) AS n FROM cpred GROUP BY 1, 2",
)
def predicted_class_counts(spark, d):
    """Value counts of the predicted class."""
    return pf.value_counts(class_predictions(spark, d), ["model"], "predicted_action")


@query(
    "classes_side_by_side",
    f"WITH {VOTES} SELECT entity, q_idx AS target_q, band, fixed, estimated, repeat, vote FROM votes",
)
def classes_side_by_side(spark, d):
    """Predicted classes with one column per model."""
    return reshape.to_wide(class_predictions(spark, d), ["entity", "target_q"], "model", "predicted_action", CLASSIFIERS)


@query(
    "coefficient_ranges",
    f"""WITH {OLS} SELECT entity, min(q_idx) AS first_q_idx, max(q_idx) AS last_q_idx, {', '.join(r(f'arg_min({c}, q_idx)', f'first_{c}') + ', ' + r(f'arg_max({c}, q_idx)', f'last_{c}') + ', ' + r(f'arg_max({c}, q_idx) - arg_min({c}, q_idx)', f'change_{c}') + ', ' + r(f'max({c}) - min({c})', f'range_{c}') for c in ('coef_1', 'coef_2'))} FROM ols GROUP BY 1""",
)
def coefficient_ranges(spark, d):
    """First and last coefficients and their range per entity."""
    return pf.first_last_range(estimated(spark, d), K, "q_idx", ["coef_1", "coef_2"])


REPS = 2000


@query(
    "bootstrap_f1_gap",
    f"""WITH {VOTES}, u AS (SELECT q_idx, {', '.join(f"count(*) FILTER (actual_action = '{c}' AND band = '{c}') AS ta{i}, count(*) FILTER (band = '{c}') AS pa{i}, count(*) FILTER (actual_action = '{c}' AND estimated = '{c}') AS tb{i}, count(*) FILTER (estimated = '{c}') AS pb{i}, count(*) FILTER (actual_action = '{c}') AS ac{i}" for i, c in enumerate(('cut', 'hold', 'hike')))},
          row_number() OVER (ORDER BY q_idx) - 1 AS i, count(*) OVER () AS n FROM votes GROUP BY 1),
        k AS (SELECT DISTINCT n FROM u), p AS (SELECT rep, CAST({IDX.format(rep='rep', slot='slot')} % n AS BIGINT) AS i FROM k CROSS JOIN range(0, {REPS}) AS a(rep), LATERAL (SELECT unnest(range(0, n)) AS slot)),
        g AS (SELECT rep, ({' + '.join(f'coalesce(2.0 * sum(ta{i}) / nullif(sum(pa{i}) + sum(ac{i}), 0), 0) - coalesce(2.0 * sum(tb{i}) / nullif(sum(pb{i}) + sum(ac{i}), 0), 0)' for i in range(3))}) / 3 AS gap FROM p JOIN u USING (i) GROUP BY 1),
        t AS (SELECT count(*) AS periods, ({' + '.join(f'coalesce(2.0 * sum(ta{i}) / nullif(sum(pa{i}) + sum(ac{i}), 0), 0) - coalesce(2.0 * sum(tb{i}) / nullif(sum(pb{i}) + sum(ac{i}), 0), 0)' for i in range(3))}) / 3 AS gap FROM u)
        SELECT periods, {r('t.gap', 'gap')}, {r('quantile_cont(g.gap, 0.025)', 'ci_lower')}, {r('quantile_cont(g.gap, 0.975)', 'ci_upper')} FROM t CROSS JOIN g GROUP BY periods, t.gap""",
)
def bootstrap_f1_gap(spark, d):
    """Paired bootstrap of a macro-F1 gap over quarters, pooled over entities."""
    return bs.bootstrap_f1_gap(votes(spark, d), [], "q_idx", "actual_action", "band", "estimated", rules.CLASSES, REPS, 42)
