"""Feature engineering queries on quarterly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import features as ft
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs

K = pn.K
WIN = "WINDOW w AS (PARTITION BY entity ORDER BY q_idx)"
BOUNDS = [("early", None, 1996 * 4 + 3), ("middle", 1997 * 4, 1998 * 4 + 3), ("late", 1999 * 4, None)]
REGIME = f"CASE WHEN q_idx <= {1996 * 4 + 3} THEN 'early' WHEN q_idx BETWEEN {1997 * 4} AND {1998 * 4 + 3} THEN 'middle' ELSE 'late' END"


@query(
    "lag_features",
    f"""WITH {pn.SPARSE} SELECT entity, q_idx, {r('lag(value) OVER w', 'value_lag1')}, {r('lag(value, 4) OVER w', 'value_lag4')},
        {r('lag(late, 2) OVER w', 'late_lag2')} FROM sparse {WIN}""",
)
def lag_features(spark, d):
    """Positional lags from a lag map; columns that are absent are skipped."""
    p = ft.add_lags(pn.sparse_panel(spark, d), K, {"value": [1, 4], "late": [2], "not_there": [1]})
    return p.select("entity", "q_idx", "value_lag1", "value_lag4", "late_lag2")


@query(
    "calendar_lags",
    f"""WITH c AS (SELECT o_custkey AS entity, {pn.q_sql('o_orderdate')} AS q_idx, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
        SELECT a.entity, a.q_idx, {r('b.value', 'value_lag1', 2)}, {r('e.value', 'value_lag4', 2)}
        FROM c a LEFT JOIN c b ON b.entity = a.entity AND b.q_idx = a.q_idx - 1
        LEFT JOIN c e ON e.entity = a.entity AND e.q_idx = a.q_idx - 4""", digits=2,
)
def calendar_lags(spark, d):
    """Lags of exactly k quarters on a panel with missing quarters (one series per customer)."""
    o = pn.table(spark, d, "orders")
    p = o.groupBy(F.col("o_custkey").alias("entity"), cal.q_idx("o_orderdate").alias("q_idx")).agg(F.sum("o_totalprice").alias("value"))
    return ft.add_lags(p, K, {"value": [1, 4]}, calendar=True).drop("value")


@query(
    "growth_rates",
    f"""WITH {pn.SPARSE} SELECT entity, q_idx, {r('(value / lag(value) OVER w - 1) * 100', 'value_growth')},
        {r('(gappy / lag(gappy) OVER w - 1) * 100', 'gappy_growth')} FROM sparse {WIN}""",
)
def growth_rates(spark, d):
    """Percent growth; a gap leaves the next growth missing."""
    p = ft.add_growth(pn.sparse_panel(spark, d), K, {"value": "value_growth", "gappy": "gappy_growth"})
    return p.select("entity", "q_idx", "value_growth", "gappy_growth")


@query(
    "rate_changes",
    f"WITH {pn.LINE} SELECT entity, q_idx, {r('discount - lag(discount) OVER w', 'discount_change')}, {r('tax - lag(tax) OVER w', 'tax_change')} FROM line {WIN}",
)
def rate_changes(spark, d):
    """Point changes of rates."""
    p = ft.add_change(pn.line_panel(spark, d), K, {"discount": "discount_change", "tax": "tax_change"})
    return p.select("entity", "q_idx", "discount_change", "tax_change")


@query(
    "yearly_change",
    f"WITH {pn.PANEL} SELECT entity, q_idx, {r('value', 'value')}, {r('value - lag(value, 4) OVER w', 'change')} FROM panel {WIN}",
)
def yearly_change(spark, d):
    """Change over four quarters, per entity."""
    return ft.change_over(pn.order_panel(spark, d), K, "value").select("entity", "q_idx", "value", "change")


@query(
    "nonlinear_terms",
    f"""WITH {pn.LINE}, l AS (SELECT entity, q_idx, lag(discount) OVER w AS discount_lag1, lag(tax) OVER w AS tax_lag1 FROM line {WIN})
        SELECT entity, q_idx, {rs('discount_lag1 tax_lag1')}, {r('discount_lag1 * discount_lag1', 'discount_lag1_sq')},
               {r('discount_lag1 * tax_lag1', 'discount_lag1_x_tax_lag1')} FROM l""",
)
def nonlinear_terms(spark, d):
    """Squares and products of lagged inputs."""
    p = ft.add_lags(pn.line_panel(spark, d), K, {"discount": [1], "tax": [1]}).select("entity", "q_idx", "discount_lag1", "tax_lag1")
    return ft.add_interactions(ft.add_squares(p, ["discount_lag1"]), [("discount_lag1", "tax_lag1")])


@query(
    "event_dummies",
    f"""WITH {pn.PANEL}, q AS (SELECT q_idx, count(*) AS n, avg(o_totalprice) AS v FROM (SELECT {pn.q_sql('o_orderdate')} AS q_idx, o_totalprice FROM orders) GROUP BY 1),
        e AS (SELECT q_idx, n < (SELECT avg(n) FROM q) AS slow, v > (SELECT avg(v) FROM q) AS dear FROM q)
        SELECT entity, q_idx, CAST(dear AS INTEGER) AS dear_lag0, CAST(slow AS INTEGER) AS slow_lag1 FROM panel JOIN e USING (q_idx)""",
)
def event_dummies(spark, d):
    """0/1 columns for quarters listed in an event table derived from the orders."""
    o = pn.table(spark, d, "orders").groupBy(cal.q_idx("o_orderdate").alias("q_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("v")
    )
    usual, mean = o.agg(F.avg("n")).scalar(), o.agg(F.avg("v")).scalar()
    event = lambda cond, name, lead: F.when(cond, F.struct(F.lit(name).alias("dummy_name"), F.lit(lead).alias("lead_quarters")))
    found = F.array_compact(F.array(
        event(F.col("n") < usual, "slow", 1), event(F.col("v") > mean, "dear", 0)
    ))
    events = o.withColumn("_found", found).select("q_idx", F.inline("_found"))
    p = pn.order_panel(spark, d).select("entity", "q_idx")
    return ft.add_event_dummies(p, events, ["q_idx"], {"slow": 1, "dear": 0}, ["entity"])


@query("regime_labels", f"WITH {pn.PANEL} SELECT entity, q_idx, {REGIME} AS regime FROM panel")
def regime_labels(spark, d):
    """Regime by quarter bounds."""
    return ft.label_regime(pn.order_panel(spark, d).select("entity", "q_idx"), BOUNDS)


VARIANTS = f"""v0 AS (SELECT entity, q_idx, value, value - lag(value) OVER w AS diff1, ln(value) - lag(ln(value)) OVER w AS ld,
   count(*) FILTER (value > 0) OVER (PARTITION BY entity) >= 0.8 * count(value) OVER (PARTITION BY entity) AS ok FROM panel {WIN}),
 variants AS (SELECT entity, q_idx, value, diff1, diff1 - lag(diff1) OVER w AS diff2, CASE WHEN ok THEN ld END AS log_diff1 FROM v0 {WIN})"""


@query("difference_variants", f"WITH {pn.PANEL}, {VARIANTS} SELECT entity, q_idx, {rs('value diff1 diff2 log_diff1')} FROM variants")
def difference_variants(spark, d):
    """Differences, second differences and log differences."""
    return ft.difference_variants(pn.order_panel(spark, d).select("entity", "q_idx", "value"), K)


@query(
    "stationary_panel",
    f"""WITH {pn.PANEL}, {VARIANTS}, pick AS (SELECT entity, q_idx, CASE left(entity, 1) WHEN '1' THEN value WHEN '2' THEN diff2
              ELSE CASE WHEN count(log_diff1) OVER (PARTITION BY entity) >= 12 THEN log_diff1 ELSE diff1 END END AS stationary FROM variants)
        SELECT entity, q_idx, {r('stationary', 'stationary')} FROM pick WHERE stationary IS NOT NULL""",
)
def stationary_panel(spark, d):
    """The variant each series' integration order asks for."""
    p = pn.order_panel(spark, d).select("entity", "q_idx", "value")
    first = F.substring("entity", 1, 1)
    orders = p.select("entity").distinct().withColumn(
        "integration_order", F.when(first == "1", "I(0)").when(first == "2", "I(2)").otherwise("I(1)")
    )
    return ft.stationary_series(p, K, orders)


@query(
    "z_scores",
    f"WITH {pn.PANEL} SELECT entity, q_idx, {r('(value - avg(value) OVER p) / stddev_samp(value) OVER p', 'z')} FROM panel WINDOW p AS (PARTITION BY entity)",
)
def z_scores(spark, d):
    """Full-history z-score with the sample deviation."""
    return ft.zscore(pn.order_panel(spark, d), K).select("entity", "q_idx", "z")


@query(
    "outlier_rows",
    f"""WITH {pn.LINE}, z AS (SELECT entity, q_idx, price AS value, (price - avg(price) OVER p) / stddev_pop(price) OVER p AS z FROM line WINDOW p AS (PARTITION BY entity))
        SELECT entity, q_idx, {rs('value z')} FROM z WHERE abs(z) >= 1.5""",
)
def outlier_rows(spark, d):
    """Rows far from the mean in population deviations."""
    p = pn.line_panel(spark, d).select("entity", "q_idx", F.col("price").alias("value"))
    return ft.flag_outliers(p, K, threshold=1.5)


@query(
    "shock_flags",
    f"""WITH {pn.LINE}, z AS (SELECT entity, q_idx, (price - avg(price) OVER p) / stddev_samp(price) OVER p AS shock_z FROM line WINDOW p AS (PARTITION BY entity))
        SELECT entity, q_idx, {r('shock_z', 'shock_z')}, coalesce(abs(shock_z) > 2, false) AS flagged FROM z""",
)
def shock_flags(spark, d):
    """Event flags by sample z-score."""
    return ft.flag_shocks(pn.line_panel(spark, d), K, "price").select("entity", "q_idx", "shock_z", "flagged")


@query(
    "running_mean",
    f"WITH {pn.SPARSE} SELECT entity, q_idx, {r('avg(gappy) OVER (PARTITION BY entity ORDER BY q_idx ROWS UNBOUNDED PRECEDING)', 'expanding_mean')} FROM sparse",
)
def running_mean(spark, d):
    """Mean of everything up to each quarter."""
    return ft.expanding_mean(pn.sparse_panel(spark, d), K, "gappy").select("entity", "q_idx", "expanding_mean")


@query(
    "expanding_scaler",
    f"""WITH {pn.LINE}, s AS (SELECT entity, q_idx, price, tax, avg(price) OVER p AS m1, stddev_pop(price) OVER p AS s1, avg(tax) OVER p AS m2, stddev_pop(tax) OVER p AS s2
            FROM line WINDOW p AS (PARTITION BY entity ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT entity, q_idx, {r('(price - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END', 'price_scaled')},
               {r('(tax - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END', 'tax_scaled')} FROM s""",
)
def expanding_scaler(spark, d):
    """Standardised with strictly earlier rows only."""
    return ft.expanding_scale(pn.line_panel(spark, d), K, ["price", "tax"]).select("entity", "q_idx", "price_scaled", "tax_scaled")


@query(
    "direct_targets",
    f"WITH {pn.PANEL} SELECT entity, q_idx, {r('lead(value, 1) OVER w', 'value_h1')}, {r('lead(value, 2) OVER w', 'value_h2')}, {r('lead(value, 3) OVER w', 'value_h3')} FROM panel {WIN}",
)
def direct_targets(spark, d):
    """Targets 1 to 3 rows ahead of the features."""
    return ft.direct_targets(pn.order_panel(spark, d), K, "value", 3).drop("value", "n_orders")


@query(
    "time_folds",
    f"""WITH {pn.SEQ}, s AS (SELECT entity, q_idx, rn, n, n // 5 AS size FROM seq)
        SELECT entity, q_idx, CAST(CASE WHEN rn - 1 < n - 4 * size THEN 0 ELSE (rn - 1 - (n - 4 * size)) // size + 1 END AS INTEGER) AS fold FROM s""",
)
def time_folds(spark, d):
    """Chronological fold ids."""
    return ft.time_series_folds(pn.order_panel(spark, d).select("entity", "q_idx"), K, 4)
