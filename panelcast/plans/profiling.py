"""Summary and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import profile as pf
from panelcast.plans import alignment as al
from panelcast.plans import panels as pn
from panelcast.plans.features import BOUNDS, REGIME
from panelcast.plans.registry import query, r, rs

K = pn.K
Q_LABEL = pn.label_sql("q_idx")


@query(
    "annual_means",
    f"""WITH {pn.LINE} SELECT entity, CAST(q_idx // 4 AS INTEGER) AS year, {r('avg(price)', 'avg_price')}, {r('avg(quantity)', 'avg_quantity')},
        {r('avg(discount)', 'avg_discount')}, {r('avg(tax)', 'avg_tax')} FROM line GROUP BY 1, 2""",
)
def annual_means(spark, d):
    """Yearly means of several indicators."""
    return pf.annual_summary(pn.line_panel(spark, d), K, ["price", "quantity", "discount", "tax"])


@query(
    "regime_means",
    f"""WITH {pn.LINE}, l AS (SELECT *, {REGIME} AS regime FROM line)
        SELECT entity, regime, {pn.label_sql('min(q_idx)')} AS first_quarter, {pn.label_sql('max(q_idx)')} AS last_quarter, count(*) AS quarters,
               {r('avg(price)', 'avg_price')}, {r('avg(tax)', 'avg_tax')} FROM l GROUP BY 1, 2""",
)
def regime_means(spark, d):
    """First and last quarter, count and means per regime."""
    return pf.regime_summary(pn.line_panel(spark, d), K, BOUNDS, ["price", "tax"])


@query(
    "benchmark_error_by_horizon",
    f"""WITH {pn.PRED}, {al.BENCH}, e AS (SELECT entity, horizon_quarters, forecast_date, benchmark_reported_error AS x FROM bench WHERE origin_q + horizon_quarters <= 2001 * 4)
        SELECT entity, horizon_quarters, count(*) AS n_forecasts, min(forecast_date) AS first_forecast, max(forecast_date) AS last_forecast,
               {r('avg(x)', 'mean_error')}, {r('avg(abs(x))', 'mae')}, {r('sqrt(avg(x * x))', 'rmse')} FROM e GROUP BY 1, 2""",
)
def benchmark_error_by_horizon(spark, d):
    """Bias, MAE and RMSE of dated outside forecasts per horizon."""
    return pf.error_by_horizon(
        al.outside_forecasts(spark, d), K, "benchmark_forecast", "benchmark_actual", "benchmark_reported_error", 2001 * 4
    )


@query(
    "seasonal_stats",
    f"""WITH {pn.PANEL} SELECT entity, CAST(q_idx % 4 + 1 AS INTEGER) AS season, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')},
        {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM panel GROUP BY 1, 2""",
)
def seasonal_stats(spark, d):
    """Mean, deviation and range per season."""
    return pf.seasonal_stats(pn.order_panel(spark, d), K, "value")


@query(
    "coverage_profile",
    f"""WITH {pn.SPARSE}, u AS (SELECT entity, q_idx, 'value' AS variable, value AS v FROM sparse UNION ALL SELECT entity, q_idx, 'gappy', gappy FROM sparse
             UNION ALL SELECT entity, q_idx, 'late', late FROM sparse),
        g AS (SELECT entity, variable, count(v) AS n, count(*) AS rows, min(q_idx) AS s, min(q_idx) FILTER (v IS NOT NULL) AS a, max(q_idx) FILTER (v IS NOT NULL) AS b FROM u GROUP BY 1, 2)
        SELECT entity, variable, n AS non_null_rows, rows - n AS missing_count, {r('(rows - n) / rows', 'missing_pct')}, {r('n / rows', 'coverage_pct')},
               {pn.label_sql('a')} AS first_non_null, {pn.label_sql('b')} AS last_non_null, coalesce(a <> s, false) AS late_start,
               (rows - n) / rows >= 0.2 AS substantial_missingness,
               CASE WHEN n / rows >= 0.95 THEN 'core_long_sample_candidate' WHEN n / rows >= 0.8 THEN 'shorter_sample_candidate'
                    WHEN n / rows >= 0.5 THEN 'limited_sample_candidate' ELSE 'exclude_low_coverage' END AS coverage_class FROM g""",
)
def coverage_profile(spark, d):
    """Coverage of every column in one pass."""
    return pf.coverage_profile(pn.sparse_panel(spark, d), K, ["value", "gappy", "late"])


@query(
    "table_profile",
    f"""WITH {pn.PANEL} SELECT entity, count(*) AS rows, CAST(3 AS BIGINT) AS columns, {pn.label_sql('min(q_idx)')} AS first_quarter,
        {pn.label_sql('max(q_idx)')} AS last_quarter FROM panel GROUP BY 1""",
)
def table_profile(spark, d):
    """Rows, columns and span."""
    return pf.profile(pn.order_panel(spark, d), K)


@query(
    "integrity_summary",
    f"""WITH o AS (SELECT o_custkey, {pn.q_sql('o_orderdate')} AS q_idx, row_number() OVER () AS n FROM orders),
        s AS (SELECT *, coalesce(q_idx < lag(q_idx) OVER (PARTITION BY o_custkey ORDER BY n), false) AS back FROM o)
        SELECT o_custkey, count(*) AS rows, CAST(1 AS BIGINT) AS columns, {pn.label_sql('min(q_idx)')} AS first_quarter, {pn.label_sql('max(q_idx)')} AS last_quarter,
               count(*) - count(DISTINCT q_idx) AS duplicate_quarters, CAST(max(q_idx) - min(q_idx) + 1 - count(DISTINCT q_idx) AS BIGINT) AS missing_quarters, NOT bool_or(back) AS is_sorted
        FROM s GROUP BY 1""",
)
def integrity_summary(spark, d):
    """Repeated and missing quarters of each customer's order history, and whether its file holds it in order."""
    o = pn.table(spark, d, "orders").select("o_custkey", cal.q_idx("o_orderdate").alias("q_idx"))
    return pf.integrity_summary(o, ["o_custkey"], order="file")


@query(
    "level_shift",
    f"""WITH {pn.PANEL}, s AS (SELECT entity, q_idx, value, lag(value) OVER w AS p, lag(q_idx) OVER w AS pq FROM panel WHERE q_idx BETWEEN 1997 * 4 AND 1998 * 4 + 3
             WINDOW w AS (PARTITION BY entity ORDER BY q_idx)),
        g AS (SELECT entity, coalesce(max(abs(value - p)), 0) AS m, coalesce(abs(avg(value) FILTER (q_idx >= 1998 * 4) - avg(value) FILTER (q_idx < 1998 * 4)), 0) AS s FROM s GROUP BY 1)
        SELECT entity, {r('m', 'max_step')}, {r('s', 'mean_shift')}, m >= 25 OR s >= 25 AS visible_break FROM g""",
)
def level_shift(spark, d):
    """Largest step in a span and shift between two yearly means."""
    span, y1, y2 = (1997 * 4, 1998 * 4 + 3), (1997 * 4, 1997 * 4 + 3), (1998 * 4, 1998 * 4 + 3)
    return pf.level_shift(pn.order_panel(spark, d, *span), K, "value", span, y1, y2, 25.0)


@query(
    "additive_decomposition",
    f"""WITH {pn.PANEL}, t AS (SELECT entity, q_idx, value, (0.5 * lag(value, 2) OVER w + lag(value) OVER w + value + lead(value) OVER w + 0.5 * lead(value, 2) OVER w) / 4 AS trend
             FROM panel WINDOW w AS (PARTITION BY entity ORDER BY q_idx)),
        s AS (SELECT entity, q_idx % 4 AS season, avg(value - trend) AS m FROM t GROUP BY 1, 2),
        c AS (SELECT entity, season, m - avg(m) OVER (PARTITION BY entity) AS seasonal FROM s)
        SELECT entity, q_idx, {rs('value trend seasonal')}, {r('value - trend - seasonal', 'remainder')} FROM t JOIN c USING (entity) WHERE season = q_idx % 4""",
)
def additive_decomposition(spark, d):
    """Trend, seasonal and remainder."""
    return pf.decompose_additive(pn.order_panel(spark, d).drop("n_orders"), K, "value")


@query(
    "autocorrelations",
    f"""WITH {pn.SEQ}, x AS (SELECT entity, rn, n, value - avg(value) OVER (PARTITION BY entity) AS x FROM seq),
        v AS (SELECT entity, sum(x * x) AS d FROM x GROUP BY 1)
        SELECT a.entity, a.rn - b.rn AS lag, {r('sum(a.x * b.x) / any_value(v.d)', 'autocorrelation')} FROM x a JOIN x b ON a.entity = b.entity AND a.rn - b.rn BETWEEN 1 AND least(16, a.n // 2 - 1)
        JOIN v ON v.entity = a.entity GROUP BY 1, 2""".replace("a.rn - b.rn AS lag", "CAST(a.rn - b.rn AS INTEGER) AS lag"),
)
def autocorrelations(spark, d):
    """Autocorrelation table."""
    return pf.acf(pn.order_panel(spark, d), K, "value")


@query(
    "date_spacing",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       g AS (SELECT user_id, day, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY k), day) AS gap FROM e)
       SELECT user_id, count(*) AS rows, min(day) AS start_date, max(day) AS end_date, count(*) - count(DISTINCT day) AS duplicate_dates,
              round(median(gap), 6) + 0.0 AS median_spacing_days FROM g GROUP BY 1""",
)
def date_spacing(spark, d):
    """Span, repeated dates and median spacing of each user's event dates."""
    return pf.frequency_profile(pn.table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts")


@query(
    "latest_rows",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 2""",
)
def latest_rows(spark, d):
    """Last two rows per group."""
    return pf.tail(pn.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderkey", 2)


@query(
    "first_last_range",
    f"""WITH {pn.PANEL} SELECT entity, min(q_idx) AS first_q_idx, max(q_idx) AS last_q_idx, {r('arg_min(value, q_idx)', 'first_value')}, {r('arg_max(value, q_idx)', 'last_value')},
        {r('arg_max(value, q_idx) - arg_min(value, q_idx)', 'change_value')}, {r('max(value) - min(value)', 'range_value')} FROM panel GROUP BY 1""",
)
def first_last_range(spark, d):
    """First against last value and range per entity."""
    return pf.first_last_range(pn.order_panel(spark, d), K, "q_idx", ["value"])


@query(
    "evenly_spaced_quarters",
    f"""WITH {pn.PANEL}, p AS (SELECT DISTINCT entity, q_idx FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q_idx) - 1 AS i, count(*) OVER (PARTITION BY entity) AS m FROM p),
        s AS (SELECT entity, round_even(g * (m - 1) / 3.0, 0) AS i FROM (SELECT DISTINCT entity, m FROM k) CROSS JOIN range(0, 4) AS x(g))
        SELECT entity, q_idx, {r('value', 'value')} FROM panel JOIN k USING (entity, q_idx) WHERE m <= 4 OR (entity, i) IN (SELECT entity, i FROM s)""",
)
def evenly_spaced_quarters(spark, d):
    """Four evenly spaced quarters per entity."""
    return pf.even_sample(pn.order_panel(spark, d).drop("n_orders"), K, "q_idx", 4)


@query(
    "series_edges",
    f"""WITH {pn.SPARSE}, f AS (SELECT * FROM sparse WHERE gappy IS NOT NULL)
        SELECT entity, min(q_idx) AS first_period, max(q_idx) AS last_period, {r('arg_max(gappy, q_idx)', 'latest_value')}, {r('max(gappy)', 'peak_value')},
               arg_max(q_idx, gappy) AS peak_period FROM f GROUP BY 1""",
)
def series_edges(spark, d):
    """First period, latest value, largest value."""
    return pf.edges(pn.sparse_panel(spark, d), K, "gappy")


@query(
    "weighted_discount",
    f"SELECT l_returnflag, {r('sum(l_discount * l_extendedprice)', 'weighted_total', 2)} FROM lineitem GROUP BY 1", digits=2,
)
def weighted_discount(spark, d):
    """Weighted sum per group."""
    return pf.weighted_total(pn.table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_extendedprice")


@query(
    "nonzero_terms",
    "SELECT l_returnflag, l_linestatus, count(*) FILTER (abs(l_tax) > 1e-9) AS nonzero, count(l_tax) AS terms FROM lineitem GROUP BY 1, 2",
)
def nonzero_terms(spark, d):
    """Count of terms that are not zero."""
    return pf.nonzero_by_group(pn.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax")


@query(
    "cheapest_status",
    f"""WITH q AS (SELECT {pn.q_sql('o_orderdate')} AS q_idx, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
        SELECT q_idx, arg_min(s, v) AS best, {r('min(v)', 'best_value')} FROM q GROUP BY 1""",
)
def cheapest_status(spark, d):
    """Name with the smallest value per quarter."""
    o = pn.table(spark, d, "orders").groupBy(cal.q_idx("o_orderdate").alias("q_idx"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return pf.best_by_row(o, ["q_idx"], "o_orderstatus", "v")


@query("event_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    """Value counts per user."""
    return pf.value_counts(pn.table(spark, d, "events"), ["user_id"], "event_type")
