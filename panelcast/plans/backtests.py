"""Backtest, metric and bootstrap queries on the order panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelcast.operators import backtest as bt
from panelcast.operators import bootstrap as bs
from panelcast.operators import callables as ca
from panelcast.plans import alignment as al
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs

K = pn.K
ROW = "entity, model, origin_q, target_q, horizon"


@query(
    "walk_forward_grid",
    f"WITH {pn.PRED} SELECT entity, origin_q, horizon, target_q, {r('actual', 'actual')} FROM grid",
)
def walk_forward_grid(spark, d):
    """Expanding origins with the actual of every horizon."""
    return bt.walk_forward(pn.order_panel(spark, d), K, "value", pn.INITIAL, pn.HORIZONS)


EXOG = f"""{pn.SPARSE}, s AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY entity) AS n,
     count(*) FILTER (gappy IS NOT NULL AND late IS NOT NULL) OVER (PARTITION BY entity ORDER BY q_idx ROWS UNBOUNDED PRECEDING) AS usable FROM sparse WINDOW w AS (PARTITION BY entity ORDER BY q_idx)),
   o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q_idx) AS k FROM s WHERE rn >= 5 AND rn <= n - 2 AND usable >= 5)"""


@query(
    "exogenous_grid",
    f"""WITH {EXOG} SELECT o.entity, o.q_idx AS origin_q, CAST(h AS INTEGER) AS horizon, t.q_idx AS target_q, {r('t.value', 'actual')}
        FROM o CROSS JOIN range(1, 3) AS g(h) JOIN s t ON t.entity = o.entity AND t.rn = o.rn + h WHERE k > 1 AND k <= 5""",
)
def exogenous_grid(spark, d):
    """Origins that also have enough complete feature rows, cut into a block of origins."""
    return bt.walk_forward(
        pn.sparse_panel(spark, d), K, "value", 5, [1, 2], exog=["gappy", "late"], skip_origins=1, max_origins=4
    )


@query(
    "frame_forecaster",
    f"""WITH {EXOG}, w AS (SELECT entity, rn, value, gappy, late, CAST(q_idx AS DOUBLE) AS q FROM s WHERE gappy IS NOT NULL AND late IS NOT NULL),
        m AS (SELECT o.entity, o.rn, o.q_idx, avg(w.value) AS mean, arg_max(w.gappy, w.rn) AS gappy, min(w.late) AS low, count(*) AS n FROM o JOIN w ON w.entity = o.entity AND w.rn <= o.rn WHERE k > 1 AND k <= 7 GROUP BY ALL)
        SELECT m.entity, 'two_inputs' AS model, m.q_idx AS origin_q, t.q_idx AS target_q, CAST(h AS INTEGER) AS horizon, {r('t.value', 'actual')}, {r('mean + 0.1 * h * m.gappy - low / m.n', 'forecast')},
               {r('t.value - (mean + 0.1 * h * m.gappy - low / m.n)', 'error')}
        FROM m CROSS JOIN range(1, 3) AS g(h) JOIN s t ON t.entity = m.entity AND t.rn = m.rn + h""",
)
def frame_forecaster(spark, d):
    """A Python forecaster on frames of whole rows with two inputs, over a block of origins in chunks of four."""

    def two_inputs(train, steps):
        return [train["value"].mean() + 0.1 * h * train["gappy"].iloc[-1] - train["late"].min() / len(train) for h in range(1, steps + 1)]

    return ca.walk_forward_frames(
        pn.sparse_panel(spark, d), K, "value", ["gappy", "late"], 5, [1, 2], two_inputs, "two_inputs", skip_origins=1, max_origins=6, origins_per_task=4
    )


NOISE = "CAST(('0x' || substr(md5(concat_ws(':', 42 + k - 2, i, h)), 1, 8)) AS BIGINT) % 2001 - 1000"


def _md5_noise(seed: int, draw: int, step: int) -> float:
    import hashlib

    return int(hashlib.md5(f"{seed}:{draw}:{step}".encode()).hexdigest()[:8], 16) % 2001 - 1000


def md5_paths(train, steps: int, n_sims: int, seed: int) -> np.ndarray:
    """The last value plus noise from a hash of seed, draw and step, wider the further ahead."""
    noise = [[_md5_noise(seed, i, h) * h / 100 for h in range(1, steps + 1)] for i in range(n_sims)]
    return float(train["value"].iloc[-1]) + np.array(noise)


@query(
    "draw_backtest",
    f"""WITH {EXOG}, w AS (SELECT entity, rn, value FROM s WHERE gappy IS NOT NULL AND late IS NOT NULL),
        m AS (SELECT o.entity, o.rn, o.q_idx, k, arg_max(w.value, w.rn) AS latest FROM o JOIN w ON w.entity = o.entity AND w.rn <= o.rn WHERE k > 1 GROUP BY ALL),
        q AS (SELECT m.entity, m.rn, m.q_idx, h, quantile_cont(latest + ({NOISE}) * h / 100.0::DOUBLE, [0.1, 0.5, 0.9]) AS c FROM m, range(1, 3) AS g(h), range(0, 50) AS d(i) GROUP BY ALL),
        v AS (SELECT q.entity, 'md5' AS model, q.q_idx AS origin_q, t.q_idx AS target_q, CAST(h AS INTEGER) AS horizon, t.value AS actual, c[1] AS interval_lower, c[2] AS point_forecast, c[3] AS interval_upper
              FROM q JOIN s t ON t.entity = q.entity AND t.rn = q.rn + h)
        SELECT entity, model, origin_q, target_q, horizon, {rs('actual interval_lower point_forecast interval_upper')}, interval_lower <= actual AND actual <= interval_upper AS hit,
               {r('interval_upper - interval_lower', 'interval_width')},
               {r("CASE WHEN actual = point_forecast THEN 0 WHEN actual < point_forecast THEN (point_forecast - actual) / (point_forecast - interval_lower) ELSE (actual - point_forecast) / (interval_upper - point_forecast) END", 'nonconformity_score')} FROM v""",
)
def draw_backtest(spark, d):
    """Intervals of a Python simulator's draws, seeded by the origins completed before, scored against the actuals."""
    made = ca.walk_forward_draws(
        pn.sparse_panel(spark, d), K, "value", 5, [1, 2], md5_paths, "md5", 50, 42, inputs=["gappy", "late"], skip_origins=1, origins_per_task=3
    )
    return ca.interval_backtest(made, K)


def _model_query(name, doc):
    def run(spark, d):
        return pn.predictions(spark, d).where(F.col("model") == name)

    run.__doc__ = doc
    return run


for _name, _doc in (
    ("seasonal_naive", "Seasonal-naive backtest."), ("long_run_mean", "Long-run-mean benchmark on the grid."),
):
    query(
        f"{_name}_backtest",
        f"WITH {pn.PRED} SELECT {ROW}, {rs('actual forecast error')} FROM pred WHERE model = '{_name}'",
    )(_model_query(_name, _doc))


@query(
    "drift_group_forecaster",
    f"""WITH {pn.PRED}, f AS (SELECT g.*, s1.value AS first_value, at_origin + (at_origin - s1.value) * horizon / (g.rn - 1) AS forecast FROM grid g JOIN seq s1 ON s1.entity = g.entity AND s1.rn = 1)
        SELECT entity, 'drift' AS model, origin_q, target_q, horizon, {rs('actual forecast')}, {r('actual - forecast', 'error')} FROM f""",
)
def drift_group_forecaster(spark, d):
    """A Python forecaster run per entity over its origins."""

    def drift(history: np.ndarray, steps: int) -> np.ndarray:
        slope = (history[-1] - history[0]) / (len(history) - 1)
        return history[-1] + slope * np.arange(1, steps + 1)

    return bt.walk_forward_groups(pn.order_panel(spark, d), K, "value", pn.INITIAL, pn.HORIZONS, drift, "drift")


@query(
    "drift_expression_forecaster",
    f"""WITH {pn.PRED}, f AS (SELECT g.*, at_origin + (at_origin - s1.value) * horizon / (g.rn - 1) AS forecast FROM grid g JOIN seq s1 ON s1.entity = g.entity AND s1.rn = 1)
        SELECT entity, 'drift' AS model, origin_q, target_q, horizon, {rs('actual forecast')}, {r('actual - forecast', 'error')} FROM f""",
)
def drift_expression_forecaster(spark, d):
    """The same forecaster as a column expression."""
    return bt.walk_forward(
        pn.order_panel(spark, d), K, "value", pn.INITIAL, pn.HORIZONS, {"drift": bt.drift("value", K)}
    )


@query(
    "fixed_step_mse",
    f"""WITH {pn.SEQ} SELECT t.entity, count(*) AS n, {r('avg((t.value - s.value) * (t.value - s.value))', 'mse')}
        FROM seq t JOIN seq s ON s.entity = t.entity AND s.rn = t.rn - 4 WHERE t.rn >= 8 + 4 GROUP BY 1""",
)
def fixed_step_mse(spark, d):
    """MSE of the seasonal random walk at a fixed step."""
    return bt.rolling_fixed_step_mse(pn.order_panel(spark, d), K, "value", 8, 4)


def ragged(spark, d):
    """Predictions where one model lacks its first origins and another has missing forecasts."""
    p = pn.predictions(spark, d)
    late = (F.col("model") == "seasonal_naive") & (F.col("origin_q") < 1998 * 4)
    hole = (F.col("model") == "last_value") & (F.col("origin_q") % 5 == 0)
    return p.where(~late).withColumns(
        {c: F.when(~hole, F.col(c)) for c in ("forecast", "error")}
    )


RAGGED = f"""{pn.PRED}, ragged AS (SELECT entity, model, origin_q, target_q, horizon, actual, CASE WHEN NOT (model = 'last_value' AND origin_q % 5 = 0) THEN forecast END AS forecast,
     CASE WHEN NOT (model = 'last_value' AND origin_q % 5 = 0) THEN error END AS error FROM pred WHERE NOT (model = 'seasonal_naive' AND origin_q < 1998 * 4)),
   complete AS (SELECT * FROM ragged WHERE forecast IS NOT NULL AND error IS NOT NULL AND actual IS NOT NULL),
   cells AS (SELECT entity, origin_q, target_q, horizon FROM complete GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT model) = 3),
   common AS (SELECT c.* FROM complete c JOIN cells USING (entity, origin_q, target_q, horizon)),
   detail AS (SELECT entity, model, horizon, count(*) AS n, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, count(DISTINCT origin_q) AS origins FROM common
              GROUP BY GROUPING SETS ((entity, model), (entity, model, horizon))),
   metrics AS (SELECT *, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain FROM detail),
   best AS (SELECT entity, grain, horizon, first(model ORDER BY round(rmse, 9), CASE model WHEN 'seasonal_naive' THEN 0 WHEN 'last_value' THEN 1 ELSE 2 END) AS best_model FROM metrics GROUP BY 1, 2, 3)"""


@query("common_grid", f"WITH {RAGGED} SELECT {ROW}, {rs('actual forecast error')} FROM common")
def common_grid(spark, d):
    """Cells every model has."""
    return bt.common_grid(ragged(spark, d), K)


@query("metric_table", f"WITH {RAGGED} SELECT entity, model, grain, horizon, n, {rs('rmse mae')} FROM metrics")
def metric_table(spark, d):
    """n, RMSE and MAE overall and per horizon."""
    return bt.metric_table(bt.common_grid(ragged(spark, d), K), K)


@query(
    "line_price_backtest_metrics",
    f"""WITH {pn.LINE}, s AS (SELECT entity, q_idx, price, row_number() OVER (PARTITION BY entity ORDER BY q_idx) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM line),
        e AS (SELECT o.entity, CAST(h AS INTEGER) AS horizon, t.price - o.price AS error FROM s o CROSS JOIN range(1, 9) AS g(h) JOIN s t ON t.entity = o.entity AND t.rn = o.rn + h WHERE o.rn >= 8 AND o.rn <= o.n - 8)
        SELECT entity, 'last_value' AS model, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain, horizon, count(*) AS n, {r('sqrt(avg(error * error))', 'rmse')}, {r('avg(abs(error))', 'mae')}
        FROM e GROUP BY GROUPING SETS ((entity), (entity, horizon))""",
)
def line_price_backtest_metrics(spark, d):
    """Eight-horizon backtest of mean line prices, from the raw line items to the metric table."""
    p = pn.line_panel(spark, d)
    return bt.metric_table(bt.walk_forward(p, K, "price", 8, list(range(1, 9)), {"last_value": bt.last_value("price", K)}), K)


REPORT = f"""SELECT m.entity, m.model, m.grain, m.horizon, m.n, {rs('rmse mae')}, 'shared_grid' AS comparison_grid, 'evaluated' AS evaluation_status, origins AS forecast_origin_n,
   '1-4' AS evaluated_horizons, best_model FROM metrics m JOIN best b ON b.entity = m.entity AND b.grain = m.grain AND b.horizon IS NOT DISTINCT FROM m.horizon"""


@query("model_comparison", f"WITH {RAGGED} {REPORT}")
def model_comparison(spark, d):
    """Common grid, metrics, grid metadata and best model."""
    return bt.model_comparison([ragged(spark, d)], K, pn.HORIZONS, pn.MODELS)


@query("best_per_horizon", f"WITH {RAGGED} SELECT DISTINCT entity, grain, horizon, best_model FROM best")
def best_per_horizon(spark, d):
    """Best model per horizon and overall."""
    return model_comparison(spark, d).select("entity", "grain", "horizon", "best_model").distinct()


@query(
    "ordered_report",
    f"""WITH {RAGGED} SELECT entity, model, grain, horizon, {r('rmse', 'rmse')}, row_number() OVER (PARTITION BY entity ORDER BY coalesce(horizon, 0),
          CASE model WHEN 'seasonal_naive' THEN 0 WHEN 'last_value' THEN 1 ELSE 2 END) AS position FROM metrics""",
)
def ordered_report(spark, d):
    """Report order: overall first, then horizons, models by fixed rank."""
    from pyspark.sql import Window as W

    from panelcast.operators.reshape import rank_of

    m = metric_table(spark, d).select("entity", "model", "grain", "horizon", "rmse")
    w = W.partitionBy("entity").orderBy(F.coalesce("horizon", F.lit(0)), rank_of("model", pn.MODELS))
    return bt.report_order(m.withColumn("position", F.row_number().over(w).cast("bigint")), K, pn.MODELS)


@query(
    "overall_rows",
    f"WITH {RAGGED} SELECT entity, model, n, {rs('rmse mae')} FROM metrics WHERE grain = 'overall' AND model <> 'seasonal_naive'",
)
def overall_rows(spark, d):
    """Overall rows without the benchmark."""
    return bt.overall_slice(metric_table(spark, d), ["seasonal_naive"], ["entity", "model", "n", "rmse", "mae"])


PAIR = f"""{pn.PRED}, pair AS (SELECT a.entity, a.origin_q, a.target_q, a.horizon, a.actual, a.forecast AS fa, b.forecast AS fb, a.forecast - a.actual AS ea, b.forecast - b.actual AS eb
   FROM pred a JOIN pred b USING (entity, origin_q, target_q, horizon) WHERE a.model = 'last_value' AND b.model = 'long_run_mean')"""


@query(
    "combined_model",
    f"""WITH {PAIR} SELECT entity, 'ensemble' AS model, origin_q, target_q, horizon, {r('actual', 'actual')}, {r('0.5 * fa + 0.5 * fb', 'forecast')},
        {r('actual - (0.5 * fa + 0.5 * fb)', 'error')}, true AS actuals_agree FROM pair""",
)
def combined_model(spark, d):
    """Average of two models on their shared cells."""
    p = pn.predictions(spark, d)
    return bt.combine_models(p.where("model = 'last_value'"), p.where("model = 'long_run_mean'"), K)


WEIGHTS = "SELECT CAST(i AS DOUBLE) / 100 AS w FROM range(0, 101) AS g(i)"


@query(
    "hindsight_weights",
    f"""WITH {PAIR}, w AS ({WEIGHTS}), s AS (SELECT entity, horizon, w, count(*) AS n, sum(power(w * ea + (1 - w) * eb, 2)) AS sse FROM pair CROSS JOIN w GROUP BY 1, 2, 3)
        SELECT entity, horizon, any_value(n) AS n, {r('arg_min(w, sse)', 'weight')} FROM s GROUP BY 1, 2""",
)
def hindsight_weights(spark, d):
    """Best combination weight on a 101-point grid, per horizon."""
    return bt.best_weight_hindsight(pn.predictions(spark, d), K, "last_value", "long_run_mean")


@query(
    "real_time_weights",
    f"""WITH {PAIR}, w AS ({WEIGHTS}), s AS (SELECT n.entity, n.origin_q, n.target_q, n.horizon, n.actual, n.fa, n.fb, w, count(*) AS n, sum(power(w * p.ea + (1 - w) * p.eb, 2)) AS sse
              FROM pair n JOIN pair p ON p.entity = n.entity AND p.horizon = n.horizon AND p.target_q <= n.origin_q CROSS JOIN w GROUP BY ALL HAVING count(*) >= 8),
        b AS (SELECT entity, origin_q, target_q, horizon, actual, fa, fb, any_value(n) AS n, arg_min(w, sse) AS weight FROM s GROUP BY 1, 2, 3, 4, 5, 6, 7)
        SELECT entity, origin_q, target_q, horizon, n, {rs('weight actual')}, {r('weight * fa + (1 - weight) * fb', 'forecast')}, {r('actual - (weight * fa + (1 - weight) * fb)', 'error')} FROM b""",
)
def real_time_weights(spark, d):
    """Weight per origin from errors known at it."""
    return bt.best_weight_real_time(pn.predictions(spark, d), K, "last_value", "long_run_mean")


@query(
    "baseline_bundle",
    f"""WITH {pn.PRED}, {al.BENCH} SELECT {ROW}, {rs('actual forecast error')}, CAST(NULL AS DOUBLE) AS benchmark_actual, CAST(NULL AS DOUBLE) AS benchmark_reported_error FROM pred WHERE model = 'seasonal_naive'
        UNION ALL SELECT {ROW}, {rs('actual forecast error benchmark_actual benchmark_reported_error')} FROM aligned""",
)
def baseline_bundle(spark, d):
    """Seasonal naive stacked with the aligned outside benchmark."""
    return bt.baselines(
        pn.order_panel(spark, d), K, "value", pn.INITIAL, pn.HORIZONS, al.outside_forecasts(spark, d)
    )


@query(
    "benchmark_gap",
    f"""WITH {pn.PRED}, {al.BENCH} SELECT p.entity, p.model, count(*) AS n, count(DISTINCT p.origin_q) AS origins, {r('sqrt(avg(p.error * p.error))', 'rmse')},
        {r('sqrt(avg(a.benchmark_reported_error * a.benchmark_reported_error))', 'benchmark_rmse')}, {r('avg(abs(a.benchmark_actual - p.actual))', 'mean_basis_gap')},
        {r('max(abs(a.benchmark_actual - p.actual))', 'max_basis_gap')} FROM pred p JOIN aligned a USING (entity, origin_q, target_q, horizon) GROUP BY 1, 2""",
)
def benchmark_gap(spark, d):
    """Model errors beside the benchmark's errors against its own actual."""
    return bt.benchmark_gap(pn.predictions(spark, d), al.benchmark_on_grid(spark, d), K)


@query(
    "variant_comparison",
    f"""WITH {RAGGED}, a AS (SELECT * FROM complete WHERE model = 'seasonal_naive'), b AS (SELECT * FROM complete WHERE model = 'last_value'),
        j AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.horizon, b.horizon) AS horizon, a.error AS ea, b.error AS eb FROM a FULL JOIN b ON a.entity = b.entity AND a.origin_q = b.origin_q AND a.horizon = b.horizon),
        g AS (SELECT entity, horizon, count(*) FILTER (ea IS NOT NULL AND eb IS NOT NULL) AS n, sqrt(avg(ea * ea) FILTER (eb IS NOT NULL)) AS ra, sqrt(avg(eb * eb) FILTER (ea IS NOT NULL)) AS rb,
              count(*) FILTER (eb IS NULL) AS oa, count(*) FILTER (ea IS NULL) AS ob FROM j GROUP BY 1, 2)
        SELECT entity, horizon, n, {r('ra', 'rmse_first')}, {r('rb', 'rmse_second')}, oa AS origins_only_first, ob AS origins_only_second, {r('(rb - ra) / ra * 100', 'rmse_change_pct')} FROM g""",
)
def variant_comparison(spark, d):
    """Two variants on the origins both can forecast."""
    p = ragged(spark, d).dropna(subset=["error"])
    return bt.compare_variants(p.where("model = 'seasonal_naive'"), p.where("model = 'last_value'"), K, "first", "second")


IDX = "CAST(concat('0x', substr(md5(concat('42:', {rep}, ':', {slot})), 1, 8)) AS UBIGINT)"


@query(
    "resampled_quarters",
    f"""WITH {pn.SEQ}, k AS (SELECT DISTINCT entity, n FROM seq), p AS (SELECT entity, CAST(rep AS INTEGER) AS rep, slot, CAST({IDX.format(rep='rep', slot='slot')} % n AS BIGINT) AS i FROM k CROSS JOIN range(0, 20) AS a(rep), LATERAL (SELECT unnest(range(0, n)) AS slot))
        SELECT p.entity, rep, slot, q_idx, {r('value', 'value')} FROM p JOIN seq s ON s.entity = p.entity AND s.rn = p.i + 1""",
)
def resampled_quarters(spark, d):
    """Deterministic resamples of each entity's quarters."""
    return bs.resample(pn.order_panel(spark, d).drop("n_orders"), K, "q_idx", 20, 42)


REPS = 2000


@query(
    "bootstrap_rmse_gap",
    f"""WITH {PAIR}, u AS (SELECT entity, origin_q, sum(ea * ea) AS a, sum(eb * eb) AS b, count(*) AS c, row_number() OVER (PARTITION BY entity ORDER BY origin_q) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM pair GROUP BY 1, 2),
        k AS (SELECT DISTINCT entity, n FROM u), p AS (SELECT entity, rep, CAST({IDX.format(rep='rep', slot='slot')} % n AS BIGINT) AS i FROM k CROSS JOIN range(0, {REPS}) AS a(rep), LATERAL (SELECT unnest(range(0, n)) AS slot)),
        g AS (SELECT p.entity, rep, sqrt(sum(a) / sum(c)) - sqrt(sum(b) / sum(c)) AS gap FROM p JOIN u USING (entity, i) GROUP BY 1, 2),
        t AS (SELECT entity, count(*) AS origins, sqrt(sum(a) / sum(c)) - sqrt(sum(b) / sum(c)) AS gap FROM u GROUP BY 1)
        SELECT t.entity, origins, {r('t.gap', 'gap')}, {r('quantile_cont(g.gap, 0.025)', 'ci_lower')}, {r('quantile_cont(g.gap, 0.975)', 'ci_upper')} FROM t JOIN g USING (entity) GROUP BY t.entity, origins, t.gap""",
)
def bootstrap_rmse_gap(spark, d):
    """Paired bootstrap of an RMSE gap over origins."""
    return bs.bootstrap_gap(pn.predictions(spark, d), K, "last_value", "long_run_mean", REPS, 42)
