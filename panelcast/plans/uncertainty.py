"""Interval, calibration, draw and stress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import draws as dr
from panelcast.operators import intervals as iv
from panelcast.operators import stress as st
from panelcast.operators.skew import exact_quantiles
from panelcast.plans import panels as pn
from panelcast.plans.backtests import IDX
from panelcast.plans.registry import binomial_sql, query, r, rs
from panelcast.sources.stage import staged

K = pn.K
KEY = "entity, model, origin_q, horizon"
COVER = 0.9 - 0.1


@query(
    "scored_intervals",
    f"""WITH {pn.IVL} SELECT {KEY}, target_q, {rs('actual interval_lower point_forecast interval_upper interval_width nonconformity_score')}, hit FROM ivl""",
)
def scored_intervals(spark, d):
    """Percentile interval per draw group, scored against the actual."""
    return pn.interval_rows(spark, d)


ROLL = f"""{pn.IVL}, roll AS (
  SELECT o.entity, o.model, o.origin_q, o.horizon, n, CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS target_coverage,
         greatest(1.0, s[least(n, CAST(ceil((n + 1) * (CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS BIGINT))]) AS scale_factor
  FROM (SELECT o.entity, o.model, o.origin_q, list_sort(list(x.nonconformity_score)) AS s, count(*) AS n
        FROM (SELECT DISTINCT entity, model, origin_q FROM ivl) o JOIN ivl x ON x.entity = o.entity AND x.model = o.model
          AND x.target_q <= o.origin_q AND x.target_q > o.origin_q - 12 AND isfinite(x.nonconformity_score)
        GROUP BY 1, 2, 3 HAVING count(*) >= 8) w JOIN (SELECT DISTINCT entity, model, origin_q, horizon FROM ivl) o USING (entity, model, origin_q))"""


@query("rolling_factors", f"WITH {ROLL} SELECT {KEY}, n AS calibration_n, {rs('target_coverage scale_factor')} FROM roll")
def rolling_factors(spark, d):
    """Scale factor per origin from scores known at it."""
    return iv.rolling_factors(pn.interval_rows(spark, d), K, COVER)


@query(
    "serving_factors",
    f"""WITH {pn.IVL}, w AS (SELECT entity, model, list_sort(list(nonconformity_score)) AS s, count(*) AS n FROM ivl
            WHERE target_q > (SELECT max(target_q) FROM ivl) - 12 AND isfinite(nonconformity_score) GROUP BY 1, 2 HAVING count(*) >= 8)
        SELECT entity, model, horizon, n AS calibration_n, {r('CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE)', 'target_coverage')},
          {r("greatest(1.0, s[least(n, CAST(ceil((n + 1) * (CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS BIGINT))])", 'scale_factor')}
        FROM w JOIN (SELECT DISTINCT entity, model, horizon FROM ivl) h USING (entity, model)""",
)
def serving_factors(spark, d):
    """Factor at the latest observed target quarter."""
    return iv.current_factors(pn.interval_rows(spark, d), K, COVER)


CAL = f"""{ROLL}, cal AS (SELECT i.entity, i.model, i.origin_q, i.horizon, i.target_q, i.actual, i.point_forecast, i.nonconformity_score, f.scale_factor AS f,
    CASE WHEN f.scale_factor IS NULL THEN interval_lower ELSE point_forecast - (point_forecast - interval_lower) * f.scale_factor END AS lo,
    CASE WHEN f.scale_factor IS NULL THEN interval_upper ELSE point_forecast + (interval_upper - point_forecast) * f.scale_factor END AS hi FROM ivl i LEFT JOIN roll f USING (entity, model, origin_q, horizon))"""


@query(
    "calibrated_intervals",
    f"""WITH {CAL} SELECT {KEY}, target_q, {rs('actual point_forecast nonconformity_score')}, {r('lo', 'interval_lower')}, {r('hi', 'interval_upper')}, lo <= actual AND actual <= hi AS hit,
        {r('hi - lo', 'interval_width')}, f IS NOT NULL AS interval_calibrated, {r('f', 'interval_scale_factor')} FROM cal""",
)
def calibrated_intervals(spark, d):
    """Intervals scaled per side; origins without a factor stay raw."""
    return iv.calibrate_rolling(pn.interval_rows(spark, d), K, COVER)


@query(
    "factor_table_applied",
    f"""WITH {pn.IVL}, w AS (SELECT entity, model, list_sort(list(nonconformity_score)) AS s, count(*) AS n FROM ivl
            WHERE target_q > (SELECT max(target_q) FROM ivl) - 12 AND isfinite(nonconformity_score) GROUP BY 1, 2 HAVING count(*) >= 8),
        f AS (SELECT entity, model, greatest(1.0, s[least(n, CAST(ceil((n + 1) * (CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS BIGINT))]) AS f FROM w WHERE model = 'history')
        SELECT {KEY}, target_q, {rs('actual point_forecast nonconformity_score')}, {r('CASE WHEN f IS NULL THEN interval_lower ELSE point_forecast - (point_forecast - interval_lower) * f END', 'interval_lower')},
          {r('CASE WHEN f IS NULL THEN interval_upper ELSE point_forecast + (interval_upper - point_forecast) * f END', 'interval_upper')},
          CASE WHEN f IS NULL THEN hit ELSE point_forecast - (point_forecast - interval_lower) * f <= actual AND actual <= point_forecast + (interval_upper - point_forecast) * f END AS hit,
          {r('interval_width * coalesce(f, 1)', 'interval_width')}, f IS NOT NULL AS interval_calibrated, {r('f', 'interval_scale_factor')} FROM ivl LEFT JOIN f USING (entity, model)""",
)
def factor_table_applied(spark, d):
    """A stored factor table joined to the intervals; the model without factors stays raw."""
    ivl = staged(pn.interval_rows(spark, d))
    return iv.apply_factors(ivl, iv.current_factors(ivl, K, COVER).where("model = 'history'"), K)


@query(
    "coverage_counts",
    f"""WITH {CAL}, c AS (SELECT entity, model, horizon, lo <= actual AND actual <= hi AS hit, hi - lo AS width FROM cal)
        SELECT entity, model, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain, horizon, count(*) AS n, count(*) FILTER (hit) AS hits,
          {r('count(*) FILTER (hit) / count(*)', 'empirical_coverage')}, {r('avg(width)', 'mean_interval_width')} FROM c GROUP BY GROUPING SETS ((entity, model), (entity, model, horizon))""",
)
def coverage_counts(spark, d):
    """Coverage and width of calibrated intervals, overall and per horizon."""
    return iv.coverage_counts(calibrated_intervals(spark, d), K)


NOMINAL = "(CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))"
IDS = "entity, model, grain, hkey"


@query(
    "coverage_table",
    f"""WITH RECURSIVE {CAL}, cv0 AS (SELECT entity, model, horizon, lo <= actual AND actual <= hi AS hit, hi - lo AS width FROM cal),
        cv AS (SELECT entity, model, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain, coalesce(horizon, 0) AS hkey, horizon, count(*) AS n, count(*) FILTER (hit) AS hits, avg(width) AS w
               FROM cv0 GROUP BY GROUPING SETS ((entity, model), (entity, model, horizon))), {binomial_sql('cv', IDS, NOMINAL)}
        SELECT entity, model, grain, horizon, n, {r(NOMINAL, 'nominal_coverage')}, {r('hits / n', 'empirical_coverage')}, {r('lower', 'coverage_ci_lower')}, {r('upper', 'coverage_ci_upper')}, {r('p_value', 'binom_p_value')},
          p_value < 0.05 AS significantly_miscalibrated, {r('w', 'mean_interval_width')} FROM cv JOIN ci USING ({IDS}) JOIN pv USING ({IDS})""",
)
def coverage_table(spark, d):
    """Coverage with exact binomial test and bounds."""
    return iv.coverage_table(calibrated_intervals(spark, d), K)


HELD = f"""{CAL}, o AS (SELECT entity, model, origin_q, row_number() OVER (PARTITION BY entity, model ORDER BY origin_q) AS k, count(*) OVER (PARTITION BY entity, model) AS n
      FROM (SELECT DISTINCT entity, model, origin_q FROM ivl)),
   held AS (SELECT entity, model, origin_q FROM o WHERE n >= 2 AND k > greatest(1, least(n - 1, floor(n * CAST(0.7 AS DOUBLE))))),
   j AS (SELECT c.entity, c.model, c.horizon, i.hit AS raw_hit, i.interval_width AS raw_w, lo <= c.actual AND c.actual <= hi AS cal_hit, hi - lo AS cal_w, n AS cn, f FROM cal c JOIN held USING (entity, model, origin_q)
      JOIN ivl i USING (entity, model, origin_q, horizon) LEFT JOIN (SELECT entity, model, origin_q, horizon, n FROM roll) x USING (entity, model, origin_q, horizon)),
   cmp AS (SELECT entity, model, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain, horizon, CASE WHEN horizon IS NOT NULL THEN median(cn) END AS calibration_n, count(*) AS validation_n,
      CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS target_coverage, CASE WHEN horizon IS NOT NULL THEN avg(f) END AS scale_factor, count(*) FILTER (raw_hit) / count(*) AS raw_empirical_coverage,
      avg(raw_w) AS raw_mean_interval_width, count(*) FILTER (cal_hit) / count(*) AS calibrated_empirical_coverage, avg(cal_w) AS calibrated_mean_interval_width
      FROM j GROUP BY GROUPING SETS ((entity, model), (entity, model, horizon)))"""


@query(
    "heldout_comparison",
    f"""WITH {HELD} SELECT entity, model, grain, horizon, validation_n, {rs('calibration_n target_coverage scale_factor raw_empirical_coverage raw_mean_interval_width calibrated_empirical_coverage calibrated_mean_interval_width')} FROM cmp""",
)
def heldout_comparison(spark, d):
    """Before and after calibration on held-out origins."""
    return iv.heldout_comparison(pn.interval_rows(spark, d), K, tests=False)


@query(
    "heldout_tests",
    f"""WITH RECURSIVE {HELD}, sides AS (SELECT entity, model, CASE WHEN horizon IS NULL THEN 'overall' ELSE 'horizon' END AS grain, coalesce(horizon, 0) AS hkey, s, count(*) AS n, count(*) FILTER (CASE s WHEN 'raw' THEN raw_hit ELSE cal_hit END) AS hits
              FROM j CROSS JOIN (VALUES ('raw'), ('cal')) AS v(s) GROUP BY GROUPING SETS ((entity, model, s), (entity, model, s, horizon))), {binomial_sql('sides', IDS + ', s', NOMINAL)},
        p AS (SELECT {IDS}, max(p_value) FILTER (s = 'raw') AS pr, max(p_value) FILTER (s = 'cal') AS pc FROM pv GROUP BY {IDS})
        SELECT c.entity, c.model, c.grain, c.horizon, validation_n, {rs('calibration_n target_coverage scale_factor raw_empirical_coverage raw_mean_interval_width calibrated_empirical_coverage calibrated_mean_interval_width')},
          {r('pr', 'raw_binom_p_value')}, pr < 0.05 AS raw_significantly_miscalibrated, {r('pc', 'calibrated_binom_p_value')}, pc < 0.05 AS calibrated_significantly_miscalibrated
        FROM cmp c JOIN p ON p.entity = c.entity AND p.model = c.model AND p.grain = c.grain AND p.hkey = coalesce(c.horizon, 0)""",
)
def heldout_tests(spark, d):
    """The held-out comparison with exact tests on both sides."""
    return iv.heldout_comparison(pn.interval_rows(spark, d), K)


@query(
    "factor_summary",
    f"WITH {ROLL} SELECT entity, model, horizon, {r('median(n)', 'calibration_n')}, {r('avg(scale_factor)', 'scale_factor')} FROM roll GROUP BY 1, 2, 3",
)
def factor_summary(spark, d):
    """Median sample and mean factor per horizon."""
    return iv.factor_summary(iv.rolling_factors(pn.interval_rows(spark, d), K, COVER), K)


@query(
    "served_intervals",
    f"""WITH {HELD}, last AS (SELECT * FROM ivl QUALIFY origin_q = max(origin_q) OVER (PARTITION BY entity, model)),
        w AS (SELECT entity, model, list_sort(list(nonconformity_score)) AS s, count(*) AS n FROM ivl WHERE target_q > (SELECT max(target_q) FROM ivl) - 12 AND isfinite(nonconformity_score) GROUP BY 1, 2 HAVING count(*) >= 8),
        fac AS (SELECT entity, model, greatest(1.0, s[least(n, CAST(ceil((n + 1) * (CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS BIGINT))]) AS f FROM w)
        SELECT l.entity, l.model, l.origin_q, l.horizon, {r('point_forecast', 'forecast')}, {r('point_forecast - coalesce(fac.f, 1) * (point_forecast - interval_lower)', 'interval_lower')},
           {r('point_forecast + coalesce(fac.f, 1) * (interval_upper - point_forecast)', 'interval_upper')}, {r('c.calibrated_empirical_coverage', 'empirical_coverage')}, c.validation_n AS coverage_n,
           CAST(NULL AS BOOLEAN) AS significantly_miscalibrated
        FROM last l LEFT JOIN fac ON fac.entity = l.entity AND fac.model = l.model LEFT JOIN cmp c ON c.entity = l.entity AND c.model = l.model AND c.horizon = l.horizon""",
)
def served_intervals(spark, d):
    """Calibrated bounds and disclosed coverage of each entity's latest forecasts."""
    ivl = staged(pn.interval_rows(spark, d))
    last = ivl.groupBy("entity", "model").agg(F.max("origin_q").alias("origin_q"))
    fc = ivl.join(last, ["entity", "model", "origin_q"]).select(
        "entity", "model", "origin_q", "horizon", F.col("point_forecast").alias("forecast"), "interval_lower", "interval_upper"
    )
    cover = iv.heldout_comparison(ivl, K, tests=False)
    return iv.serve_intervals(fc, iv.current_factors(ivl, K, COVER), cover, K, 0.1, 0.9)


RAW_DRAWS = f"raw_draws AS (SELECT l_returnflag AS entity, {pn.q_sql('l_shipdate')} AS q_idx, l_orderkey * 10 + l_linenumber AS draw_id, l_extendedprice / 997 AS value FROM lineitem)"


def price_draws(spark, d):
    """Single line prices as the draws of a (flag, quarter) group: group size grows with the data."""
    li = pn.table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("entity"), cal.q_idx("l_shipdate").alias("q_idx"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("draw_id"), (F.col("l_extendedprice") / 997).alias("value"),
    )


G = ["entity", "q_idx"]


def _quantile_list(pairs):
    return ", ".join(r(f"quantile_cont(value, {p})", n) for n, p in pairs.items())


@query("price_fan", f"WITH {RAW_DRAWS} SELECT entity, q_idx, {_quantile_list(dr.FAN)} FROM raw_draws GROUP BY 1, 2")
def price_fan(spark, d):
    """Five percentiles of every group, exact at any group size."""
    return dr.fan(price_draws(spark, d), G)


@query(
    "price_fan_split_groups",
    f"WITH {RAW_DRAWS} SELECT entity, {_quantile_list(dr.FAN)} FROM raw_draws GROUP BY 1",
)
def price_fan_split_groups(spark, d):
    """The same over three very large groups, each spread over many tasks."""
    return dr.fan(price_draws(spark, d), K)


EDGE = """edge AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS entity, l_linenumber AS line,
   CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 97 = 0 AND l_linenumber < 4 THEN CAST('infinity' AS DOUBLE) WHEN l_quantity < 2 AND l_linenumber >= 4 THEN CAST('-infinity' AS DOUBLE) ELSE l_extendedprice / 997 END AS value FROM lineitem)"""


@query(
    "edge_quantiles",
    f"""WITH {EDGE}, s AS (SELECT entity, line, list_sort(list(value) FILTER (value IS NOT NULL)) AS v, count(value) AS n FROM edge GROUP BY 1, 2),
        q AS (SELECT entity, line, n, v, p, p * (n - 1) AS pos FROM s, (VALUES ('p0', 0.0::DOUBLE), ('mid', 0.5::DOUBLE), ('p100', 1.0::DOUBLE)) AS t(name, p)),
        x AS (SELECT entity, line, n, p, CASE WHEN pos = floor(pos) OR v[CAST(floor(pos) AS BIGINT) + 1] = v[CAST(ceil(pos) AS BIGINT) + 1] THEN v[CAST(floor(pos) AS BIGINT) + 1]
              ELSE v[CAST(floor(pos) AS BIGINT) + 1] * (1 - (pos - floor(pos))) + v[CAST(ceil(pos) AS BIGINT) + 1] * (pos - floor(pos)) END AS r FROM q)
        SELECT entity, line, n AS n_values, max(CASE WHEN isinf(r) THEN CAST(r AS VARCHAR) ELSE printf('%.4f', r) END) FILTER (p = 0) AS p0,
               max(CASE WHEN isinf(r) THEN CAST(r AS VARCHAR) ELSE printf('%.4f', r) END) FILTER (p = 0.5) AS mid,
               max(CASE WHEN isinf(r) THEN CAST(r AS VARCHAR) ELSE printf('%.4f', r) END) FILTER (p = 1) AS p100 FROM x GROUP BY 1, 2, 3""",
)
def edge_quantiles(spark, d):
    """Quantiles of groups with infinities, NULL values, NULL keys and nothing but NULLs, shown as text."""
    li = pn.table(spark, d, "lineitem")
    line = F.col("l_linenumber")
    inf = float("inf")
    value = F.when(line == 7, F.lit(None)).when((F.col("l_orderkey") % 97 == 0) & (line < 4), F.lit(inf)).when(
        (F.col("l_quantity") < 2) & (line >= 4), F.lit(-inf)).otherwise(F.col("l_extendedprice") / 997)
    rows = li.select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("entity"), line.alias("line"), value.alias("value"))
    q = exact_quantiles(rows, ["entity", "line"], "value", {"p0": 0.0, "mid": 0.5, "p100": 1.0}, with_count=True)
    shown = lambda c: F.when(F.col(c) == inf, "inf").when(F.col(c) == -inf, "-inf").otherwise(F.format_string("%.4f", c)).alias(c)
    return q.select("entity", "line", "n_values", *[F.when(F.col(c).isNotNull(), shown(c)).alias(c) for c in ("p0", "mid", "p100")])


@query(
    "price_interval",
    f"WITH {RAW_DRAWS} SELECT entity, q_idx, {_quantile_list({'lower': 0.05, 'median': 0.5, 'upper': 0.95})}, {r('avg(value)', 'mean')} FROM raw_draws GROUP BY 1, 2",
)
def price_interval(spark, d):
    """Arbitrary quantile pair with median and mean."""
    return dr.interval(price_draws(spark, d), G, 0.05, 0.95)


@query(
    "sampled_paths",
    f"""WITH {pn.DRAWS}, p AS (SELECT DISTINCT entity, origin_q, draw_id FROM draws WHERE model = 'history'),
        c AS (SELECT *, row_number() OVER (PARTITION BY entity, origin_q ORDER BY md5(concat('7:', draw_id)), draw_id) AS k FROM p),
        n AS (SELECT entity, origin_q, draw_id, row_number() OVER (PARTITION BY entity, origin_q ORDER BY draw_id) - 1 AS path FROM c WHERE k <= 5)
        SELECT entity, origin_q, draw_id, horizon, {r('value', 'value')}, CAST(path AS INTEGER) AS path FROM draws JOIN n USING (entity, origin_q, draw_id) WHERE model = 'history'""",
)
def sampled_paths(spark, d):
    """Five whole paths per origin, renumbered."""
    h = pn.draws(spark, d).where("model = 'history'").drop("model")
    return dr.sample_paths(h, ["entity", "origin_q"], 5, 7)


@query(
    "averaged_draws",
    f"""WITH {pn.DRAWS} SELECT entity, origin_q, draw_id, horizon, {r('0.5 * a.value + 0.5 * b.value', 'value')} FROM (SELECT * FROM draws WHERE model = 'history') a
        JOIN (SELECT * FROM draws WHERE model = 'level') b USING (entity, origin_q, draw_id, horizon)""",
)
def averaged_draws(spark, d):
    """Paired average of two draw sets."""
    x = pn.draws(spark, d)
    return dr.combine_draws(x.where("model = 'history'"), x.where("model = 'level'"), ["entity", "origin_q", "draw_id", "horizon"])


@query(
    "recentred_draws",
    f"""WITH {RAW_DRAWS}, m AS (SELECT entity, q_idx, quantile_cont(value, 0.5) AS med, avg(value) AS target FROM raw_draws GROUP BY 1, 2)
        SELECT entity, q_idx, draw_id, {r('value + (target - med)', 'value')} FROM raw_draws JOIN m USING (entity, q_idx)""",
)
def recentred_draws(spark, d):
    """Draws shifted so that each group's median is its mean; the join back is salted by draw."""
    return dr.recenter(price_draws(spark, d), None, G, "target", ["draw_id"])


@query(
    "band_probabilities",
    f"""WITH {RAW_DRAWS} SELECT entity, q_idx, {r('avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END)', 'p_cut')}, {r('avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END)', 'p_hike')},
        {r('1 - avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END)', 'p_hold')} FROM raw_draws GROUP BY 1, 2""",
)
def band_probabilities(spark, d):
    """Shares of draws below, inside and above a band."""
    return dr.band_probabilities(price_draws(spark, d), G, 30, 60)


@query(
    "cumulative_change",
    f"""WITH {pn.DRAWS} SELECT d.entity, d.origin_q, {r('quantile_cont(d.value - p.value, 0.1)', 'low')}, {r('quantile_cont(d.value - p.value, 0.5)', 'mid')}, {r('quantile_cont(d.value - p.value, 0.9)', 'high')}
        FROM draws d JOIN panel p ON p.entity = d.entity AND p.q_idx = d.origin_q WHERE d.horizon = 4 AND d.model = 'history' GROUP BY 1, 2""",
)
def cumulative_change(spark, d):
    """Quantiles of the change from the current level after four quarters."""
    x = pn.draws(spark, d).where("model = 'history'")
    level = pn.order_panel(spark, d).select("entity", F.col("q_idx").alias("origin_q"), F.col("value").alias("now"))
    return dr.cumulative_change_quantiles(
        x, level, ["entity", "origin_q"], 4, {"low": 0.1, "mid": 0.5, "high": 0.9}, "now"
    )


@query(
    "shock_scenario",
    f"""WITH {pn.DRAWS}, h AS (SELECT * FROM draws WHERE model = 'history'), e AS (SELECT entity, origin_q, avg(value) AS expected FROM h WHERE horizon = 1 GROUP BY 1, 2),
        own AS (SELECT entity, origin_q, draw_id, value AS own FROM draws WHERE model = 'level' AND horizon = 1),
        x AS (SELECT h.entity, h.origin_q, h.draw_id, h.horizon, h.value, (270.5 - expected) * (l.value / h.horizon / own) AS c
          FROM h JOIN draws l ON l.model = 'level' AND l.entity = h.entity AND l.origin_q = h.origin_q AND l.draw_id = h.draw_id AND l.horizon = h.horizon
          JOIN own ON own.entity = h.entity AND own.origin_q = h.origin_q AND own.draw_id = h.draw_id JOIN e ON e.entity = h.entity AND e.origin_q = h.origin_q)
        SELECT x.entity, x.origin_q, draw_id, horizon, {r('value', 'value')}, {r('270.5 - expected', 'shock_size')}, {r('c', 'contribution')}, {r('value + c', 'combined')} FROM x JOIN e USING (entity, origin_q)""",
)
def shock_scenario(spark, d):
    """Baseline draws plus surprise times the per-unit response of the same draw."""
    x = pn.draws(spark, d)
    base = x.where("model = 'history'").drop("model")
    ids = ["entity", "origin_q"]
    irf = x.where("model = 'level'").select(
        *ids, "draw_id", (F.col("horizon") - 1).alias("horizon"), F.lit("rate").alias("response"), F.lit("rate").alias("shock"),
        (F.col("value") / F.col("horizon")).alias("value"),
    )
    expected = base.where("horizon = 1").groupBy(*ids).agg(F.avg("value").alias("expected"))
    return dr.scenario(base, irf, expected, ids, "rate", "rate", 270.5)


@query(
    "residual_paths",
    f"""WITH {pn.PRED}, res AS (SELECT entity, origin_q, horizon, error FROM pred WHERE model = 'last_value'),
        med AS (SELECT entity, horizon, median(error) AS m FROM res GROUP BY 1, 2), u AS (SELECT entity, origin_q, row_number() OVER (PARTITION BY entity ORDER BY origin_q) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM (SELECT DISTINCT entity, origin_q FROM res)),
        last AS (SELECT entity, value FROM seq WHERE rn = n), k AS (SELECT DISTINCT entity, n FROM u),
        p AS (SELECT entity, CAST(rep AS INTEGER) AS draw_id, CAST({IDX.format(rep='rep', slot='0')} % n AS BIGINT) AS i FROM k CROSS JOIN range(0, 50) AS a(rep))
        SELECT p.entity, draw_id, origin_q AS source_q, horizon, {r('value + error - m', 'value')} FROM p JOIN u USING (entity, i) JOIN res USING (entity, origin_q) JOIN med USING (entity, horizon) JOIN last ON last.entity = p.entity""",
)
def residual_paths(spark, d):
    """Latest forecast plus resampled, median-centred residual rows of whole origins."""
    p = pn.order_panel(spark, d)
    resid = pn.predictions(spark, d).where("model = 'last_value'").select("entity", "origin_q", "horizon", F.col("error").alias("residual"))
    last = p.groupBy("entity").agg(F.max_by("value", "q_idx").alias("forecast"))
    point = last.select("entity", F.explode(F.array(*[F.lit(h) for h in pn.HORIZONS])).alias("horizon"), "forecast")
    return dr.residual_paths(point, resid, K, pn.HORIZONS, 50, 42)


# Scenario weights and unemployment changes of the example stress test.
SCENARIOS = [
    {"name": "downside", "probability_weight": 0.425, "delta": 2.0},
    {"name": "base", "probability_weight": 0.55, "delta": 0.0},
    {"name": "upside", "probability_weight": 0.025, "delta": -1.0},
]

STRESS = """e AS (SELECT c_custkey, c_mktsegment AS segment, greatest(c_acctbal, 0) AS ead, 0.01 + (c_custkey % 7) / 100.0 AS pd_base,
     CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0.6 ELSE 0.4 END AS sensitivity FROM customer),
   s AS (SELECT * FROM (VALUES ('downside', 0.425, 2.0), ('base', 0.55, 0.0), ('upside', 0.025, -1.0)) AS v(scenario, w, delta)),
   x AS (SELECT e.*, scenario, CAST(w AS DOUBLE) AS w, CAST(delta AS DOUBLE) AS delta, least(1.0, greatest(CAST(pd_base AS DOUBLE), CAST(pd_base AS DOUBLE) + CAST(sensitivity AS DOUBLE) * CAST(delta AS DOUBLE) / 100)) AS p FROM e CROSS JOIN s)"""


def exposures(spark, d):
    c = pn.table(spark, d, "customer")
    dbl = lambda x: F.lit(float(x))
    base = c.select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.greatest("c_acctbal", dbl(0)).alias("ead"),
        (dbl(0.01) + (F.col("c_custkey") % 7) / dbl(100)).alias("pd_base"),
    )
    per_segment = c.select(F.col("c_mktsegment").alias("segment")).distinct().select(
        "segment", dbl(0.45).alias("lgd"), dbl(0.07).alias("discount_rate"),
        F.when(F.col("segment") == "HOUSEHOLD", dbl(0.6)).otherwise(dbl(0.4)).alias("sensitivity"),
    )
    return st.join_assumptions(base, [per_segment])


@query(
    "stressed_exposures",
    f"""WITH {STRESS} SELECT c_custkey, segment, scenario, {r('w', 'probability_weight')}, {r('delta', 'delta')}, {r('p', 'pd_stressed')}, {r('p * 0.45 * ead / 1.07', 'expected_loss')} FROM x""",
)
def stressed_exposures(spark, d):
    """Stressed default rate and expected loss per customer and scenario."""
    return st.credit_stress(exposures(spark, d), SCENARIOS).select(
        "c_custkey", "segment", "scenario", "probability_weight", "delta", "pd_stressed", "expected_loss"
    )


@query(
    "segment_expected_loss",
    f"WITH {STRESS} SELECT segment, {r('sum(w * p * 0.45 * ead / 1.07)', 'weighted_expected_loss', 4)} FROM x GROUP BY 1", digits=4,
)
def segment_expected_loss(spark, d):
    """Probability-weighted expected loss per segment."""
    return st.segment_totals(st.credit_stress(exposures(spark, d), SCENARIOS), ["segment"])
