import math

import numpy as np
import pytest
from conftest import q, rows
from pyspark.sql import functions as F

from panelcast.functions import stats
from panelcast.operators import backtest as bt
from panelcast.operators import bootstrap as bs
from panelcast.operators import intervals as iv

K = ["k"]


def panel(spark, values, start="2020Q1", extra=None):
    data = [("e", q(start) + i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, q_idx int, y double")


def test_walk_forward_grid(spark):
    out = bt.walk_forward(panel(spark, range(1, 13)), K, "y", 5, [1, 3])
    got = rows(out, "origin_q", "horizon", "target_q", "actual")
    assert len(got) == 10
    assert {g[0] for g in got} == {q(x) for x in ("2021Q1", "2021Q2", "2021Q3", "2021Q4", "2022Q1")}
    assert (q("2021Q1"), 1, q("2021Q2"), 6.0) in got and (q("2021Q1"), 3, q("2021Q4"), 8.0) in got


def test_origin_blocks_are_disjoint(spark):
    df = panel(spark, range(25)).withColumn("x", F.col("y"))
    grid = lambda **kw: {r[0] for r in bt.walk_forward(df, K, "y", 10, [1], exog=["x"], **kw).select("origin_q").collect()}
    first, rest = grid(max_origins=5), grid(skip_origins=5)
    assert len(first) == 5 and not first & rest and max(first) < min(rest)
    short = df.withColumn("x", F.when(F.col("q_idx") > q("2020Q4"), F.col("x")))
    late = {r[0] for r in bt.walk_forward(short, K, "y", 10, [1], exog=["x"]).select("origin_q").collect()}
    assert min(late) == q("2020Q1") + 13  # four incomplete rows delay the first origin by four quarters


def test_seasonal_naive_repeats_last_cycle(spark):
    df = panel(spark, [2, 3, 4, 5, 6] + [0] * 6)
    out = bt.walk_forward(df, K, "y", 5, [1, 2, 3, 4, 5, 6], {"n": bt.seasonal_naive("y", K)})
    assert [r[0] for r in out.orderBy("horizon").select("forecast").collect()] == [3, 4, 5, 6, 3, 4]


@pytest.mark.parametrize("kind", ["expression", "group"])
def test_no_lookahead(spark, kind):
    base = [3.0, 1.0, 4.0, 1.5, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0, 9.0, 7.0]
    changed = base[:9] + [100.0] * 5

    def run(values):
        df = panel(spark, values)
        if kind == "expression":
            out = bt.walk_forward(df, K, "y", 6, [1, 2], {
                "naive": bt.seasonal_naive("y", K), "mean": bt.long_run_mean("y", K), "drift": bt.drift("y", K)})
        else:
            out = bt.walk_forward_groups(df, K, "y", 6, [1, 2], lambda h, s: np.full(s, h.mean()), "mean")
        known = q("2020Q1") + 8
        return rows(out.where(F.col("origin_q") <= known), "model", "origin_q", "horizon", "forecast")

    assert run(base) == run(changed)


def test_group_forecaster_equals_expression(spark):
    df = panel(spark, [3.0, 1.0, 4.0, 1.5, 5.0, 9.0, 2.0, 6.0])
    a = bt.walk_forward(df, K, "y", 4, [1, 2], {"m": bt.long_run_mean("y", K)})
    b = bt.walk_forward_groups(df, K, "y", 4, [1, 2], lambda h, s: np.full(s, h.mean()), "m")
    key = lambda x: [(o, h, round(f, 9), round(e, 9)) for o, h, f, e in rows(x, "origin_q", "horizon", "forecast", "error")]
    assert key(a) == key(b)


def preds(spark, data):
    cols = "k string, model string, origin_q int, target_q int, horizon int, actual double, forecast double, error double"
    return spark.createDataFrame([("e", m, o, o + h, h, 0.0, -float(e) if e is not None else None, float(e) if e is not None else None) for m, o, h, e in data], cols)


def test_metric_table(spark):
    p = preds(spark, [("a", 1, 1, 1), ("a", 1, 2, -3), ("b", 1, 1, 2), ("b", 1, 2, -4)])
    t = {(r.model, r.horizon): (r.n, r.rmse, r.mae) for r in bt.metric_table(p, K).collect()}
    assert t["a", None] == (2, pytest.approx(math.sqrt(5)), 2.0)
    assert t["b", 2] == (1, 4.0, 4.0)


@pytest.mark.parametrize("keys", [K, []])
def test_common_grid_counts_models_among_complete_rows(spark, keys):
    p = preds(spark, [("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 1, 1, 2), ("b", 2, 1, None), ("c", 1, 1, None)])
    assert rows(bt.common_grid(p, keys), "model", "origin_q") == [("a", 1), ("b", 1)]


def test_model_comparison_best_and_ties(spark):
    errors = {"sarima": (1, 2), "elastic_net": (0.5, 1), "ensemble": (0.25, 1.5), "naive": (3, 4)}
    data = [(m, o, h, e[h - 1]) for m, e in errors.items() for o in (1, 2) for h in (1, 2)]
    order = ["sarima", "elastic_net", "ensemble", "naive"]
    t = bt.model_comparison([preds(spark, data)], K, [1, 2], order)
    best = {r.horizon: r.best_model for r in t.collect()}
    assert best == {1: "ensemble", 2: "elastic_net", None: "elastic_net"}
    meta = {(r.forecast_origin_n, r.evaluated_horizons) for r in t.collect()}
    assert meta == {(2, "1-2")}
    tie = preds(spark, [(m, 1, 1, 1.0) for m in ("z", "sarima")])
    assert {r.best_model for r in bt.model_comparison([tie], K, [1], ["z", "sarima"]).collect()} == {"z"}


def test_horizon_labels(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([3],), ([1, 3],), ([],)], "h array<int>")
    assert [r[0] for r in df.select(bt.horizon_label(F.col("h"))).collect()] == ["1-3", "3", "1,3", "none"]


def test_best_weight_matches_grid_search(spark):
    rng = np.random.default_rng(3)
    data = []
    for o in range(30):
        actual = rng.normal()
        for m, f in (("a", actual + rng.normal()), ("b", actual + 0.7 * rng.normal())):
            data.append(("e", m, o, o + 2, 2, actual, f, actual - f))
    cols = "k string, model string, origin_q int, target_q int, horizon int, actual double, forecast double, error double"
    p = spark.createDataFrame([tuple(map(lambda x: float(x) if isinstance(x, np.floating) else x, r)) for r in data], cols)
    wide = {(r[2], r[1]): (r[5], r[6]) for r in data}
    grid = np.linspace(0, 1, 101)

    def brute(origins):
        sse = [sum((w * wide[o, "a"][1] + (1 - w) * wide[o, "b"][1] - wide[o, "a"][0]) ** 2 for o in origins) for w in grid]
        return grid[int(np.argmin(sse))]

    assert bt.best_weight_hindsight(p, K, "a", "b").first()["weight"] == pytest.approx(brute(range(30)))
    for r in bt.best_weight_real_time(p, K, "a", "b").collect():
        past = [o for o in range(30) if o + 2 <= r.origin_q]
        assert len(past) >= 8 and r.n == len(past)
        assert r.weight == pytest.approx(brute(past))


def intervals(spark, data):
    cols = "k string, model string, origin_q int, target_q int, horizon int, actual double, point_forecast double, interval_lower double, interval_upper double, hit boolean, interval_width double, nonconformity_score double"
    return spark.createDataFrame(data, cols)


def scored(spark, items):
    """(model, origin, horizon, score) with placeholder bounds."""
    return intervals(spark, [("e", m, o, o + h, h, 0.0, 0.0, -1.0, 1.0, True, 2.0, float(s)) for m, o, h, s in items])


def test_interval_scores(spark):
    d = spark.createDataFrame([("e", "m", 1, 1, v) for v in (9.0, 10.0, 11.0, 12.0, 13.0, 14.0)], "k string, model string, origin_q int, horizon int, value double")
    a = spark.createDataFrame([("e", 2, 8.0)], "k string, target_q int, actual double")
    for bounded in (True, False):
        r = iv.score_intervals(d, a, K, 0.1, 0.9, bounded=bounded).first()
        lo, mid, hi = np.percentile([9, 10, 11, 12, 13, 14], [10, 50, 90])
        assert (r.interval_lower, r.point_forecast, r.interval_upper) == pytest.approx((lo, mid, hi))
        assert not r.hit and r.nonconformity_score == pytest.approx((mid - 8) / (mid - lo)) and r.nonconformity_score > 1
    flat = d.withColumn("value", F.lit(5.0))
    assert math.isinf(iv.score_intervals(flat, a, K).first().nonconformity_score)
    same = a.withColumn("actual", F.lit(5.0))
    assert iv.score_intervals(flat, same, K).first().nonconformity_score == 0.0


def test_future_score_does_not_raise_an_earlier_factor(spark):
    o = q("2018Q1")
    known = [("m", o + i, 1, 0.5) for i in range(10)]
    huge = [("m", q("2020Q4"), 1, 50.0)]
    f = iv.rolling_factors(scored(spark, known + huge), K, 0.8)
    assert {r.scale_factor for r in f.where(F.col("origin_q") == q("2020Q4")).collect()} == {1.0}


def test_factor_window_and_minimum(spark):
    old = [("m", q("2018Q1") + i, 1, 9.0) for i in range(8)]
    recent = [("m", q("2020Q1") + i, 1, 0.3) for i in range(8)]
    data = scored(spark, old + recent + [("m", q("2021Q4"), 2, 0.3)])
    at = lambda w: {r.scale_factor for r in iv.rolling_factors(data, K, 0.8, w, 2).where(F.col("origin_q") == q("2021Q4")).collect()}
    assert at(4) == {1.0}
    assert min(at(None)) > 1
    assert all(r.scale_factor >= 1 for r in iv.rolling_factors(data, K, 0.8, 4, 2).collect())
    few = scored(spark, [("m", q("2020Q1"), 1, 3.0), ("m", q("2020Q2"), 1, 3.0)])
    assert iv.rolling_factors(few, K, 0.8, 12, 5).count() == 0


def test_rolling_factors_match_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    items = [(m, 100 + o, h, float(rng.exponential(2)) if rng.random() > 0.1 else math.inf) for m in "ab" for o in range(30) for h in (1, 2, 3)]
    got = {(r.model, r.origin_q, r.horizon): (r.calibration_n, r.scale_factor) for r in iv.rolling_factors(scored(spark, items), K, 0.8).collect()}
    want = {}
    for m, o, h, _ in items:
        known = sorted(s for mm, oo, hh, s in items if mm == m and o - 12 < oo + hh <= o and math.isfinite(s))
        if len(known) >= 8:
            rank = min(len(known), math.ceil((len(known) + 1) * 0.8))
            want[m, o, h] = (len(known), max(1.0, known[rank - 1]))
    assert got == want


def test_current_factor(spark):
    s = scored(spark, [("m", 1, 1, 1.0), ("m", 1, 2, 1.0), ("m", 2, 1, 3.0), ("m", 2, 2, 3.0)])
    f = iv.current_factors(s, K, 0.8, 12, 1)
    assert rows(f, "horizon", "calibration_n", "scale_factor") == [(1, 4, 3.0), (2, 4, 3.0)]


def test_apply_factors(spark):
    o1, o2 = q("2020Q1"), q("2020Q2")
    data = intervals(spark, [("e", "m", o, o + 1, 1, 12.0, 10.0, 9.0, 11.0, False, 2.0, 2.0) for o in (o1, o2)])
    f = spark.createDataFrame([("e", "m", o2, 1, 3.0)], "k string, model string, origin_q int, horizon int, scale_factor double")
    out = rows(iv.apply_factors(data, f, K), "origin_q", "interval_lower", "interval_upper", "hit", "interval_width", "interval_calibrated")
    assert out == [(o1, 9.0, 11.0, False, 2.0, False), (o2, 7.0, 13.0, True, 6.0, True)]
    skewed = data.withColumns({"interval_lower": F.lit(8.0), "interval_upper": F.lit(13.0)})
    one = f.drop("origin_q").withColumn("scale_factor", F.lit(1.0))
    assert rows(iv.apply_factors(skewed, one, K), "interval_lower", "interval_upper")[0] == (8.0, 13.0)
    with pytest.raises(ValueError):
        iv.apply_factors(skewed, one.union(one), K)
    bad = one.withColumn("scale_factor", F.lit(-1.0))
    assert rows(iv.apply_factors(skewed, bad, K), "interval_calibrated")[0] == (False,)


def test_coverage_exact(spark):
    hits = [True, False, False, False]
    data = intervals(spark, [("e", "a", i, i + h, h, 0.0, 0.0, 0.0, 0.0, hits[i], w, 0.0) for i, (h, w) in enumerate([(1, 1.0), (1, 3.0), (2, 5.0), (2, 7.0)])])
    t = {r.horizon: r for r in iv.coverage_table(data, K).collect()}
    assert (t[None].n, t[None].empirical_coverage, t[None].mean_interval_width) == (4, 0.25, 4.0)
    assert (t[1].empirical_coverage, t[1].mean_interval_width) == (0.5, 2.0)
    miss = data.withColumn("hit", F.lit(False))
    r = iv.coverage_table(miss, K, 0.25, 0.75).where("grain = 'overall'").first()
    assert r.coverage_ci_lower == 0.0
    assert r.coverage_ci_upper == pytest.approx(1 - 0.025 ** 0.25)
    assert r.binom_p_value == pytest.approx(0.125) and not r.significantly_miscalibrated


def test_binomial_p_against_enumeration():
    for n in (1, 5, 12, 30):
        for p in (0.1, 0.5, 0.8):
            pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            for k in range(n + 1):
                want = min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))
                assert stats.binom_two_sided(k, n, p) == pytest.approx(want, abs=1e-9)


def test_held_out_share(spark):
    items = [("m", 100 + o, 1, 0.5) for o in range(10)]
    t = iv.heldout_comparison(scored(spark, items), K, 0.7, tests=False)
    assert {r.grain: r.validation_n for r in t.collect()} == {"overall": 3, "horizon": 3}
    two = scored(spark, items[:2])
    assert {r.validation_n for r in iv.heldout_comparison(two, K, 0.99, tests=False).collect()} == {1}


def test_serving_only_for_the_validated_pair(spark):
    fc = spark.createDataFrame([("e", "m", 1, 10.0, 9.0, 12.0)], "k string, model string, horizon int, forecast double, interval_lower double, interval_upper double")
    fac = spark.createDataFrame([("e", "m", 1, 2.0, 0.9 - 0.1)], "k string, model string, horizon int, scale_factor double, target_coverage double")
    cov = spark.createDataFrame([("e", "m", 1, 0.9 - 0.1, 0.75, 40)], "k string, model string, horizon int, target_coverage double, calibrated_empirical_coverage double, validation_n bigint")
    cols = ("interval_lower", "interval_upper", "empirical_coverage", "coverage_n")
    assert rows(iv.serve_intervals(fc, fac, cov, K, 0.1, 0.9), *cols) == [(8.0, 14.0, 0.75, 40)]
    assert rows(iv.serve_intervals(fc, fac, cov, K, 0.05, 0.95), *cols) == [(9.0, 12.0, None, None)]
    other = fac.withColumn("target_coverage", F.lit(0.5))
    assert rows(iv.serve_intervals(fc, other, cov, K, 0.1, 0.9), *cols)[0][:2] == (9.0, 12.0)


def test_bootstrap_matches_plain_resampling(spark):
    import hashlib

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(12, 2)), rng.normal(size=(12, 2))
    data = [(m, o, h, float(e[o, h - 1])) for m, e in (("a", a), ("b", b)) for o in range(12) for h in (1, 2)]
    r = bs.bootstrap_gap(preds(spark, data), K, "a", "b", 60, 7).first()
    sa, sb = (a**2).sum(1), (b**2).sum(1)
    gaps = []
    for rep in range(60):
        idx = [int(hashlib.md5(f"7:{rep}:{s}".encode()).hexdigest()[:8], 16) % 12 for s in range(12)]
        gaps.append(math.sqrt(sa[idx].sum() / 24) - math.sqrt(sb[idx].sum() / 24))
    assert r.gap == pytest.approx(math.sqrt(sa.mean() / 2) - math.sqrt(sb.mean() / 2))
    assert (r.ci_lower, r.ci_upper) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])))


def test_report_orders(spark):
    p = preds(spark, [(m, 1, h, 1.0) for m in ("b", "a") for h in (2, 1)])
    t = bt.metric_table(p, K)
    listed = lambda df: [(r.model, r.horizon) for r in df.collect()]
    assert listed(bt.order_by_model(t, K)) == [("a", None), ("a", 1), ("a", 2), ("b", None), ("b", 1), ("b", 2)]
    assert listed(bt.report_order(t, K, ["b"])) == [("b", None), ("a", None), ("b", 1), ("a", 1), ("b", 2), ("a", 2)]
