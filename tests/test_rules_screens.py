import math

import numpy as np
import pytest
from conftest import q, rows
from pyspark.sql import functions as F

from panelcast.functions import stats
from panelcast.operators import features, pooled, rules, screening

K = ["k"]


def labels(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_sign_and_band_labels(spark):
    assert labels(spark, rules.label_change, [-0.25, -0.0001, 0.0, 0.0001, 0.25, None]) == ["cut", "cut", "hold", "hike", "hike", None]
    assert labels(spark, rules.band_rule, [1.99, 2.0, 2.5, 3.0, 3.01, None]) == ["cut", "hold", "hold", "hold", "hike", "hold"]


def test_fixed_rule(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (-0.4,)], "u double")
    change = rules.implied_change(F.lit(2.5), F.col("u"), F.lit(3.5), F.lit(1.0))
    assert [r[0] for r in df.select(rules.label_change(F.round(change, 12))).collect()] == ["hold", "hike", "cut"]


def test_expanding_rule_has_no_leak(spark):
    def run(last):
        data = [("e", i, 2.0 + 0.1 * i, 0.1, 3.0 if i < 5 else last, 3.0) for i in range(6)]
        df = spark.createDataFrame(data, "k string, q_idx int, h double, u double, rate double, prev double")
        out = rules.fixed_rule(df, K, "h", "u", "rate", "prev", "expanding")
        return rows(out, "q_idx", "r_star")

    assert run(3.0) == run(99.0)


def test_expanding_ols_equals_refits(spark):
    rng = np.random.default_rng(2)
    n = 40
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.3 + 1.2 * x1 - 15 * x2 + rng.normal(size=n)
    df = spark.createDataFrame([("e", i, float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)], "k string, q_idx int, y double, x1 double, x2 double")
    got = {r.q_idx: r for r in rules.expanding_ols(df, K, "y", "x1", "x2", 10).collect()}
    assert sorted(got) == list(range(10, n))
    for t, r in got.items():
        a = np.column_stack([np.ones(t), x1[:t], x2[:t]])
        b, *_ = np.linalg.lstsq(a, y[:t], rcond=None)
        se = math.sqrt(float(((y[:t] - a @ b) ** 2).sum()) / (t - 3))
        assert [r.intercept, r.coef_1, r.coef_2, r.residual_se] == pytest.approx([*b, se], rel=1e-9)
        assert r.predicted_change == pytest.approx(b[0] + b[1] * x1[t] + b[2] * x2[t])
        assert r.unstable_coefficients == "coef_2"


def test_normal_probabilities(spark):
    df = spark.createDataFrame([(0.0, 0.125), (5.0, 0.1)], "m double, s double")
    r = rules.normal_band_probs(df, "m", "s").collect()
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert [r[0].p_cut, r[0].p_hold, r[0].p_hike] == pytest.approx([cdf(-1), cdf(1) - cdf(-1), 1 - cdf(1)])
    assert r[1].p_hike == pytest.approx(1.0)


def test_normal_probabilities_without_spread_are_missing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, None), (4, 0.0, 0.125)], "i int, m double, s double")
    r = rules.normal_band_probs(df, "m", "s").orderBy("i").collect()
    assert [(x.p_cut, x.p_hold, x.p_hike) for x in r[:3]] == [(None, None, None)] * 3
    assert r[3].p_cut + r[3].p_hold + r[3].p_hike == pytest.approx(1.0)


def test_estimated_rule_of_a_constant_rate(spark):
    """A rate that never changes leaves no residual; the rows stay and have no probabilities."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("e", i, 0.0, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(14, 2)))], "k string, q_idx int, y double, x1 double, x2 double")
    out = rules.normal_band_probs(rules.expanding_ols(df, K, "y", "x1", "x2", 8), "predicted_change", "residual_se").collect()
    assert sorted(r.q_idx for r in out) == list(range(8, 14))
    assert {(r.predicted_change, r.residual_se, r.predicted_action, r.p_cut, r.p_hold, r.p_hike) for r in out} == {(0.0, 0.0, "hold", None, None, None)}


def test_majority_vote(spark):
    data = [("cut", "cut", "hold", "cut"), ("hike", "hold", "hold", "hike"), ("hold", "hold", "cut", "hike"), ("cut", "hike", "hike", "cut")]
    df = spark.createDataFrame(data, "band string, fixed string, logit string, probit string")
    voters = ["band", "fixed", "logit", "probit"]
    out = rules.majority_vote(df, voters, "band").collect()
    assert [(r.predicted_action, r.tie_break) for r in out] == [("cut", False), ("hike", True), ("hold", False), ("cut", True)]
    with pytest.raises(ValueError):
        rules.majority_vote(df, voters[:3], "band", voters)
    rules.assert_votes(df, voters)
    with pytest.raises(ValueError):
        rules.assert_votes(df.withColumn("fixed", F.lit("raise")), voters)


def test_ordinal_combine(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.8, 0.3), (0.4, 0.9)], "a double, b double")
    out = rules.ordinal_combine(df, "a", "b").collect()
    assert [r.predicted_action for r in out] == ["cut", "hold", "cut"]
    assert all(r.p_cut + r.p_hold + r.p_hike == pytest.approx(1) for r in out)


def test_confidence_flags(spark):
    df = spark.createDataFrame(
        [("m", 1, "hike", 0.2, 0.2, 0.6, 0.6), ("m", 2, "cut", 0.2, 0.2, 0.5, 0.2), ("m", 3, "hold", 0.1, 0.8, 0.1, 0.5)],
        "model string, target_q int, predicted_action string, p_cut double, p_hold double, p_hike double, c double",
    )
    out = rows(rules.confidence_table(df, [], ["m"], "c"), "target_q", "confidence", "consistent")
    assert out == [(1, 0.6, True), (2, 0.2, False), (3, 0.8, False)]


AUDIT = ["hike", "hold", "cut", "cut", "hold", "hike"]


def test_split_audit_and_choice(spark):
    df = spark.createDataFrame([("e", q("2020Q1") + i, a) for i, a in enumerate(AUDIT)], "k string, q_idx int, a string")
    audit = rules.split_audit(df, K, "a", [1, 2, 3, 10])
    got = {r.initial_size: (r.degenerate_classes, r.degenerate_binary_problems, r.test_rows) for r in audit.collect()}
    assert got[1] == ("cut, hold", "Y>cut, Y>hold", 5)
    assert got[2] == ("cut", "Y>cut", 4)
    assert got[3] == ("none", "none", 3)
    assert got[10][0] == "invalid_no_test_rows"
    chosen = rules.choose_split(audit, K, 1)
    assert rows(chosen, "chosen_size", "test_rows") == [(3, 3)]
    with pytest.raises(ValueError):
        rules.assert_split(rules.choose_split(audit, K, 4))
    kept = {r.initial_size: r.is_chosen for r in rules.condensed_audit(audit, K, chosen).collect()}
    assert kept == {1: False, 2: False, 3: True, 10: False}


def test_confusion_and_metrics(spark):
    actual = ["cut", "cut", "hold", "hold", "hike", "hike"]
    pred = ["cut", "hold", "hold", "hold", "hold", "hike"]
    df = spark.createDataFrame([("m", a, p) for a, p in zip(actual, pred)], "model string, actual_action string, predicted_action string")
    assert rows(rules.confusion(df, []), "actual", "cut", "hold", "hike") == [("cut", 1, 1, 0), ("hike", 0, 1, 1), ("hold", 0, 2, 0)]
    r = rules.class_metrics(df, []).first()
    assert (r.macro_f1, r.accuracy, r.n) == (pytest.approx(2 / 3), pytest.approx(4 / 6), 6)
    two = df.where("actual_action <> 'hike' and predicted_action <> 'hike'")
    f1 = [2 / 3, 2 * 2 / (2 * 2 + 1), 0.0]
    assert rules.class_metrics(two, []).first().macro_f1 == pytest.approx(sum(f1) / 3)
    assert rules.class_counts(two, [], "actual_action").first().hike == 0


def make_panel(spark, n=60, entities=("a", "b"), seed=4):
    rng = np.random.default_rng(seed)
    data = []
    for e in entities:
        x, z = rng.normal(size=n).cumsum() * 0.3, rng.normal(size=n)
        y = np.zeros(n)
        for t in range(2, n):
            y[t] = 0.4 * y[t - 1] + 0.8 * z[t - 1] + 0.3 * rng.normal()
        data += [(e, t, float(y[t]), float(x[t]), float(z[t])) for t in range(n)]
    return spark.createDataFrame(data, "k string, q_idx int, y double, x double, z double"), data


def arrays(data, e):
    a = np.array([r[2:] for r in data if r[0] == e])
    return a[:, 0], a[:, 1], a[:, 2]


def test_lag_correlation_prefers_the_stored_lag(spark):
    df = spark.createDataFrame(
        [(0, 10.0, None, 5.0), (1, 20.0, 1.0, 15.0), (2, 30.0, 2.0, 25.0), (3, 40.0, 3.0, 35.0), (4, 50.0, 4.0, 45.0)],
        "q_idx int, t double, a_lag1 double, b double",
    )
    out = {r.source_variable: r for r in screening.lag_correlation(df, [], "t", ["a", "b", "gone"]).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].correlation == pytest.approx(1.0) and "existing" in out["a"].notes
    assert out["b"].observations == 4 and "derived" in out["b"].notes
    few = screening.lag_correlation(df.limit(3), [], "t", ["b"]).first()
    assert few.observations == 2 and few.correlation is None


def test_lead_lag_and_best(spark):
    df, data = make_panel(spark)
    ccf = screening.lead_lag(df, K, "y", ["x", "z"])
    got = {(r.k, r.variable, r.lag): (r.correlation, r.n_obs) for r in ccf.collect()}
    for e in "ab":
        y, x, z = arrays(data, e)
        for name, s in (("x", x), ("z", z)):
            for lag in range(-4, 5):
                a, b = (y[lag:], s[: len(s) - lag]) if lag >= 0 else (y[:lag], s[-lag:])
                assert got[e, name, lag] == (pytest.approx(np.corrcoef(a, b)[0, 1]), len(a))
    best = {(r.k, r.variable): r.lag for r in screening.best_lag(ccf, K).collect()}
    assert best["a", "z"] == 1
    short = screening.lead_lag(df.where("q_idx < 11"), K, "y", ["x"])
    assert short.where("correlation is not null").count() == 0


def test_vif_against_numpy(spark):
    df, data = make_panel(spark)
    cols = ["y", "x", "z"]
    for centered in (True, False):
        got = {(r.k, r.variable): r.vif for r in screening.vif(df, K, cols, centered).collect()}
        for e in "ab":
            m = np.column_stack(arrays(data, e))
            for i, c in enumerate(cols):
                others = np.delete(m, i, 1)
                a = np.column_stack([np.ones(len(m)), others]) if centered else others
                res = m[:, i] - a @ np.linalg.lstsq(a, m[:, i], rcond=None)[0]
                total = ((m[:, i] - m[:, i].mean()) ** 2).sum() if centered else (m[:, i] ** 2).sum()
                assert got[e, c] == pytest.approx(total / (res**2).sum())
    one = screening.vif(df, K, ["x"]).first()
    assert one.vif is None and one.notes == "insufficient rows or variables"


def test_grouped_ols_against_numpy(spark):
    df, data = make_panel(spark)
    for r in screening.grouped_ols(df, K, "y", ["x", "z"]).collect():
        y, x, z = arrays(data, r.k)
        a = np.column_stack([np.ones(len(y)), x, z])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        sse = float(((y - a @ b) ** 2).sum())
        assert [r.intercept, *r.coefficients, r.sse] == pytest.approx([*b, sse])
        n = len(y)
        assert r.bic == pytest.approx(n * (math.log(2 * math.pi) + math.log(sse / n) + 1) + 3 * math.log(n))


def granger_loop(y, x, limit=4):
    """Plain refits of every sub-model."""
    top = min(limit, max(1, len(y) // 10))
    t = np.arange(top, len(y))
    yy = y[t]

    def sse(p, q_):
        a = np.column_stack([np.ones(len(t)), *[y[t - i] for i in range(1, p + 1)], *[x[t - i] for i in range(1, q_ + 1)]])
        r = yy - a @ np.linalg.lstsq(a, yy, rcond=None)[0]
        return float(r @ r), a.shape[1]

    n = len(t)
    bic = {(p, q_): n * math.log(sse(p, q_)[0] / n) + sse(p, q_)[1] * math.log(n) for p in range(1, top + 1) for q_ in range(1, top + 1)}
    p, best = min(bic, key=bic.get)
    base, _ = sse(p, 0)
    out = {}
    for q_ in range(1, top + 1):
        s, k = sse(p, q_)
        f = ((base - s) / q_) / (s / (n - k))
        out[q_] = (f, q_, n - k, q_ == best)
    return p, out, n


@pytest.mark.parametrize("n", [60, 26])
def test_granger_screen_against_refits(spark, n):
    df, data = make_panel(spark, n)
    got = {(r.k, r.variable, r.lag): r for r in screening.granger_screen(df, K, "y", ["x", "z"]).collect()}
    for e in "ab":
        y, x, z = arrays(data, e)
        for name, s in (("x", x), ("z", z)):
            p, want, rows_used = granger_loop(y, s)
            for lag, (f, d1, d2, chosen) in want.items():
                r = got[e, name, lag]
                assert (r.own_lags, r.n_obs, r.bic_selected) == (p, rows_used, chosen)
                assert r.p_value == pytest.approx(stats.f_upper_tail(f, d1, d2), rel=1e-6, abs=1e-12)
    assert got["a", "z", 1].p_value < 0.01
    assert screening.granger_screen(df.where("q_idx < 20"), K, "y", ["x"]).count() == 0


def test_f_tail_known_values():
    # for one numerator degree the F tail is the two-sided t tail; t(1) is Cauchy
    for f in (0.5, 1.0, 9.0):
        assert stats.f_upper_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), abs=1e-12)
    # with two and two degrees the tail is 1 / (1 + f)
    assert stats.f_upper_tail(3.0, 2, 2) == pytest.approx(0.25)


def test_sign_changes(spark):
    vals = [0.5, -0.1, 0.3, 0.0, 0.1, -0.6, 0.15, 0.4]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(vals)], "k string, q_idx int, rolling_corr double")
    assert rows(screening.sign_changes(df, K), "raw_sign_changes", "strong_sign_changes") == [(4, 2)]


def test_candidate_status(spark):
    cols = "variable string, feature string, feature_lag int, has_lag_feature boolean, origin_safe boolean, vif double, late_start boolean, substantial_missingness boolean, abs_corr double, candidate_p double"
    df = spark.createDataFrame(
        [
            ("a", "a_lag1", 1, True, True, 2.0, False, False, 0.5, 0.5), ("b", "b_lag1", 1, True, True, 20.0, False, False, 0.5, 0.5),
            ("c", None, None, False, None, None, False, False, None, None), ("d", "d_lag1", 1, True, True, 2.0, False, False, 0.1, 0.5),
            ("e", "e_lag1", 1, True, True, 2.0, False, False, 0.1, 0.08), ("f", "f_lag1", 1, True, False, 2.0, True, False, 0.5, 0.01),
        ],
        cols,
    )
    got = {r.variable: r.screening_status for r in screening.classify_candidates(df).collect()}
    assert got == {"a": "strong candidate", "b": "optional/shorter-sample candidate", "c": "exclude", "d": "optional", "e": "candidate", "f": "exclude"}


def test_elastic_net_is_optimal_and_matches_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, data = make_panel(spark)
    frame = pooled.direct_frame(df, K, "y", ["x", "z"], [1])
    r = pooled.fit_direct(frame, ["x", "z"], 0.05, 0.5).first()
    pdf = frame.toPandas()
    sd = pdf[["x", "z"]].std(ddof=0).to_numpy()

    def loss(b0, w):
        e = pdf["y"] - b0 - pdf[["x", "z"]].to_numpy() @ w
        s = w * sd
        return 0.5 * float((e**2).mean()) + 0.05 * (0.5 * np.abs(s).sum() + 0.25 * (s**2).sum())

    best = loss(r.intercept, np.array(r.coefficients))
    rng = np.random.default_rng(0)
    for _ in range(200):
        assert best <= loss(r.intercept + 0.01 * rng.normal(), np.array(r.coefficients) + 0.01 * rng.normal(size=2)) + 1e-12
    # without a penalty both agree with ordinary least squares
    ml = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(frame))
    o = pooled.fit_direct(frame, ["x", "z"], 0.0, 0.5).first()
    assert [o.intercept, *o.coefficients] == pytest.approx([ml.intercept, *ml.coefficients], rel=1e-6)


def test_tuning_equals_refits_on_raw_rows(spark):
    df, data = make_panel(spark, 30)
    frame = pooled.with_time_folds(pooled.direct_frame(df, K, "y", ["x", "z"], [2]), 3)
    alphas, ratios = (0.01, 0.3), (0.5, 1.0)
    fits = {r.fold: r for r in pooled.tune_direct(frame, ["x", "z"], alphas, ratios, 3).collect()}
    pdf = frame.toPandas()

    def fit(rows_, a, l1):
        m = rows_[["y", "x", "z"]].to_numpy()
        return pooled.elastic_net(m.mean(0), np.cov(m.T, ddof=0), a, l1)[:2]

    scores = {}
    for a in alphas:
        for l1 in ratios:
            mses = []
            for i in (1, 2, 3):
                b0, w = fit(pdf[pdf.fold < i], a, l1)
                t = pdf[pdf.fold == i]
                mses.append(float(((t.y - b0 - t[["x", "z"]].to_numpy() @ w) ** 2).mean()))
            scores[a, l1] = np.mean(mses)
    best = min(scores, key=scores.get)
    assert (fits[0].alpha, fits[0].l1_ratio) == best and fits[0].cv_mse == pytest.approx(scores[best])
    b0, w = fit(pdf, *best)
    assert [fits[0].intercept, *fits[0].coefficients] == pytest.approx([b0, *w])
    fits_df = pooled.tune_direct(frame, ["x", "z"], alphas, ratios, 3)
    res = pooled.oof_residuals(frame, fits_df, K, ["x", "z"]).toPandas()
    assert len(res) == (pdf.fold > 0).sum() and set(res.fold) == {1, 2, 3}
    latest = pooled.predict_latest(df, fits_df, K, ["x", "z"], [2]).collect()
    assert {(r.k, r.horizon, r.origin_q) for r in latest} == {("a", 2, 29), ("b", 2, 29)}


def test_folds_never_train_on_later_quarters(spark):
    a, _ = make_panel(spark, 30, ("a",))
    b = a.where("q_idx >= 15").withColumn("k", F.lit("b"))  # starts late
    frame = pooled.with_time_folds(pooled.direct_frame(a.union(b), K, "y", ["x"], [1]), 4).toPandas()
    for i in range(1, 5):
        assert frame[frame.fold < i].q_idx.max() < frame[frame.fold == i].q_idx.min()


def test_ordinal_pair(spark):
    rng = np.random.default_rng(0)
    v = rng.uniform(-1, 1, size=300)
    data = [(i, float(x), "cut" if x < -0.3 else "hike" if x > 0.3 else "hold") for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "q_idx int, x double, a string")
    models = pooled.fit_ordinal_pair(df, ["x"], "a", trees=8, step=0.5, subsample=1.0)
    out = pooled.predict_ordinal_pair(models, df)
    assert out.where("predicted_action = a").count() > 280
    with pytest.raises(ValueError):
        pooled.fit_ordinal_pair(df.where("a <> 'cut'"), ["x"], "a")
    assert features.present(df, ["x", "nope"]) == ["x"]


def test_ordinal_pair_has_no_lookahead(spark):
    rng = np.random.default_rng(1)
    name = lambda x: "cut" if x < -0.3 else "hike" if x > 0.3 else "hold"
    data = [(k, i, float(x), name(x)) for k in ("a", "b") for i, x in enumerate(rng.uniform(-1, 1, size=60))]
    turned = [(k, i, x, a if i < 20 else name(-x)) for k, i, x, a in data]  # from the first scored block on
    score = lambda rows: {
        (r.k, r.q_idx): (r.p_cut, r.p_hold, r.p_hike)
        for r in pooled.walk_forward_ordinal_pair(spark.createDataFrame(rows, "k string, q_idx int, x double, a string"), ["x"], "a", 2, trees=3, step=0.5, min_weight=1.0).collect()
    }
    one, other = score(data), score(turned)
    assert set(one) == set(other) == {(k, i) for k in ("a", "b") for i in range(20, 60)}
    assert all(one[at] == pytest.approx(other[at], abs=1e-9) for at in one if at[1] < 40)
    assert any(one[at] != pytest.approx(other[at], abs=1e-9) for at in one if at[1] >= 40)
