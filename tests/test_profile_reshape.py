import numpy as np
import pytest
from conftest import q, rows

from panelcast.functions import calendar as cal
from panelcast.operators import align, profile, reshape


def panel(spark, values, start="1995Q1"):
    return spark.createDataFrame([("e", q(start) + i, float(v)) for i, v in enumerate(values)], "k string, q_idx int, v double")


def test_regime_counts(spark):
    bounds = [("before", None, q("2019Q4")), ("surge", q("2020Q1"), q("2023Q4")), ("after", q("2024Q1"), None)]
    out = profile.regime_summary(panel(spark, range(124)), ["k"], bounds, ["v"])
    assert rows(out, "regime", "first_quarter", "last_quarter", "quarters") == [
        ("after", "2024Q1", "2025Q4", 8), ("before", "1995Q1", "2019Q4", 100), ("surge", "2020Q1", "2023Q4", 16)
    ]


def test_annual_mean(spark):
    out = profile.annual_summary(panel(spark, [1, 2, 3, 4, 10]), ["k"], ["v"])
    assert rows(out, "year", "avg_v") == [(1995, 2.5), (1996, 10.0)]


def test_acf_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=30)
    got = {r.lag: r.autocorrelation for r in profile.acf(panel(spark, x), ["k"], "v").collect()}
    c = x - x.mean()
    assert sorted(got) == list(range(1, 15))  # half the length less one
    for lag, v in got.items():
        assert v == pytest.approx(float((c[lag:] * c[:-lag]).sum() / (c @ c)))


def test_decomposition_adds_up(spark):
    y = [10 + t + [1, -2, 3, -2][t % 4] for t in range(16)]
    out = profile.decompose_additive(panel(spark, y), ["k"], "v").orderBy("q_idx").collect()
    assert [r.trend for r in out[:2]] == [None, None] and out[-1].trend is None
    for t, r in enumerate(out):
        assert r.seasonal == pytest.approx([1, -2, 3, -2][t % 4])
        if r.trend is not None:
            assert r.trend == pytest.approx(10 + t) and r.remainder == pytest.approx(0)


def test_coverage_classes(spark):
    df = panel(spark, range(20)).selectExpr(
        "k", "q_idx", "v", f"if(q_idx >= {q('1995Q4')}, v, null) late", f"if(q_idx < {q('1997Q2')}, v, null) short", "if(v < 3, v, null) few"
    )
    got = {r.variable: (r.coverage_class, r.late_start, r.substantial_missingness) for r in profile.coverage_profile(df, ["k"], ["v", "late", "short", "few"]).collect()}
    assert got == {
        "v": ("core_long_sample_candidate", False, False), "late": ("shorter_sample_candidate", True, False),
        "short": ("exclude_low_coverage", False, True), "few": ("exclude_low_coverage", False, True),
    }


def test_level_shift(spark):
    df = panel(spark, [1.0] * 4 + [1.1] * 4, "2017Q1")
    spans = ((q("2017Q1"), q("2018Q4")), (q("2017Q1"), q("2017Q4")), (q("2018Q1"), q("2018Q4")))
    r = profile.level_shift(df, ["k"], "v", *spans).first()
    assert (round(r.max_step, 9), round(r.mean_shift, 9), r.visible_break) == (0.1, 0.1, False)
    assert profile.level_shift(df, ["k"], "v", *spans, threshold=0.05).first().visible_break


def test_tidy_matrices_keep_unreadable_labels(spark):
    f = spark.createDataFrame([("2021-03-01", "a", 2.0, None, 1.0), ("bad", "a", 9.0, 9.0, 9.0)], "forecast_date string, source string, t double, `t+1` double, tx double")
    e = spark.createDataFrame([("2021-03-01", 0.5)], "forecast_date string, `t+2` double")
    out = reshape.tidy_horizon_matrices({"forecast": f, "error": e})
    assert rows(out, "horizon_label", "horizon_quarters", "forecast", "error") == [
        ("t", 0, 2.0, None), ("t+1", 1, None, None), ("t+2", 2, None, 0.5), ("tx", None, 1.0, None)
    ]


def test_horizon_labels(spark):
    df = spark.createDataFrame([("t",), ("t+3",), ("T-1",), (" t + 2 ",), ("t+",), (None,)], "s string")
    assert [r[0] for r in df.select(cal.horizon_label_to_int("s")).collect()] == [0, 3, -1, 2, None, None]


def test_arrays_and_tensor(spark):
    df = spark.createDataFrame([("m", ["2020Q1", "2020Q2"], [1.0, 2.0])], "model string, quarters array<string>, f array<double>")
    out = reshape.explode_arrays(df, ["model"], {"quarters": "quarter", "f": "forecast"})
    assert rows(out, "horizon", "quarter", "forecast") == [(1, "2020Q1", 1.0), (2, "2020Q2", 2.0)]
    t = spark.createDataFrame([([[[1.0, 2.0], [3.0, 4.0]]],)], "t array<array<array<double>>>")
    out = reshape.nested_to_long(t, [], "t", ["y", "x"], ["a", "b"])
    assert rows(out, "horizon", "response", "shock", "value") == [(0, "x", "a", 3.0), (0, "x", "b", 4.0), (0, "y", "a", 1.0), (0, "y", "b", 2.0)]


def test_labelled_sample_refuses_repeated_targets(spark):
    pred = spark.createDataFrame([("m", 1, 5, 2.0)], "model string, horizon int, target_q int, forecast double")
    wide = spark.createDataFrame([(5, 1.0, None), (6, 1.0, 1.0)], "q_idx int, a double, b double")
    assert align.labelled_sample(pred, wide, [], "m", 1, "h", ["a"]).count() == 1
    assert align.labelled_sample(pred, wide, [], "m", 1, "h", ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        align.labelled_sample(pred.union(pred), wide, [], "m", 1, "h", ["a"])
