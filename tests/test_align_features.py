import datetime as dt

import pytest
from conftest import q, rows
from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.functions import numeric as nm
from panelcast.operators import align, features, reshape
from panelcast.sources import series


def test_quarter_arithmetic_wraps_years(spark):
    df = spark.createDataFrame([(dt.date(2019, 12, 31),), (dt.date(2020, 1, 1),)], "d date").select(cal.q_idx("d").alias("i"))
    out = df.select(cal.q_label("i"), cal.q_label(cal.q_add("i", 3)), cal.q_start("i"), cal.q_end("i")).collect()
    assert [tuple(r) for r in out] == [
        ("2019Q4", "2020Q3", dt.date(2019, 10, 1), dt.date(2019, 12, 31)),
        ("2020Q1", "2020Q4", dt.date(2020, 1, 1), dt.date(2020, 3, 31)),
    ]
    labels = spark.createDataFrame([("2020Q4",), ("2020Q5",), (" 1999Q1 ",)], "s string")
    assert [r[0] for r in labels.select(cal.q_from_label("s")).collect()] == [q("2020Q4"), None, q("1999Q1")]


def monthly(spark, values, keys=""):
    data = [(dt.date(2020, m, 1), v) for m, v in values]
    return spark.createDataFrame(data, "date date, v double")


def test_resample_mean_last_sum(spark):
    df = monthly(spark, [(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0)])
    assert rows(align.resample(df, [], "date", "v"), "quarter", "value") == [("2020Q1", 2.0), ("2020Q2", 10.0)]
    gap = monthly(spark, [(1, 1.0), (2, 5.0), (3, None), (4, None)])
    assert rows(align.resample(gap, [], "date", "v", "last"), "quarter", "value") == [("2020Q1", 5.0), ("2020Q2", None)]
    assert rows(align.resample(gap, [], "date", "v", "sum"), "quarter", "value") == [("2020Q1", 6.0), ("2020Q2", 0.0)]
    nan = monthly(spark, [(1, 1.0), (2, float("nan"))])
    assert rows(align.resample(nan, [], "date", "v"), "value") == [(1.0,)]
    with pytest.raises(ValueError):
        align.resample(df, [], "date", "v", "median")


def test_strict_dates_lenient_numbers(spark):
    df = spark.createDataFrame([("2020-01-01", "x"), ("2020-01-02", "2.5")], "d string, v string")
    assert rows(series.typed_series(df, "d", "v"), "v") == [(2.5,), (None,)]
    bad = spark.createDataFrame([("nope", "1")], "d string, v string")
    with pytest.raises(Exception):
        series.typed_series(bad, "d", "v").collect()


def test_merge_keeps_leading_gaps(spark):
    long = spark.createDataFrame(
        [("a", q("2020Q1"), 100.0), ("a", q("2020Q2"), 101.0), ("a", q("2020Q3"), 102.0), ("b", q("2020Q2"), 99.0), ("b", q("2020Q3"), 100.0)],
        "series_id string, q_idx int, value double",
    )
    with pytest.raises(ValueError):
        align.merge_series(long, [], ["a"])
    assert align.merge_series(long, [], ["a"], others=True).columns == ["q_idx", "a", "quarter"]
    out = align.merge_series(long, [], ["a", "b"])
    assert rows(out, "quarter", "a", "b") == [("2020Q1", 100.0, None), ("2020Q2", 101.0, 99.0), ("2020Q3", 102.0, 100.0)]


def test_latest_file_per_series(spark):
    names = ["cpi_qoq_1995_2025", "cpi_qoq_1995_2026", "cpi_qoq_1990_2026", "trimmed_cpi_qoq_1995_2027", "cpi_qoq_metadata"]
    df = spark.createDataFrame([(f"/x/{n}.csv",) for n in names], "path string")
    out = {r.series: r.path for r in series.latest_files(df).collect()}
    assert out["cpi_qoq"] == "/x/cpi_qoq_1990_2026.csv"
    assert out["trimmed_cpi_qoq"] == "/x/trimmed_cpi_qoq_1995_2027.csv"
    assert out["cpi_qoq_metadata"] == "/x/cpi_qoq_metadata.csv"


def test_read_latest_directory(spark, tmp_path):
    for name, v in (("s_2000_2001", 1), ("s_2000_2002", 2), ("other_2000_2001", 3)):
        (tmp_path / f"{name}.csv").write_text(f"date,v\n2000-01-01,{v}\n")
    out = series.read_latest(spark, str(tmp_path), "date date, v double")
    assert rows(out, "series", "v") == [("other", 3.0), ("s", 2.0)]
    with pytest.raises(Exception):
        series.read_series(spark, str(tmp_path / "absent"), "date date").count()


def panel(spark, values, name="v", start="2020Q1"):
    return spark.createDataFrame([("e", q(start) + i, v) for i, v in enumerate(values)], f"k string, q_idx int, {name} double")


def column(df, name):
    return [r[0] for r in df.orderBy("q_idx").select(name).collect()]


def test_growth_change_lag(spark):
    g = features.add_growth(panel(spark, [100.0, 105.0, 94.5, 0.0, 3.0]), ["k"], {"v": "g", "absent": "h"})
    got = column(g, "g")
    assert got[0] is None and got[4] is None
    assert [round(x, 2) for x in got[1:4]] == [5.0, -10.0, -100.0]
    c = column(features.add_change(panel(spark, [0.25, 0.5, 0.1]), ["k"], {"v": "c"}), "c")
    assert c[0] is None and c[1:] == pytest.approx([0.25, -0.4])
    assert column(features.add_lags(panel(spark, [1.0, 1.5, 2.0]), ["k"], {"v": [1]}), "v_lag1") == [None, 1.0, 1.5]


def test_growth_does_not_fill_gaps(spark):
    g = column(features.add_growth(panel(spark, [100.0, None, 110.0]), ["k"], {"v": "g"}), "g")
    assert g == [None, None, None]


def test_positional_and_calendar_lag_differ_on_a_gap(spark):
    df = spark.createDataFrame([("e", 0, 1.0), ("e", 2, 3.0), ("e", 3, 4.0)], "k string, q_idx int, v double")
    assert column(features.add_lags(df, ["k"], {"v": [1]}), "v_lag1") == [None, 1.0, 3.0]
    assert column(features.add_lags(df, ["k"], {"v": [1]}, calendar=True), "v_lag1") == [None, None, 3.0]


def test_nonlinear_terms(spark):
    df = spark.createDataFrame(
        [(0, None, 0.25, 0.2), (1, 2.0, -0.1, 0.3), (2, -3.0, 0.0, -0.4)], "q_idx int, p double, c double, u double"
    )
    out = features.add_interactions(features.add_squares(df, ["p", "absent"]), [("c", "u")])
    assert column(out, "p_sq") == [None, 4.0, 9.0]
    assert column(out, "c_x_u") == pytest.approx([0.05, -0.03, 0.0])


def test_event_dummies_do_not_shift(spark):
    df = spark.createDataFrame([(f"2020Q{i}",) for i in range(1, 5)], "quarter string")
    ev = spark.createDataFrame([("2020Q2", "down", 0), ("2020Q3", "rebound", 1)], "quarter string, dummy_name string, lead_quarters int")
    out = features.add_event_dummies(df, ev, ["quarter"]).orderBy("quarter")
    assert [tuple(r) for r in out.select("down_lag0", "rebound_lag1").collect()] == [(0, 0), (1, 0), (0, 1), (0, 0)]
    bad = ev.union(spark.createDataFrame([("2020Q4", "down", 2)], ev.schema))
    with pytest.raises(ValueError):
        features.add_event_dummies(df, bad, ["quarter"])
    with pytest.raises(ValueError):
        features.add_event_dummies(df, bad, ["quarter"], {"down": 0})
    with pytest.raises(ValueError):
        features.add_event_dummies(df, ev, ["quarter"], {"down": 3})


def test_scaler_uses_only_earlier_rows(spark):
    a = features.expanding_scale(panel(spark, [1.0, 3.0, 5.0, 100.0]), ["k"], ["v"])
    b = features.expanding_scale(panel(spark, [1.0, 3.0, 5.0, -7.0]), ["k"], ["v"])
    assert column(a, "v_scaled")[:3] == column(b, "v_scaled")[:3]
    assert column(a, "v_scaled")[1] == 2.0  # one earlier row: zero deviation counts as 1
    assert column(a, "v_scaled")[2] == pytest.approx((5 - 2) / 1.0)


def test_asof_takes_latest_complete_row(spark):
    df = spark.createDataFrame([("e", 1, 1.0, None), ("e", 2, 2.0, 9.0), ("e", 4, 4.0, None)], "k string, q_idx int, a double, b double")
    origins = spark.createDataFrame([("e", 1), ("e", 3), ("e", 5)], "k string, origin_q int")
    out = align.asof_latest(df, ["k"], ["a", "b"], origins)
    assert rows(out, "origin_q", "asof_q", "a") == [(1, None, None), (3, 2, 2.0), (5, 2, 2.0)]
    back = align.asof_latest(df, ["k"], ["a", "b"], origins, fallback=True)
    assert rows(back, "origin_q", "asof_q") == [(1, 2), (3, 2), (5, 2)]


def test_benchmark_alignment(spark):
    grid = spark.createDataFrame(
        [(q("2021Q1"), q("2021Q2"), 1, 2.5), (q("2021Q1"), q("2021Q3"), 2, 3.0), (q("2021Q2"), q("2021Q3"), 1, 3.0)],
        "origin_q int, target_q int, horizon int, actual double",
    )
    bench = spark.createDataFrame(
        [("2021-03-01", 1, 2.0), ("2021-01-15", 1, 7.0), ("2021-03-01", 2, 2.7), ("2021-06-01", 1, None), ("2020-12-01", 1, 9.9), ("bad", 1, 1.0)],
        "forecast_date string, horizon_quarters int, benchmark_forecast double",
    )
    out = align.align_benchmark(bench, grid, [], [1, 2])
    got = rows(out, "horizon", "forecast", "error")
    assert [(h, f, round(e, 9)) for h, f, e in got] == [(1, 2.0, 0.5), (2, 2.7, 0.3)]


def test_window_pin(spark):
    df = spark.createDataFrame([(q(x),) for x in ("2025Q3", "2025Q4", "2026Q1", "2026Q2")], "q_idx int")
    assert [r[0] for r in cal.restrict_to_window(df, q("2025Q4")).orderBy("q_idx").collect()] == [q("2025Q3"), q("2025Q4")]


def test_folds_match_expanding_blocks(spark):
    df = panel(spark, [float(i) for i in range(11)])
    # 11 rows, 3 folds: blocks of 2, the first 5 rows are train only
    assert column(features.time_series_folds(df, ["k"], 3), "fold") == [0] * 5 + [1, 1, 2, 2, 3, 3]


def test_stationary_variant_needs_enough_log_differences(spark):
    df = panel(spark, [float(i + 1) for i in range(8)])
    orders = spark.createDataFrame([("e", "I(1)")], "k string, integration_order string")
    assert column(features.stationary_series(df, ["k"], orders, "v"), "stationary") == [1.0] * 7


def test_safe_corr_of_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert df.agg(nm.safe_corr("x", "y"), nm.pair_count("x", "y")).first()[:] == (None, 2)


def test_ratio_rows_flag_shared_quarters(spark):
    df = spark.createDataFrame([(" Old ratio", 0.01, 0.02), ("new Ratio", None, 0.03)], "label string, `2021Q4` double, `2022Q1` double")
    out = reshape.tidy_ratio_rows(df, "label", {"Old ratio": "old", "New ratio": "new"}, q("2021Q1"), ["2021Q4", "2022Q1"])
    assert rows(out, "quarter", "measurement_basis", "measures_in_quarter") == [("2021Q4", "old", 1), ("2022Q1", "new", 2), ("2022Q1", "old", 2)]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    d = spark.range(10).select(F.date_add(F.lit(dt.date(1995, 1, 1)), (F.col("id") * 400).cast("int")).alias("d"))
    d.write.parquet(str(tmp_path / "d"))
    df = cal.filter_years(spark.read.parquet(str(tmp_path / "d")), "d", 1996, 1999)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,1996-01-01)" in plan and "LessThan(d,2000-01-01)" in plan
