"""The curated build, nine-field records, file order, date pins and refitted nets."""

import numpy as np
import pytest
from conftest import q
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import calendar as cal
from panelcast.functions import stats
from panelcast.operators import curated, pooled, quality
from panelcast.sources import sinks

RECIPE = curated.Recipe(series=["a", "b"], growth={"a": "a_growth"}, lags={"a": [1]}, squares=["a_growth"], products=[("a", "b")])


def raw(spark, n=12):
    rows = [("k", s, f"{2020 + i // 4}-{i % 4 * 3 + 2:02d}-15", 100.0 + 3 * i * (1 if s == "a" else 2)) for i in range(n) for s in "ab"]
    return spark.createDataFrame(rows, "k string, series_id string, day string, v double").withColumn("day", F.col("day").cast("date"))


def test_build_publishes_behind_its_report(spark, tmp_path):
    out = curated.build(raw(spark), ["k"], "day", "v", RECIPE, "a", 8, str(tmp_path / "good")).orderBy("q_idx").collect()
    assert len(out) == 12 and out[0].a_growth is None and out[1].a_growth == pytest.approx(3.0)
    assert out[2].a_growth_sq == pytest.approx(out[2].a_growth ** 2) and out[3].a_x_b == pytest.approx(out[3].a * out[3].b)
    report = sinks.read_published(spark, str(tmp_path / "good"), sinks.QUALITY)
    assert set(report.columns) == {"k", *curated.RECORD}
    with pytest.raises(sinks.QualityGateError):
        curated.build(raw(spark), ["k"], "day", "v", RECIPE, "a", 80, str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").iterdir() if p.name.startswith("pointer-")]


def test_absent_columns_are_fail_records(spark):
    df = raw(spark).drop("day")
    r = quality.check_series(df, ["k"], "day", ["v"]).first()
    assert (r.status, r.notes, r.rows) == ("FAIL", "missing date column: day", 24)
    r = quality.check_curated(df, ["k"], "v", ["v"]).first()
    assert (r.status, r.notes) == ("FAIL", "missing date column: q_idx")
    contract = T.StructType([T.StructField("v", T.DoubleType())])
    table = curated.quality_table(raw(spark), curated.curate(raw(spark), ["k"], "day", "v", RECIPE), ["k"], "day", "v", "a", ["q_idx", "a"], 8, contract=contract)
    assert {r.dataset: r.status for r in table.collect()}["contract:v"] == "FAIL"


def test_labels_that_cannot_be_read(spark):
    df = spark.createDataFrame([("x", "t"), ("x", "t+2"), ("y", "later"), ("y", None)], "k string, label string")
    got = {r.k: (r.status, r.notes, r.missing_values) for r in curated.label_records(df, ["k"], "label", "labels").collect()}
    assert got == {"x": ("PASS", "ok", 0), "y": ("FAIL", "1 unreadable horizon labels", 1)}


def test_date_pin_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    raw(spark).write.parquet(path)
    cut = cal.restrict_dates(spark.read.parquet(path), "day", q("2020Q2"), q("2021Q1"))
    assert cut.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()[:] == ("2020-05-15", "2021-02-15")
    assert "GreaterThanOrEqual(day,2020-04-01)" in cut._jdf.queryExecution().executedPlan().toString()


def test_refitted_nets_see_no_later_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(e, 8000 + t, float(rng.normal()), float(rng.normal())) for e in "ab" for t in range(24)]
    df = spark.createDataFrame(rows, "k string, q_idx int, x double, y0 double")
    run = lambda d: {(r.k, r.origin_q, r.horizon): r for r in pooled.walk_forward_nets(pooled.direct_frame(d, ["k"], "y0", ["x"], [1, 2]), ["k"], ["x"], 0.05, 0.5, 8006).collect()}
    a, b = run(df), run(df.withColumn("y0", F.when(F.col("q_idx") > 8015, 1e6).otherwise(F.col("y0"))))
    assert a and all(a[k].forecast == pytest.approx(b[k].forecast) for k in a if k[1] <= 8015)
    # the fit of one origin, done directly
    m = np.array([(rows[24 * e + t + 1][3], rows[24 * e + t][2]) for e in range(2) for t in range(12)])  # (y, x) known at 8012
    b0, w, rest = pooled.elastic_net(m.mean(0), np.cov(m.T, ddof=0), 0.05, 0.5)
    assert rest and a["a", 8012, 1].forecast == pytest.approx(b0 + w[0] * rows[12][2])


def test_normal_values_and_repeated_pairs(spark):
    from math import erf, sqrt

    z = [-12.0, -8.0, -3.3, -0.5, 0.0, 1e-9, 0.7, 2.0, 5.5, 12.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", stats.normal_cdf("z").alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * (1 + erf(r.z / sqrt(2))), abs=1e-14) for r in got)
    pairs = spark.createDataFrame([(8, 10), (8, 10), (0, 5), (0, 0)], "h long, n long").coalesce(1)
    rows = pairs.select("h", "n", stats.binomial_test(F.col("h"), F.col("n"), 0.8).alias("t")).collect()
    assert rows[0].t == rows[1].t and rows[2].t.ci_lower == 0.0 and rows[3].t.p_value is None
