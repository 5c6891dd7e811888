import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelcast.operators import draws as dr
from panelcast.operators import skew, stress


def skewed(spark, n=6000):
    """One group holds most rows; values repeat, span many magnitudes and include gaps."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(n):
        g = "hot" if i % 3 else f"g{i % 7}"
        v = float(np.round(np.exp(rng.normal(0, 4)), 2)) * (1 if rng.random() > 0.3 else -1)
        data.append((g, None if i % 50 == 0 else v))
    return spark.createDataFrame(data, "g string, v double"), data


PROBS = {"p00": 0.0, "p10": 0.1, "p25": 0.25, "mid": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}


def test_quantiles_exact_for_hot_and_small_groups(spark):
    df, data = skewed(spark)
    out = {r.g: r for r in skew.exact_quantiles(df, ["g"], "v", PROBS, with_count=True).collect()}
    for g in {d[0] for d in data}:
        vals = [v for k, v in data if k == g and v is not None]
        assert out[g].n_values == len(vals)
        for name, p in PROBS.items():
            assert out[g][name] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-12)


def test_quantiles_without_keys_and_of_one_value(spark):
    df, data = skewed(spark, 500)
    vals = [v for _, v in data if v is not None]
    r = skew.exact_quantiles(df, [], "v", {"mid": 0.5}).first()
    assert r.mid == pytest.approx(float(np.median(vals)))
    same = df.withColumn("v", F.lit(4.0))
    assert skew.exact_quantiles(same, ["g"], "v", {"mid": 0.3}).agg(F.min("mid"), F.max("mid")).first()[:] == (4.0, 4.0)


@pytest.mark.parametrize("bin_rows", [1, 7, 500])
def test_quantiles_are_the_same_however_often_groups_are_cut(spark, bin_rows):
    df, data = skewed(spark, 3000)
    want = rows(skew.exact_quantiles(df, ["g"], "v", PROBS, True, True), "g", *PROBS, "n_values")
    assert rows(skew.exact_quantiles(df, ["g"], "v", PROBS, True, True, bin_rows), "g", *PROBS, "n_values") == want
    inf = float("inf")
    odd = spark.createDataFrame([(None, -inf), (None, 1.0), (None, inf), (None, None), ("b", None)], "g string, v double")
    got = {r.g: r for r in skew.exact_quantiles(odd, ["g"], "v", {"p0": 0.0, "mid": 0.5, "p100": 1.0}, bin_rows=bin_rows).collect()}
    assert (got[None].p0, got[None].mid, got[None].p100, got["b"].mid) == (-inf, 1.0, inf, None)


@pytest.mark.parametrize("reuse, adaptive", [(True, True), (False, True), (False, False)])
def test_a_large_group_needs_no_reused_exchange(spark, reuse, adaptive):
    """400,000 different values in one group, a second one beside it: equal to the engine's own percentile."""
    settings = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v).lower())
        value = (F.xxhash64("id") % 1_000_003).cast("double") + F.col("id") / 1e6
        df = spark.range(420_000).select(F.when(F.col("id") % 21 == 0, "small").otherwise("hot").alias("g"), value.alias("v"))
        q = skew.exact_quantiles(df, ["g"], "v", PROBS)
        want = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in PROBS.items()])
        for got, exact in zip(rows(q, "g", *PROBS), rows(want, "g", *PROBS)):
            assert got[0] == exact[0] and got[1:] == pytest.approx(exact[1:], rel=1e-12)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_bins_with_a_wanted_rank_go_on(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 1.5).alias("v"), F.lit(1).alias("c"))
    groups = df.groupBy(F.struct("g").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    open_ = df.select(F.struct("g").alias("_k"), F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_start"), F.col("v").alias("_v"), F.col("c").alias("_c"))
    left = skew._refined(open_, groups, [F.floor(0.5 * (F.col("_n") - 1))], 1000)
    assert left.count() < 20_000 / 100 and left.where("_v = 9999 * 1.5").count() == 1
    r = skew.exact_quantiles(df, ["g"], "v", {"mid": 0.5}, bin_rows=1000).first()
    assert r.mid == pytest.approx(19999 * 1.5 / 2)


def test_quantiles_of_odd_groups(spark):
    inf = float("inf")
    data = [("a", -inf), ("a", 1.0), ("a", inf), ("b", None), ("b", None), (None, 2.0), (None, None), ("c", inf), ("c", inf)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in skew.exact_quantiles(df, ["g"], "v", {"p0": 0.0, "mid": 0.5, "p100": 1.0}, with_count=True, with_mean=True).collect()}
    assert (got["a"].p0, got["a"].mid, got["a"].p100, got["a"].n_values) == (-inf, 1.0, inf, 3)
    assert (got["b"].p0, got["b"].mid, got["b"].n_values, got["b"].mean) == (None, None, 0, None)
    assert (got[None].mid, got[None].mean, got[None].n_values) == (2.0, 2.0, 1)
    assert (got["c"].p0, got["c"].mid) == (inf, inf)
    shifted = dr.recenter(df.where("g IS NULL").withColumn("i", F.lit(1)), None, ["g"], "t", ["i"], "v")
    assert sorted(str(r.v) for r in shifted.collect()) == ["2.0", "None"]


def test_salted_join_spreads_equal_rows_and_prunes(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(4000).select(F.lit("hot").alias("g"), F.lit(1).alias("v"), F.col("id"), F.lit("x").alias("wide")).write.parquet(path)
    side = spark.createDataFrame([("hot", 1)], "g string, x int")
    out = skew.salted_join(spark.read.parquet(path), side, ["g"], ["id"], salts=8).select("g", "x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 4000 and "wide" not in plan.split("ReadSchema")[1]
    salts = spark.read.parquet(path).select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 8 and max(r["count"] for r in salts) < 700


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    df, _ = skewed(spark, 900)
    side = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, x int")
    a = rows(skew.salted_join(df, side, ["g"], ["v"], how), "g", "v", "x")
    assert a == rows(df.join(side, ["g"], how), "g", "v", "x")


def paths(spark, matrix, **extra):
    data = [("e", i, h + 1, float(v)) for i, row in enumerate(matrix) for h, v in enumerate(row)]
    return spark.createDataFrame(data, "k string, draw_id int, horizon int, value double")


def test_fan_and_interval(spark):
    m = np.random.default_rng(0).normal(size=(101, 2))
    d = paths(spark, m)
    for r in dr.fan(d, ["k", "horizon"]).collect():
        want = np.percentile(m[:, r.horizon - 1], [10, 25, 50, 75, 90])
        assert [r.p10, r.p25, r.median, r.p75, r.p90] == pytest.approx(list(want))
    r = dr.interval(d.where("horizon = 1"), ["k"], 0.05, 0.95).first()
    assert r.mean == pytest.approx(m[:, 0].mean())


def test_recentred_median_and_spread(spark):
    m = np.random.default_rng(0).normal(size=(51, 2))
    point = spark.createDataFrame([("e", 1, 5.0), ("e", 2, -1.0)], "k string, horizon int, target double")
    out = dr.recenter(paths(spark, m), point, ["k", "horizon"], "target", ["draw_id"])
    for h, t in ((1, 5.0), (2, -1.0)):
        got = sorted(r.value for r in out.where(F.col("horizon") == h).collect())
        assert float(np.median(got)) == pytest.approx(t)
        assert got[-1] - got[0] == pytest.approx(float(np.ptp(m[:, h - 1])))


def test_sampled_paths_are_whole_and_stable(spark):
    m = np.arange(40).reshape(20, 2)
    a = dr.sample_paths(paths(spark, m), ["k"], 5, 7)
    assert a.count() == 10 and a.select("draw_id").distinct().count() == 5
    assert {r[0] for r in a.select("path").distinct().collect()} == set(range(5))
    b = dr.sample_paths(paths(spark, m).repartition(7), ["k"], 5, 7)
    assert rows(a, "path", "draw_id", "horizon") == rows(b, "path", "draw_id", "horizon")
    assert rows(a, "draw_id") != rows(dr.sample_paths(paths(spark, m), ["k"], 5, 8), "draw_id")


def test_zero_shock_is_the_baseline_and_impact_is_one_unit(spark):
    base = paths(spark, [[2.0, 3.0], [4.0, 5.0]])
    irf = spark.createDataFrame(
        [("e", d, h, "u", "u", 0.5 / (h + 1)) for d in (0, 1) for h in (0, 1)] + [("e", d, h, "y", "u", -0.2 * (d + 1)) for d in (0, 1) for h in (0, 1)],
        "k string, draw_id int, horizon int, response string, shock string, value double",
    )
    expected = spark.createDataFrame([("e", 4.0)], "k string, expected double")
    zero = dr.scenario(base, irf, expected, ["k"], "y", "u", 4.0)
    assert rows(zero, "draw_id", "horizon", "combined") == rows(base, "draw_id", "horizon", "value")
    one = dr.scenario(base, irf, expected, ["k"], "u", "u", 6.0)
    assert rows(one.where("horizon = 1"), "contribution") == [(2.0,), (2.0,)]
    y = dr.scenario(base, irf, expected, ["k"], "y", "u", 5.0)
    assert [(d, h, pytest.approx(c)) for d, h, c in rows(y, "draw_id", "horizon", "contribution")] == [
        (0, 1, -0.4), (0, 2, -0.4), (1, 1, -0.8), (1, 2, -0.8)
    ]


def test_residual_paths_keep_rows_together(spark):
    resid = [("e", o, h, float(10 * o + h)) for o in range(5) for h in (1, 2)] + [("e", 9, 1, 1000.0)]
    r = spark.createDataFrame(resid, "k string, origin_q int, horizon int, residual double")
    point = spark.createDataFrame([("e", 1, 100.0), ("e", 2, 200.0)], "k string, horizon int, forecast double")
    out = dr.residual_paths(point, r, ["k"], [1, 2], 30, 42)
    assert out.count() == 60
    for row in out.collect():
        assert row.source_q != 9  # incomplete origin
        assert row.value == row.horizon * 100 + 10 * row.source_q - 20  # median origin is 2


def test_convolution_against_numpy(spark):
    irf = [0.5, 0.3, 0.1, 0.0, 0.2]
    shock = [1.0, -2.0, 0.5, 4.0, 1.0]
    i = spark.createDataFrame([("e", "y", "s", h, v) for h, v in enumerate(irf)], "k string, response string, shock string, horizon int, value double")
    s = spark.createDataFrame([("e", "s", t, v) for t, v in enumerate(shock)], "k string, shock string, q_idx int, value double")
    got = [r[0] for r in dr.convolve(i, s, ["k"]).orderBy("q_idx").select("contribution").collect()]
    assert got == pytest.approx(list(np.convolve(irf, shock)[:5]))


def test_band_probabilities(spark):
    d = paths(spark, [[1.0], [2.0], [2.5], [3.5]])
    assert rows(dr.band_probabilities(d, ["k"], 2, 3), "p_cut", "p_hold", "p_hike") == [(0.25, 0.5, 0.25)]


def test_stressed_rate_floor_and_cap(spark):
    df = spark.createDataFrame(
        [(0.03, 0.0, 0.4), (0.03, 2.0, 0.4), (0.03, -1.0, 0.4), (0.005, 2.0, 0.6), (0.03, 300.0, 0.4)], "b double, d double, s double"
    )
    got = [r[0] for r in df.select(stress.stressed_pd(F.col("b"), F.col("d"), F.col("s"))).collect()]
    assert got == pytest.approx([0.03, 0.038, 0.03, 0.017, 1.0])


def test_expected_loss_rows_and_missing_assumptions(spark):
    seg = spark.createDataFrame([("a", 0.03, 0.4), ("b", 0.005, 0.6)], "segment string, pd_base double, sensitivity double")
    lgd = spark.createDataFrame([("a", 0.73, 1663.0, 0.0886), ("b", 0.16, 429996.0, 0.068)], "segment string, lgd double, ead double, discount_rate double")
    scen = [{"name": "up", "probability_weight": 0.1, "delta": -1}, {"name": "base", "probability_weight": 0.5, "delta": 0}, {"name": "down", "probability_weight": 0.4, "delta": 2}]
    out = stress.credit_stress(stress.join_assumptions(seg, [lgd]), scen)
    assert out.count() == 6
    r = out.where("segment = 'a' and scenario = 'down'").first()
    assert r.expected_loss == pytest.approx(0.038 * 0.73 * 1663 / 1.0886)
    with pytest.raises(ValueError):
        stress.credit_stress(seg, [{"name": "odd", "delta": 1}])
    with pytest.raises(ValueError):
        stress.join_assumptions(seg, [lgd.where("segment = 'a'")])


def test_salted_join_spreads_a_hot_key(spark):
    """With broadcasts off, no partition gets more than a fraction of a key that holds 90 % of the rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(k, v)
        df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("g"), "id")
        side = df.select("g").distinct().withColumn("x", F.lit(1))
        share = lambda j: max(r["n"] for r in j.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) / 20000
        assert share(df.join(side, "g")) > 0.9
        assert share(skew.salted_join(df, side, ["g"], ["id"], salts=64)) < 0.25
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_top_rows_per_group_are_limited_before_the_shuffle(spark):
    from panelcast.operators import profile

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = profile.tail(df, ["g"], "id", 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6


def test_single_series_case_without_keys(spark):
    from panelcast.operators import bootstrap, intervals

    m = np.random.default_rng(3).normal(size=(41, 1))
    d = paths(spark, m)
    r = dr.interval(d, [], 0.1, 0.9).first()
    assert (r.lower, r.mean) == (pytest.approx(np.percentile(m, 10)), pytest.approx(m.mean()))
    point = spark.createDataFrame([(7.0,)], "target double")
    pairs = skew.salted_join(d, point, [], ["draw_id"])
    assert pairs.count() == 41 and pairs.agg(F.min("target")).first()[0] == 7.0
    pred = spark.createDataFrame(
        [(x, o, o + 1, 1, 0.0, e, -e) for o in range(9) for x, e in (("a", float(o)), ("b", 1.0))],
        "model string, origin_q int, target_q int, horizon int, actual double, forecast double, error double",
    )
    g = bootstrap.bootstrap_gap(pred, [], "a", "b", 50, 1).first()
    assert g.origins == 9 and g.ci_lower <= g.gap <= g.ci_upper
    ivl = pred.selectExpr("model", "origin_q", "target_q", "horizon", "abs(error) nonconformity_score")
    f = intervals.current_factors(ivl, [], 0.8, None, 5)
    assert rows(f, "model", "scale_factor") == [("a", 7.0), ("b", 1.0)]
