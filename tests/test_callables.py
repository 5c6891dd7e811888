"""Backtests of user callables: what they are given, seeds, blocks of origins, chunks, bad results."""

import numpy as np
import pytest
from conftest import q, rows
from pyspark.sql import functions as F

from panelcast.operators import callables as ca

START = q("2020Q1")


def panel(spark, n=8, key="a", inputs=None):
    data = [(key, START + i, float(i + 1), None if inputs is None else inputs[i]) for i in range(n)]
    return spark.createDataFrame(data, "k string, q_idx int, v double, x double")


def simulators():
    """Made inside a function, so that they travel with the task: workers do not import this file."""

    def spread(train, steps, n_sims, seed):
        """One step ahead around the value to come, two steps ahead far above it."""
        last = float(train.iloc[-1])
        return np.column_stack([np.linspace(last + h + (-1 if h == 1 else 10), last + h + (1 if h == 1 else 12), n_sims) for h in range(1, steps + 1)])

    def echo(train, steps, n_sims, seed):
        """Draws that say what the simulator was given: rows, last quarter, seed."""
        return np.array([[len(train), train.index[-1], seed]] * n_sims)[:, :steps]

    return spread, echo


spread_paths, echo = simulators()


@pytest.mark.parametrize("per_task", [1, 2, 50])
def test_intervals_of_simulated_draws(spark, per_task):
    draws = ca.walk_forward_draws(panel(spark), ["k"], "v", 4, [1, 2], spread_paths, "m", 5, 99, origins_per_task=per_task)
    assert draws.count() == 3 * 2 * 5
    out = ca.interval_backtest(draws, ["k"], 0.0, 1.0).orderBy("origin_q", "horizon").collect()
    assert [r.origin_q for r in out] == [START + i for i in (3, 3, 4, 4, 5, 5)] and [r.target_q - r.origin_q for r in out] == [1, 2] * 3
    assert [r.hit for r in out] == [True, False] * 3
    assert [r.interval_width for r in out] == pytest.approx([2.0] * 6)
    assert [r.point_forecast for r in out] == pytest.approx([5, 17, 6, 18, 7, 19])
    assert [r.nonconformity_score for r in out] == pytest.approx([0, 11] * 3)


def test_seeds_count_completed_origins_only(spark):
    said = lambda **kw: [r.said for r in ca.walk_forward_draws(panel(spark, 12), ["k"], "v", 4, [1, 2, 3], echo, "m", 1, 7, **kw).groupBy("origin_q").agg(F.sort_array(F.collect_list(F.struct("horizon", "value"))).alias("s")).orderBy("origin_q").select(F.transform("s", lambda c: c["value"]).alias("said")).collect()]
    full = said()
    assert full == [[n, START + n - 1, 7 + i] for i, n in enumerate(range(4, 10))]
    assert said(skip_origins=2, max_origins=3) == [[n, START + n - 1, 7 + i] for i, n in enumerate((6, 7, 8))]
    assert said(origins_per_task=2) == full


def test_frames_hold_whole_rows_up_to_the_origin(spark):
    inputs = [None, 1.0, 2.0, float("nan"), 4.0, 5.0, 6.0, None, 8.0, 9.0, 10.0, 11.0]
    df = panel(spark, 12, inputs=inputs).unionByName(panel(spark, 12, "b", [float(i) for i in range(12)])).unionByName(panel(spark, 3, "short", [1.0] * 3))

    def last_and_size(train, steps):
        assert list(train.columns) == ["v", "x"] and train.notna().all().all()
        return [train.index[-1], len(train)]

    for per_task in (1, 3, 100):
        out = ca.walk_forward_frames(df, ["k"], "v", ["x"], 4, [1, 2], last_and_size, "m", origins_per_task=per_task)
        got = {(r.k, r.origin_q - START, r.horizon): (r.forecast, r.actual) for r in out.collect()}
        want = {}
        for key, xs in (("a", inputs), ("b", [0.0] * 12)):
            for at in range(3, 10):
                whole = [i for i in range(at + 1) if xs[i] is not None and xs[i] == xs[i]]
                if len(whole) >= 4:
                    want[key, at, 1] = (START + whole[-1], at + 2.0)
                    want[key, at, 2] = (len(whole), at + 3.0)
        assert got == want


def test_blocks_of_origins_do_not_meet(spark):
    df = panel(spark, 25, inputs=[float(i) for i in range(25)])
    run = lambda **kw: rows(ca.walk_forward_frames(df, ["k"], "v", ["x"], 10, [1], lambda t, n: [t["v"].iloc[-1]] * n, "m", **kw), "origin_q")
    first, rest = run(max_origins=5), run(skip_origins=5)
    assert len(first) == 5 and not {*first} & {*rest} and max(first) < min(rest)
    assert sorted(first + rest) == run()


def test_later_rows_never_change_earlier_forecasts(spark):
    df = panel(spark, 14, inputs=[float(i * i % 7) for i in range(14)])
    changed = df.withColumn("x", F.when(F.col("q_idx") > START + 8, F.lit(-99.0)).otherwise(F.col("x")))
    mean = lambda t, n: [t["v"].mean() * t["x"].iloc[-1]] * n
    a, b = (rows(ca.walk_forward_frames(x, ["k"], "v", ["x"], 4, [1, 2], mean, "m", origins_per_task=3).where(F.col("origin_q") <= START + 8), "origin_q", "horizon", "forecast") for x in (df, changed))
    assert a == b and a


def test_one_series_without_keys_and_no_rows(spark):
    one = panel(spark).drop("k")
    out = ca.walk_forward_frames(one, [], "v", [], 4, [1], lambda t, n: [0.0] * n, "m")
    assert out.columns == ["model", "origin_q", "target_q", "horizon", "actual", "forecast", "error"] and out.count() == 4
    assert ca.walk_forward_draws(one.limit(0), [], "v", 4, [1], spread_paths, "m", 3, 1).count() == 0


def test_bad_arguments_and_results_are_refused(spark):
    df = panel(spark)
    for bad in (dict(initial=0), dict(horizons=[]), dict(horizons=[0]), dict(max_origins=0), dict(skip_origins=-1)):
        with pytest.raises(ValueError):
            ca.walk_forward_frames(df, ["k"], "v", [], **{"initial": 4, "horizons": [1], "forecast": len, "model": "m", **bad})
    with pytest.raises(ValueError):
        ca.walk_forward_draws(df, ["k"], "v", 4, [1], echo, "m", 0, 1)
    for result, text in (([1.0], "1 values of 2"), ([1.0, float("inf")], "not finite")):
        with pytest.raises(Exception, match=text):
            ca.walk_forward_frames(df, ["k"], "v", [], 4, [1, 2], lambda t, n, r=result: r, "m").collect()
    with pytest.raises(Exception, match="not 5 draws of 2 steps"):
        ca.walk_forward_draws(df, ["k"], "v", 4, [1, 2], lambda t, s, n, seed: np.ones((2, 2)), "m", 5, 1).collect()


def test_workers_get_the_package(tmp_path):
    """From another folder and without a path to the package, shipped code runs."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from panelcast.session import local_session, ship
from panelcast.plans.backtests import md5_paths
spark = local_session("1")
ship(spark)
run = lambda it: (b.assign(n=__import__("panelcast.plans.backtests", fromlist=["x"])._md5_noise(1, 2, 3)) for b in it)
assert spark.range(1).mapInPandas(run, "id long, n double").count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
