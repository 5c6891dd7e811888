"""Regularisation paths of many problems at once against plain coordinate descent, and what unconverged fits do."""

import numpy as np
import pytest
from conftest import q
from pyspark.sql import functions as F

from panelcast.operators import pooled


def problem(rng, p=4, n=60):
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    y = x @ np.where(rng.random(p) < 0.5, rng.normal(size=p), 0) + rng.normal(size=n) + 3
    z = np.column_stack([y, x])
    return z.mean(axis=0), np.cov(z.T, bias=True)


def plain(mean, cov, alpha, l1, sweeps=200_000):
    sd = np.sqrt(np.diag(cov)[1:])
    g, c, w = cov[1:, 1:] / np.outer(sd, sd), cov[1:, 0] / sd, np.zeros(len(sd))
    for _ in range(sweeps):
        old = w.copy()
        for j in range(len(w)):
            rho = c[j] - g[j] @ w + w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (1 + alpha * (1 - l1))
        if np.abs(w - old).max() < 1e-13:
            break
    return w / sd


def test_path_equals_separate_fits():
    rng = np.random.default_rng(0)
    mean, cov = (np.stack(x) for x in zip(*[problem(rng) for _ in range(9)]))
    l1, alphas = rng.choice([0.1, 0.5, 1.0], 9), np.array([0.001, 1.0, 0.05])
    b0, w, rest = pooled.net_path(mean, cov, alphas, l1)
    assert rest.all()
    for a, alpha in enumerate(alphas):
        for m in range(9):
            want = plain(mean[m], cov[m], alpha, l1[m])
            assert w[a, m] == pytest.approx(want, abs=1e-6)
            assert b0[a, m] == pytest.approx(mean[m, 0] - want @ mean[m, 1:], abs=1e-5)
            one = pooled.elastic_net(mean[m], cov[m], alpha, l1[m])
            assert one[1] == pytest.approx(w[a, m], abs=1e-6) and one[2]


def panel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]  # nearly the same: slow without a strong penalty
    rows = [("a", q("2000Q1") + i, float(x[i, 0]), float(x[i, 1]), float(x[i - 1, 0] - 0.5 * x[i - 1, 1] + 0.1 * rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, q_idx int, x double, z double, y double")
    return pooled.with_time_folds(pooled.direct_frame(df, ["k"], "y", ["x", "z"], [1, 2]))


def test_the_choice_is_that_of_a_search_by_hand(spark):
    frame = panel(spark).persist()
    alphas, ratios = (0.01, 0.1, 1.0), (0.5, 1.0)
    got = {(r.horizon, r.fold): r for r in pooled.tune_direct(frame, ["x", "z"], alphas, ratios).collect()}
    assert all(r.converged for r in got.values())
    for h in (1, 2):
        rows = frame.where(F.col("horizon") == h).select("fold", "y", "x", "z").toPandas().to_numpy()
        best = None
        for a in alphas:
            for l1 in ratios:
                scores = []
                for f in range(1, 5):
                    train, test = rows[rows[:, 0] < f, 1:], rows[rows[:, 0] == f, 1:]
                    w = plain(train.mean(axis=0), np.cov(train.T, bias=True), a, l1)
                    b = train.mean(axis=0)[0] - w @ train.mean(axis=0)[1:]
                    scores.append(np.mean((test[:, 0] - b - test[:, 1:] @ w) ** 2))
                if best is None or np.mean(scores) < best[0] - 1e-12:
                    best = (np.mean(scores), a, l1)
        assert (got[h, 0].alpha, got[h, 0].l1_ratio) == best[1:] and got[h, 0].cv_mse == pytest.approx(best[0])


def test_unconverged_penalties_are_not_chosen(spark):
    frame = panel(spark).where("horizon = 1").persist()
    free = pooled.tune_direct(frame, ["x", "z"], (1e-6, 10.0), (0.5,)).where("fold = 0").collect()
    assert {r.alpha for r in free} == {1e-6}
    few = pooled.tune_direct(frame, ["x", "z"], (1e-6, 10.0), (0.5,), sweeps=5).where("fold = 0").collect()
    assert {r.alpha for r in few} == {10.0} and all(r.converged for r in few)
    with pytest.raises(Exception, match="no penalty of horizon"):
        pooled.tune_direct(frame, ["x", "z"], (1e-6,), (0.5,), sweeps=2).collect()
    walk = pooled.walk_forward_nets(frame.drop("fold"), ["k"], ["x", "z"], 0.1, 0.5, q("2004Q1"))
    assert walk.where("converged").count() == walk.count() > 0
