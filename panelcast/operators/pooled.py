"""Models pooled over all entities of a panel.

Elastic nets need only means and covariances, so one aggregation per panel gives the sufficient
statistics of every horizon and time block; tuning over the whole parameter grid, refitting and
out-of-fold scoring then work on those few small matrices and never read the data again.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelcast.operators.align import asof_latest, over_time
from panelcast.operators.boosting import Boosted, Settings
from panelcast.operators.boosting import fit as boosted
from panelcast.operators.features import time_series_folds
from panelcast.operators.rules import class_code, ordinal_combine
from panelcast.operators.screening import _unpack, moments
from panelcast.sources.stage import written

# Default tuning grid.
ALPHAS = tuple(float(a) for a in np.logspace(-3, 1, 10))
L1_RATIOS = (0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
FOLDS = 4

FIT_SCHEMA = T.StructType(
    [
        T.StructField("horizon", T.IntegerType()), T.StructField("fold", T.IntegerType()),
        T.StructField("alpha", T.DoubleType()), T.StructField("l1_ratio", T.DoubleType()),
        T.StructField("cv_mse", T.DoubleType()), T.StructField("train_rows", T.LongType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("converged", T.BooleanType()),
    ]
)


def direct_frame(df: DataFrame, keys: list[str], target: str, features: list[str], horizons: list[int]) -> DataFrame:
    """Complete rows once per horizon: features at t, target ``y`` h rows later of the same entity."""
    w = over_time(keys)
    clean = df.dropna(subset=list(dict.fromkeys([target, *features])))
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lead(target, h).over(w).cast("double").alias("y")) for h in horizons
    ])
    long = clean.select(*keys, "q_idx", *features, cells.alias("_c"))
    return long.select(*keys, "q_idx", *features, F.inline("_c")).where(F.col("y").isNotNull())


def with_time_folds(frame: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Chronological folds cut on the calendar of each horizon, so no entity trains on another's future.

    The calendar table has one row per horizon and quarter: Spark broadcasts it by its measured size, else
    splits hot quarters.
    """
    calendar = frame.select("horizon", "q_idx").distinct()
    return frame.join(time_series_folds(calendar, ["horizon"], folds), ["horizon", "q_idx"])


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov


SWEEPS = 10_000  # coordinate sweeps after which a fit counts as not converged


def net_path(mean: np.ndarray, cov: np.ndarray, alphas: np.ndarray, l1_ratio: np.ndarray, sweeps: int = SWEEPS):
    """Elastic nets of many problems at once along their penalties, by coordinate descent on standardised moments.

    ``mean [m, 1 + p]`` and ``cov [m, 1 + p, 1 + p]`` hold each problem's moments, the response first; ``alphas`` are
    taken from the largest on, each fit starting from the one before; ``l1_ratio [m]`` is each problem's own.
    Minimises half the mean squared error plus alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2). Returns raw-scale
    intercepts [alpha, m], coefficients [alpha, m, p] and whether each fit came to rest [alpha, m].
    """
    sd = np.sqrt(np.diagonal(cov, axis1=1, axis2=2)[:, 1:])
    scale = np.where(sd > 0, sd, 1.0)
    g, c = cov[:, 1:, 1:] / (scale[:, :, None] * scale[:, None, :]), cov[:, 1:, 0] / scale
    m, p = c.shape
    out, rest = np.zeros((len(alphas), m, p)), np.zeros((len(alphas), m), bool)
    w = np.zeros((m, p))
    for at in np.argsort(-np.asarray(alphas, float), kind="stable"):
        lasso, ridge = alphas[at] * l1_ratio, alphas[at] * (1 - l1_ratio)
        open_ = np.arange(m)
        for _ in range(sweeps):
            own, moved = w[open_], np.zeros(len(open_))
            for j in range(p):
                gj = g[open_, j]
                rho = c[open_, j] - np.einsum("mp,mp->m", gj, own) + gj[:, j] * own[:, j]
                bottom = gj[:, j] + ridge[open_]
                new = np.where(bottom > 0, np.sign(rho) * np.maximum(np.abs(rho) - lasso[open_], 0.0) / np.where(bottom > 0, bottom, 1.0), 0.0)
                moved = np.maximum(moved, np.abs(new - own[:, j]))
                own[:, j] = new
            w[open_] = own
            still = moved <= 1e-10 * np.maximum(1.0, np.abs(own).max(axis=1, initial=0.0))
            rest[at, open_[still]] = True
            open_ = open_[~still]
            if not len(open_):
                break
        out[at] = w / scale
    return mean[None, :, 0] - np.einsum("amp,mp->am", out, mean[:, 1:]), out, rest


def elastic_net(mean: np.ndarray, cov: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = SWEEPS) -> tuple[float, np.ndarray, bool]:
    """One net: intercept, coefficients, and whether the sweeps came to rest (see :func:`net_path`)."""
    b0, w, rest = net_path(mean[None], cov[None], np.array([alpha]), np.array([l1_ratio]), sweeps)
    return float(b0[0, 0]), w[0, 0], bool(rest[0, 0])


def _mse(stats, intercept: float, w: np.ndarray) -> float:
    _, mean, cov = stats
    bias = mean[0] - intercept - w @ mean[1:]
    return float(cov[0, 0] - 2 * w @ cov[1:, 0] + w @ cov[1:, 1:] @ w + bias * bias)


def tune_direct(
    frame: DataFrame, features: list[str], alphas=ALPHAS, l1_ratios=L1_RATIOS, folds: int = FOLDS, sweeps: int = SWEEPS,
) -> DataFrame:
    """Best (alpha, l1_ratio) per horizon by chronological cross-validation and the fits it implies.

    ``frame`` comes from ``with_time_folds``. Row fold 0 is the final fit on all rows, folds 1..k the fits on
    strictly earlier blocks with the chosen parameters. Scaling uses each training window only. A horizon's whole
    grid is one path per l1_ratio over all folds together. Penalties at which a fold did not converge are not
    chosen; a horizon that has no other, or whose chosen fits do not converge, raises.
    """
    cols = ["y", *features]
    stats = moments(frame, ["horizon", "fold"], cols)
    packed = stats.groupBy("horizon").agg(F.collect_list(F.struct("fold", "n", "means", "covs")).alias("blocks"))  # one entry per fold
    alpha_, ratio_ = np.array(alphas, float), np.array(l1_ratios, float)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                blocks = {int(b["fold"]): _unpack(SimpleNamespace(n=b["n"], means=b["means"], covs=b["covs"]), len(cols)) for b in r.blocks}
                tests = [i for i in range(1, folds + 1) if i in blocks and any(j < i for j in blocks)]
                windows = [_merge([blocks[j] for j in sorted(blocks) if j < i]) for i in tests] + [_merge(list(blocks.values()))]
                k, t = len(ratio_), len(windows)
                mean, cov = (np.repeat(np.stack([x[c] for x in windows]), k, axis=0) for c in (1, 2))
                b0, w, rest = (x.reshape(len(alpha_), t, k, *x.shape[2:]) for x in net_path(mean, cov, alpha_, np.tile(ratio_, t), sweeps))
                mse = np.full((len(alpha_), k), np.inf)
                for a, l in np.ndindex(*mse.shape):
                    if rest[a, :, l].all() and tests:
                        mse[a, l] = np.mean([_mse(blocks[i], b0[a, n, l], w[a, n, l]) for n, i in enumerate(tests)])
                if tests and not np.isfinite(mse).any():
                    raise ValueError(f"no penalty of horizon {r.horizon} converges in {sweeps} sweeps")
                a, l = np.unravel_index(int(np.argmin(mse)), mse.shape)  # the first of equal ones; without tests the first
                if not rest[a, :, l].all():
                    raise ValueError(f"the fits of horizon {r.horizon} do not converge in {sweeps} sweeps")
                for n, i in [(t - 1, 0), *enumerate(tests)]:
                    out.append((int(r.horizon), i, alpha_[a], ratio_[l], mse[a, l], windows[n][0], b0[a, n, l], w[a, n, l].tolist(), True))
            yield pd.DataFrame(out, columns=FIT_SCHEMA.fieldNames())

    return packed.mapInPandas(solve, FIT_SCHEMA)


def fit_direct(frame: DataFrame, features: list[str], alpha: float, l1_ratio: float) -> DataFrame:
    """One elastic net per horizon with given parameters, from one aggregation."""
    cols = ["y", *features]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n, mean, cov = _unpack(r, len(cols))
                b0, w, rest = elastic_net(mean, cov, alpha, l1_ratio)
                out.append((int(r.horizon), 0, alpha, l1_ratio, None, n, b0, [float(v) for v in w], rest))
            yield pd.DataFrame(out, columns=FIT_SCHEMA.fieldNames())

    return moments(frame, ["horizon"], cols).mapInPandas(solve, FIT_SCHEMA)


def walk_forward_nets(
    frame: DataFrame, keys: list[str], features: list[str], alpha: float, l1_ratio: float, first_origin: int, model: str = "elastic_net",
    min_rows: int = 8,
) -> DataFrame:
    """Forecasts of every origin by an elastic net refitted on what was known there, pooled over entities.

    ``frame`` comes from ``direct_frame``. A row of quarter q with horizon h teaches from origin q + h on. Sums and
    products per horizon and quarter, running along the quarters, hold every origin's fit, so the panel is read
    once; they are taken around each horizon's mean to keep their digits. The result has the columns of the other
    forecasters: (keys, model, origin_q, horizon, target_q, actual, forecast, error, train_rows), whether the fit
    converged, and ``train_mean``, the mean response of the rows it learned from: the benchmark at the same origin.
    """
    cols = ["y", *features]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    rows = frame.dropna(subset=cols)
    centre = rows.groupBy("horizon").agg(F.array(*[F.avg(c) for c in cols]).alias("_m"))  # one row per horizon
    z = [F.col(c) - F.col("_m")[i] for i, c in enumerate(cols)]
    known = rows.join(centre, "horizon").groupBy("horizon", (F.col("q_idx") + F.col("horizon")).alias("known_q")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(f"_s{i}") for i, e in enumerate(z)],
        *[F.sum(z[i] * z[j]).alias(f"_p{k}") for k, (i, j) in enumerate(pairs)],
    )
    # every quarter of the calendar is an origin, also one at which nothing new became known
    origins = rows.select("horizon", F.col("q_idx").alias("known_q")).distinct()
    sums = ["n", *[f"_s{i}" for i in range(len(cols))], *[f"_p{k}" for k in range(len(pairs))]]
    along = W.partitionBy("horizon").orderBy("known_q").rowsBetween(W.unboundedPreceding, 0)
    running = origins.join(known, ["horizon", "known_q"], "full_outer").select("horizon", F.col("known_q").alias("origin_q"), *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in sums])
    running = running.where((F.col("origin_q") >= first_origin) & (F.col("n") >= min_rows)).join(centre, "horizon")

    def fit(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"_s{i}"] for i in range(len(cols))]) / r["n"]
                cov = np.zeros((len(cols), len(cols)))
                for k, (i, j) in enumerate(pairs):
                    cov[i, j] = cov[j, i] = r[f"_p{k}"] / r["n"] - mean[i] * mean[j]
                whole = mean + np.asarray(r["_m"], float)
                b0, w, rest = elastic_net(whole, cov, alpha, l1_ratio)
                out.append((int(r["horizon"]), int(r["origin_q"]), int(r["n"]), b0, [float(v) for v in w], rest, float(whole[0])))
            yield pd.DataFrame(out, columns=["horizon", "origin_q", "train_rows", "intercept", "coefficients", "converged", "train_mean"])

    fits = running.mapInPandas(fit, "horizon int, origin_q int, train_rows long, intercept double, coefficients array<double>, converged boolean, train_mean double")
    asked = rows.withColumn("origin_q", F.col("q_idx")).join(fits, ["horizon", "origin_q"])
    forecast = _linear(features)
    return asked.select(
        *keys, F.lit(model).alias("model"), "origin_q", "horizon", (F.col("origin_q") + F.col("horizon")).cast("int").alias("target_q"),
        F.col("y").alias("actual"), forecast.alias("forecast"), (F.col("y") - forecast).alias("error"), "train_rows", "converged", "train_mean",
    )


def _linear(features: list[str]) -> Column:
    terms = [F.col("coefficients")[i] * F.col(f) for i, f in enumerate(features)]
    return sum(terms, F.col("intercept"))


def oof_residuals(frame: DataFrame, fits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Out-of-fold residuals: each test block scored with the fit of its own earlier rows."""
    f = fits.where("fold > 0").select("horizon", "fold", "intercept", "coefficients")
    rows = frame.where("fold > 0").join(f, ["horizon", "fold"])
    return rows.select(
        *keys, F.col("q_idx").alias("origin_q"), "horizon", "fold", (F.col("y") - _linear(features)).alias("residual")
    )


def predict_latest(
    df: DataFrame, fits: DataFrame, keys: list[str], features: list[str], horizons: list[int],
) -> DataFrame:
    """Every horizon from the latest complete row of each entity (joined to one row per horizon)."""
    last = df.groupBy(*keys).agg(F.max("q_idx").alias("origin_q"))
    latest = asof_latest(df, keys, features, last).where(F.col("asof_q").isNotNull())
    final = fits.where("fold = 0").select("horizon", "intercept", "coefficients")
    fanned = latest.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return fanned.join(final, ["horizon"]).select(
        *keys, F.col("asof_q").alias("origin_q"), "horizon",
        (F.col("asof_q") + F.col("horizon")).cast("int").alias("target_q"), _linear(features).alias("forecast"),
    )


def nonzero_coefficients(fits: DataFrame, features: list[str], eps: float = 1e-9) -> DataFrame:
    rows = fits.where("fold = 0").select("horizon", F.posexplode("coefficients").alias("_i", "coefficient"))
    return rows.groupBy("horizon").agg(
        F.count_if(F.abs("coefficient") > eps).alias("nonzero"), F.count(F.lit(1)).alias("terms")
    )


SIDES = ["gt_cut", "gt_hold"]


def _with_sides(df: DataFrame, label: str) -> DataFrame:
    code = class_code(F.col(label))
    return df.withColumns({"gt_cut": (code > 0).cast("int"), "gt_hold": (code > 1).cast("int")})


def fit_ordinal_pair(df: DataFrame, features: list[str], label: str, **settings) -> Boosted:
    """Boosted-tree classifiers for "above cut" and "above hold", pooled over the panel.

    ``settings`` are those of :class:`~panelcast.operators.boosting.Settings`. Raises where all labels lie on one side,
    with ``one_sided`` only where there are none.
    """
    return boosted(_with_sides(df, label), features, SIDES, settings=Settings(**settings))


def fit_walk_forward_pair(df: DataFrame, features: list[str], label: str, folds: int = 4, **settings) -> tuple[Boosted, DataFrame]:
    """The pairs of ``folds`` chronological blocks, each fitted on all earlier quarters, and ``df`` with its ``fold``.

    All pairs grow together: one pass over the panel a tree level.
    """
    calendar = written(time_series_folds(df.select("q_idx").distinct(), [], folds).select("q_idx", "fold"))
    some = [r.fold for r in calendar.where("fold > 0").select("fold").distinct().orderBy("fold").collect()]
    if not some:
        raise ValueError(f"fewer than {folds + 1} quarters")
    rows = df.join(calendar, "q_idx").select(*df.columns, "fold")
    return boosted(_with_sides(rows, label), features, SIDES, "fold", some, Settings(**settings)), rows


def walk_forward_ordinal_pair(df: DataFrame, features: list[str], label: str, folds: int = 4, **settings) -> DataFrame:
    """Predictions of every row in the last ``folds`` blocks of the calendar under the pair fitted on all earlier quarters.

    The quarters of the first block are only trained on. Raises where a training set has only one outcome, with
    ``one_sided`` only where it is empty.
    """
    models, rows = fit_walk_forward_pair(df, features, label, folds, **settings)
    return _combined(models.predict(rows, "fold").drop("fold"))


def predict_ordinal_pair(models: Boosted, df: DataFrame) -> DataFrame:
    return _combined(models.predict(df))


def _combined(scored: DataFrame) -> DataFrame:
    own = scored.columns[: -len(SIDES)]
    probs = scored.select(*own, F.col("p_gt_cut").alias("_a"), F.col("p_gt_hold").alias("_b"))
    return ordinal_combine(probs, "_a", "_b").drop("_a", "_b")
