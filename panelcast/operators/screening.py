"""Predictor screening: correlations, collinearity, least squares from sufficient statistics, shortlists."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelcast.functions.numeric import pair_count, safe_corr, safe_corr_over, scrub_inf
from panelcast.functions.stats import f_upper_tail
from panelcast.operators.align import over_time
from panelcast.operators.features import label_regime
from panelcast.operators.reshape import to_long

# Screening thresholds and report texts.
VIF_LIMIT = 10.0
SIGNAL_CORR = 0.20
SIGNAL_P = 0.10
STRONG_CORR = 0.40
STRONG_P = 0.05
WEAK_SHARE = 0.50
CORR_STD_LIMIT = 0.30
NO_LAGGED = "no lagged feature available"
NO_LAG = "no candidate lag selected after availability and sample screen"
UNSAFE = "unsafe under assumed publication lag"
HIGH_VIF = "high VIF in primary candidate matrix"
LATE_START = "starts later than full sample"
SPARSE_NOTE = "substantial missingness warning"
ALTERNATIVE = "alternative proxy; use at most one of the pair"
CORR_SIGNAL = "candidate-lag correlation signal"
F_SIGNAL = "candidate-lag F-test signal"
WEAK_SIGNAL = "weak candidate-lag screening signal"


def lag_correlation(df: DataFrame, keys: list[str], target: str, drivers: list[str], k: int = 1, min_pairs: int = 3) -> DataFrame:
    """Correlation of the target with each driver k rows earlier; a stored lag column is preferred.

    Drivers absent in both forms are left out. All drivers are computed in one aggregation.
    """
    w = over_time(keys)
    used, derived = {}, {}
    for d in drivers:
        name = f"{d}_lag{k}"
        if name in df.columns:
            used[d] = (name, "used existing lag feature")
        elif d in df.columns:
            derived[f"_{name}"] = F.lag(d, k).over(w)
            used[d] = (f"_{name}", "derived lag for export")
    rows = df.withColumns(derived) if derived else df
    cells = [
        F.struct(
            F.lit(f"{d}_lag{k}").alias("variable"), F.lit(d).alias("source_variable"),
            pair_count(target, c).alias("observations"), safe_corr(target, c).alias("r"), F.lit(note).alias("notes"),
        )
        for d, (c, note) in used.items()
    ]
    agg = rows.groupBy(*keys).agg(F.array(*cells).alias("_c")).select(*keys, F.explode("_c").alias("c")).select(*keys, "c.*")
    r = F.when(F.col("observations") >= min_pairs, F.col("r"))
    return agg.select(
        *keys, "variable", "source_variable", "observations", r.alias("correlation"),
        F.abs(r).alias("abs_correlation"), "notes",
    )


def lead_lag(df: DataFrame, keys: list[str], target: str, drivers: list[str], max_lag: int = 4, min_pairs: int = 12) -> DataFrame:
    """Correlations of the target with every driver shifted by -L..L stored rows.

    One sort per (entity, driver) computes all shifts; the aggregation reuses that partitioning.
    """
    clean = scrub_inf(df.select(*keys, "q_idx", target, *drivers), [target, *drivers])
    long = to_long(clean.withColumn("_y", F.col(target).cast("double")), [*keys, "q_idx", "_y"], drivers)
    w = over_time([*keys, "variable"])
    lags = list(range(-max_lag, max_lag + 1))
    shifted = long.withColumns(
        {f"_s{i}": F.lag("value", k).over(w) if k >= 0 else F.lead("value", -k).over(w) for i, k in enumerate(lags)}
    )
    cells = F.array(*[
        F.struct(F.lit(k).alias("lag"), safe_corr("_y", f"_s{i}").alias("r"), pair_count("_y", f"_s{i}").alias("n_obs"))
        for i, k in enumerate(lags)
    ])
    agg = shifted.groupBy(*keys, "variable").agg(cells.alias("_c"))
    out = agg.select(*keys, "variable", F.explode("_c").alias("c")).select(*keys, "variable", "c.*")
    return out.select(
        *keys, "variable", "lag", F.when(F.col("n_obs") >= min_pairs, F.col("r")).alias("correlation"), "n_obs"
    )


def best_lag(ccf: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest positive lag per variable; ties go to the smaller lag."""
    rows = ccf.where((F.col("lag") > 0) & F.col("correlation").isNotNull())
    best = F.max_by(F.struct("lag", "correlation", "n_obs"), F.struct(F.abs("correlation"), -F.col("lag")))
    return rows.groupBy(*keys, "variable").agg(best.alias("b")).select(
        *keys, "variable", "b.lag", "b.correlation", "b.n_obs"
    )


def corr_matrix(df: DataFrame, keys: list[str], cols: list[str], min_rows: int = 24) -> DataFrame:
    """Correlation matrix of complete rows in long form, all cells in one aggregation."""
    rows = scrub_inf(df, cols).dropna(subset=cols)
    cells = [
        F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), safe_corr(a, b).alias("r"))
        for a in cols for b in cols
    ]
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.array(*cells).alias("_c"))
    out = agg.where(F.col("n_obs") >= min_rows).select(*keys, "n_obs", F.explode("_c").alias("c"))
    return out.select(*keys, "c.variable_a", "c.variable_b", F.col("c.r").alias("correlation"), "n_obs")


def moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Row count, means and population covariances of complete rows: the sufficient statistics of every
    least-squares problem over ``cols``. Centred running moments combine map-side without cancellation."""
    rows = scrub_inf(df, cols).dropna(subset=cols)
    pairs = list(combinations_with_replacement(cols, 2))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covs"),
    )


def _unpack(row, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = np.asarray(row.covs, dtype=float)
    cov = cov + np.triu(cov, 1).T
    return int(row.n), np.asarray(row.means, dtype=float), cov


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def vif(df: DataFrame, keys: list[str], cols: list[str], centered: bool = True) -> DataFrame:
    """Variance inflation factor per column from one moment aggregation.

    ``centered=False`` uses raw second moments (regression without a constant). Constant columns are left
    out; fewer than 3 rows or 2 columns give NULL. A singular system gives infinity.
    """
    k = len(cols)
    m = moments(df, keys, cols)
    schema = T.StructType(
        _key_fields(df, keys)
        + [T.StructField("variable", T.StringType()), T.StructField("observations", T.LongType()),
           T.StructField("vif", T.DoubleType()), T.StructField("notes", T.StringType())]
    )

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = {key: getattr(row, key) for key in keys}
                n, mean, cov = _unpack(row, k)
                if n < 3 or k < 2:
                    out += [{**head, "variable": c, "observations": n, "vif": None,
                             "notes": "insufficient rows or variables"} for c in cols]
                    continue
                use = [i for i in range(k) if cov[i, i] > 0]
                g = cov[np.ix_(use, use)]
                if not centered:
                    g = g + np.outer(mean[use], mean[use])
                scale = np.sqrt(np.diag(g))
                g = g / np.outer(scale, scale)
                try:
                    diag = np.diag(np.linalg.inv(g))
                except np.linalg.LinAlgError:
                    diag = np.full(len(use), np.inf)
                for i, v in zip(use, diag):
                    v = float(v) if v > 0 else math.inf
                    out.append({**head, "variable": cols[i], "observations": n, "vif": v,
                                "notes": "above 10 threshold" if v > VIF_LIMIT else "within 10 threshold"})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return m.mapInPandas(solve, schema)


def _fit(n: int, mean: np.ndarray, cov: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of y on a constant and xs."""
    b = np.linalg.lstsq(cov[np.ix_(xs, xs)], cov[xs, y], rcond=None)[0] if xs else np.zeros(0)
    sse = n * max(0.0, float(cov[y, y] - b @ cov[xs, y]))
    return b, sse


def _bic(n: int, sse: float, params: int) -> float:
    loglik = -0.5 * n * (math.log(2 * math.pi) + math.log(max(sse, 1e-300) / n) + 1)
    return -2 * loglik + params * math.log(n)


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Least squares per key from one moment aggregation; only the small Gram rows reach Python."""
    cols = [y, *xs]
    m = moments(df, keys, cols)
    schema = T.StructType(
        _key_fields(df, keys)
        + [T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
           T.StructField("coefficients", T.ArrayType(T.DoubleType()))]
        + [T.StructField(c, T.DoubleType()) for c in ("sse", "r2", "bic")]
    )

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = {key: getattr(row, key) for key in keys}
                n, mean, cov = _unpack(row, len(cols))
                b, sse = _fit(n, mean, cov, 0, list(range(1, len(cols))))
                total = n * cov[0, 0]
                out.append({**head, "n": n, "intercept": float(mean[0] - b @ mean[1:]),
                            "coefficients": [float(v) for v in b], "sse": sse,
                            "r2": 1 - sse / total if total > 0 else None, "bic": _bic(n, sse, len(cols))})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return m.mapInPandas(solve, schema)


def granger_screen(
    df: DataFrame, keys: list[str], target: str, drivers: list[str], limit: int = 4, min_rows: int = 24,
) -> DataFrame:
    """Do q lags of a driver add to p own lags of the target? p and q in 1..limit by BIC on one sample.

    One row per (driver, q): p-value of the F test at the BIC-chosen own lags and whether BIC chose q. The
    lag columns of one (entity, driver) feed a single moment aggregation; every sub-model is solved from
    sub-blocks of that small matrix.
    """
    clean = scrub_inf(df.select(*keys, "q_idx", target, *drivers), [target, *drivers]).dropna(subset=[target])
    long = to_long(clean.withColumn("_y", F.col(target).cast("double")), [*keys, "q_idx", "_y"], drivers)
    ids = [*keys, "variable"]
    w, whole = over_time(ids), W.partitionBy(*ids)
    lagged = long.withColumns(
        {
            "_top": F.least(F.lit(limit), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / 10))).cast("int"),
            "_rows": F.count(F.lit(1)).over(whole),
            **{f"_y{i}": F.lag("_y", i).over(w) for i in range(1, limit + 1)},
            **{f"_x{i}": F.lag("value", i).over(w) for i in range(1, limit + 1)},
        }
    )
    # lags beyond the entity's own limit are set to 0 so that they neither drop rows nor carry weight
    lags = [f"_{v}{i}" for v in "yx" for i in range(1, limit + 1)]
    trimmed = lagged.withColumns({c: F.when(F.col("_top") < int(c[2:]), F.lit(0.0)).otherwise(F.col(c)) for c in lags})
    usable = trimmed.where(F.col("_rows") >= min_rows)
    extra = usable.groupBy(*ids).agg(F.first("_top").alias("top"), F.count_distinct("value").alias("levels"))
    cols = ["_y", *lags]
    stats = moments(usable, ids, cols).join(extra, ids).where(F.col("levels") >= 3)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("variable", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("lag", "own_lags")]
        + [T.StructField("p_value", T.DoubleType()), T.StructField("n_obs", T.LongType()),
           T.StructField("bic_selected", T.BooleanType())]
    )

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = {key: getattr(row, key) for key in ids}
                # namedtuple fields may not start with an underscore, so only plain names are read here
                n, mean, cov = _unpack(row, len(cols))
                top = int(row.top)
                own = lambda p: list(range(1, p + 1))
                driver = lambda q: list(range(limit + 1, limit + 1 + q))
                fits = {
                    (p, q): _fit(n, mean, cov, 0, own(p) + driver(q))[1]
                    for p in range(1, top + 1) for q in range(1, top + 1)
                }
                p_best, q_best = min(fits, key=lambda pq: (_bic(n, fits[pq], 1 + sum(pq)), pq))
                base = _fit(n, mean, cov, 0, own(p_best))[1]
                for q in range(1, top + 1):
                    sse, dof = fits[p_best, q], n - 1 - p_best - q
                    f = ((base - sse) / q) / (sse / dof) if sse > 0 and dof > 0 else math.inf
                    p_value = f_upper_tail(f, q, dof) if dof > 0 else None
                    out.append({**head, "lag": q, "own_lags": p_best, "p_value": p_value, "n_obs": n,
                                "bic_selected": q == q_best})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return stats.mapInPandas(solve, schema)


def rolling_corr(df: DataFrame, keys: list[str], x: str, y: str, n: int = 20) -> DataFrame:
    rows = df.dropna(subset=[x, y])
    w = over_time(keys).rowsBetween(-(n - 1), 0)
    r = F.when(F.count(F.lit(1)).over(w) == n, safe_corr_over(x, y, w))
    return rows.select(*keys, "q_idx", r.alias("rolling_corr")).where(F.col("rolling_corr").isNotNull())


def sign_changes(rolled: DataFrame, keys: list[str], strong: float = SIGNAL_CORR) -> DataFrame:
    """Sign changes of the non-zero values, and among values of at least the strong threshold.

    Each filtered subsequence is compared with its own previous element through the last kept sign.
    """
    w = over_time(keys)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    r = F.col("rolling_corr")
    # pandas keeps the sign of exact zeros in the strong series only when the threshold is zero
    raw = F.when(r != 0, F.signum(r))
    hard = F.when(F.abs(r) >= strong, F.signum(r))
    marked = rolled.withColumns({"_raw": raw, "_hard": hard}).withColumns(
        {"_praw": F.last("_raw", True).over(before), "_phard": F.last("_hard", True).over(before)}
    )
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("_raw") != F.col("_praw")).alias("raw_sign_changes"),
        F.count_if(F.col("_hard") != F.col("_phard")).alias("strong_sign_changes"),
    )


def regime_corr(df: DataFrame, keys: list[str], x: str, y: str, bounds, min_rows: int = 8) -> DataFrame:
    rows = label_regime(df.dropna(subset=[x, y]), bounds).where(F.col("regime").isNotNull())
    agg = rows.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n_obs"), safe_corr(x, y).alias("_r"))
    return agg.select(*keys, "regime", "n_obs", F.when(F.col("n_obs") >= min_rows, F.col("_r")).alias("regime_corr"))


def stability_summary(
    rolled: DataFrame, regimes: DataFrame, keys: list[str], calm: list[str], crisis: list[str],
    signal: float = SIGNAL_CORR,
) -> DataFrame:
    """Range, spread, weak share and sign changes of rolling correlations, with a warning text."""
    r = F.col("rolling_corr")
    base = rolled.groupBy(*keys).agg(
        F.count(r).alias("rolling_windows"), F.min(r).alias("rolling_corr_min"), F.max(r).alias("rolling_corr_max"),
        F.avg(F.abs(r)).alias("mean_abs_rolling_corr"), F.stddev_samp(r).alias("rolling_corr_std"),
        F.avg((F.abs(r) < signal).cast("double")).alias("weak_window_share"),
    )
    peak = lambda names: F.max(F.when(F.col("regime").isin(*names), F.abs("regime_corr")))
    only = regimes.groupBy(*keys).agg(peak(calm).alias("_calm"), peak(crisis).alias("_crisis")).select(
        *keys,
        (F.coalesce(F.col("_crisis") >= signal, F.lit(False))
         & F.coalesce(F.col("_calm") < signal, F.lit(True))).alias("crisis_only_signal"),
    )
    j = base.join(sign_changes(rolled, keys, signal), keys).join(only, keys, "left")
    reasons = [
        (F.col("strong_sign_changes") > 0, "strong sign change"),
        (F.col("weak_window_share") > WEAK_SHARE, "weak in more than half of rolling windows"),
        (F.col("rolling_corr_std") > CORR_STD_LIMIT, "large rolling-correlation variation"),
        (F.col("crisis_only_signal"), "signal concentrated in crisis periods"),
    ]
    warning = F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in reasons])
    return j.withColumn("crisis_only_signal", F.coalesce("crisis_only_signal", F.lit(False))).withColumn(
        "stability_warning", warning
    ).withColumn("unstable", F.col("stability_warning") != "")


def parse_feature(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Base series and lag of names like ``<base>_lag<k>``; other names have no lag."""
    f = F.col(feature)
    return df.withColumns(
        {
            "variable": F.regexp_replace(f, r"_lag\d+$", ""),
            "feature_lag": F.nullif(F.regexp_extract(f, r"_lag(\d+)$", 1), F.lit("")).cast("int"),
        }
    )


def availability_check(features: DataFrame, assumptions: DataFrame) -> DataFrame:
    """A lagged feature is safe when its lag reaches its base series' assumed release lag."""
    j = parse_feature(features).join(assumptions.select("variable", "min_safe_lag"), "variable", "left")
    return j.withColumn("origin_safe", F.coalesce(F.col("feature_lag") >= F.col("min_safe_lag"), F.lit(False)))


def extend_assumptions(assumptions: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived series (variable, source_variable) inherit the release lag of their source."""
    new = derived.join(assumptions.select("variable"), "variable", "left_anti")
    lagged = new.join(
        assumptions.select(F.col("variable").alias("source_variable"), "min_safe_lag"), "source_variable"
    ).select("variable", "min_safe_lag")
    return assumptions.select("variable", "min_safe_lag").unionByName(lagged)


def choose_safe_lag(checked: DataFrame, best: DataFrame, coverage: DataFrame, keys: list[str], min_coverage: float = 0.5) -> DataFrame:
    """One safe lagged feature per base: the best lag when stored, else the next above, else the smallest.

    ``checked`` comes from ``availability_check``, ``best`` has (keys, variable, lag), ``coverage``
    (keys, feature, coverage_pct).
    """
    safe = checked.where("origin_safe").select("feature", "variable", "feature_lag", "min_safe_lag")
    first = safe.groupBy("variable").agg(F.min("feature_lag").alias("_first"))
    j = safe.join(first, "variable")
    j = j.join(best.select(*keys, "variable", F.col("lag").alias("_best")), "variable", "left")
    want = F.greatest(F.coalesce("_best", "_first"), F.col("min_safe_lag"))
    tier = F.when(F.col("feature_lag") == want, 0).when(F.col("feature_lag") >= want, 1).otherwise(2)
    pick = j.groupBy(*keys, "variable").agg(F.min_by(F.struct("feature", "feature_lag"), F.struct(tier, "feature_lag")).alias("p"))
    chosen = pick.select(*keys, "variable", "p.feature", "p.feature_lag")
    return chosen.join(coverage.select(*keys, "feature", "coverage_pct"), [*keys, "feature"]).where(
        F.col("coverage_pct") >= min_coverage
    )


def pick_alternative(coverage: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Of two substitute variables the one with the better coverage (the first on a tie)."""
    cell = lambda v: F.max(F.when(F.col("variable") == v, F.col("coverage_pct")))
    agg = coverage.where(F.col("variable").isin(a, b)).groupBy(*keys).agg(cell(a).alias("coverage_a"), cell(b).alias("coverage_b"))
    keep_a = F.col("coverage_a") >= F.col("coverage_b")
    return agg.select(
        *keys, F.when(keep_a, a).otherwise(b).alias("preferred"), F.when(keep_a, b).otherwise(a).alias("alternative"),
        "coverage_a", "coverage_b",
    )


def shortlist(
    base: DataFrame, keys: list[str], ccf: DataFrame, granger: DataFrame | None, vifs: DataFrame, chosen: DataFrame,
    coverage: DataFrame, availability: DataFrame,
) -> DataFrame:
    """Everything known about each candidate on one row.

    All inputs are reduced to at most one row per entity and variable (or feature and lag). Without the
    F-screen table its p-value column is missing everywhere.
    """
    pick = chosen.select(*keys, "variable", "feature", "feature_lag")
    at_lag = ccf.select(*keys, "variable", F.col("lag").alias("feature_lag"), F.col("correlation").alias("candidate_corr"))
    known = base.join(pick, [*keys, "variable"], "left").join(at_lag, [*keys, "variable", "feature_lag"], "left")
    if granger is None:
        known = known.withColumn("candidate_p", F.lit(None).cast("double"))
    else:
        p_at_lag = granger.select(*keys, "variable", F.col("lag").alias("feature_lag"), F.col("p_value").alias("candidate_p"))
        known = known.join(p_at_lag, [*keys, "variable", "feature_lag"], "left")
    out = (
        known.join(vifs.select(*keys, F.col("variable").alias("feature"), "vif"), [*keys, "feature"], "left")
        .join(
            coverage.select(*keys, "variable", "coverage_pct", "late_start", "substantial_missingness"),
            [*keys, "variable"], "left",
        )
        .join(availability.select("feature", "origin_safe"), "feature", "left")
    )
    return out.withColumn("abs_corr", F.abs("candidate_corr"))


def classify_candidates(df: DataFrame, alternative: str | None = None) -> DataFrame:
    """Screening status and reason text from blockers, warnings and signals."""
    lag_known = F.col("feature_lag").isNotNull()
    blocker = F.when(~F.col("has_lag_feature"), NO_LAGGED).when(
        ~lag_known, NO_LAG
    ).when(~F.coalesce("origin_safe", F.lit(False)), UNSAFE)
    high_vif = F.coalesce(F.col("vif") > VIF_LIMIT, F.lit(False))
    sparse = F.coalesce("substantial_missingness", F.lit(True))
    warnings = [
        F.when(high_vif, HIGH_VIF),
        F.when(F.coalesce("late_start", F.lit(True)), LATE_START),
        F.when(sparse, SPARSE_NOTE),
    ]
    if alternative is not None:
        warnings.append(F.when(F.col("feature") == alternative, ALTERNATIVE))
    signals = [
        F.when(F.col("abs_corr") >= SIGNAL_CORR, CORR_SIGNAL),
        F.when(F.col("candidate_p") <= SIGNAL_P, F_SIGNAL),
    ]
    text = lambda parts: F.concat_ws("; ", *parts)
    strong = F.coalesce(F.col("abs_corr") >= STRONG_CORR, F.lit(False)) | F.coalesce(
        F.col("candidate_p") <= STRONG_P, F.lit(False)
    )
    no_signal, no_warning = text(signals) == "", text(warnings) == ""
    status = (
        F.when(blocker.isNotNull(), "exclude")
        .when(no_signal, "optional")
        .when(strong & ~sparse & ~high_vif, "strong candidate")
        .when(~no_warning, "optional/shorter-sample candidate")
        .otherwise("candidate")
    )
    reason = (
        F.when(blocker.isNotNull(), text([blocker, *warnings]))
        .when(no_signal, text([*warnings, F.lit(WEAK_SIGNAL)]))
        .otherwise(text([*warnings, *signals]))
    )
    return df.withColumns({"screening_status": status, "reason": reason})


def strongest_first(df: DataFrame, col: str) -> DataFrame:
    """Sorted by strength with missing values last."""
    return df.orderBy(F.desc_nulls_last(col))
