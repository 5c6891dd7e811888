"""Interval scoring, conformal calibration and coverage reports.

Interval tables have one row per (keys, model, origin_q, horizon); that key bounds every per-model
collection below by the number of origins times horizons, whatever the raw data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.numeric import close
from panelcast.functions.stats import binomial_test
from panelcast.operators.backtest import with_overall
from panelcast.operators.quality import assert_unique
from panelcast.operators.skew import bounded_quantiles, exact_quantiles

# Side distances up to this count as zero; rolling window and minimum score count.
ZERO_SIDE = 1e-12
WINDOW_QUARTERS = 12
MIN_SCORES = 8


def _inf() -> Column:
    return F.lit(float("inf"))


def nonconformity(actual: Column, point: Column, lower: Column, upper: Column) -> Column:
    """Error relative to the interval's reach on the side where the actual fell."""
    err = F.abs(actual - point)
    side = F.when(actual < point, point - lower).otherwise(upper - point)
    return F.when(err == 0, F.lit(0.0)).when(side <= ZERO_SIDE, _inf()).otherwise(F.try_divide(err, side))


def score_intervals(
    draws: DataFrame, actuals: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 0.9, value: str = "value",
    bounded: bool = False,
) -> DataFrame:
    """Percentile interval and median of each (model, origin, horizon) group of draws, scored.

    ``actuals`` has (keys, target_q, actual). ``bounded`` says that the number of draws per group is fixed
    by the simulation, which allows a single aggregation.
    """
    ids = [*keys, "model", "origin_q", "horizon"]
    quantiles = bounded_quantiles if bounded else exact_quantiles
    q = quantiles(
        draws, ids, value, {"interval_lower": lo, "point_forecast": 0.5, "interval_upper": hi}
    ).withColumn("target_q", (F.col("origin_q") + F.col("horizon")).cast("int"))
    return with_scores(q.join(actuals.select(*keys, "target_q", "actual"), [*keys, "target_q"]))


def with_scores(df: DataFrame) -> DataFrame:
    a, p, lo, hi = (F.col(c) for c in ("actual", "point_forecast", "interval_lower", "interval_upper"))
    return df.withColumns(
        {
            "hit": (lo <= a) & (a <= hi), "interval_width": hi - lo,
            "nonconformity_score": nonconformity(a, p, lo, hi),
        }
    )


def _scale(scores: Column, coverage: float) -> Column:
    """Finite-sample conformal quantile of a sorted array of finite scores, at least 1."""
    n = F.size(scores)
    rank = F.least(n, F.ceil((n + 1) * F.lit(coverage)).cast("int"))
    return F.greatest(F.lit(1.0), F.element_at(scores, rank))


def _finite_scores(c: str = "nonconformity_score") -> Column:
    v = F.col(c).cast("double")
    return F.collect_list(F.when(~F.isnan(v) & (v < _inf()), v))


def with_rolling_factors(
    ivl: DataFrame, keys: list[str], coverage: float, window: int | None = WINDOW_QUARTERS,
    min_scores: int = MIN_SCORES,
) -> DataFrame:
    """Interval rows plus the factor built from scores whose target quarter was known at their origin.

    Every row enters one stream per model twice: its score at its target quarter and its question at its
    origin quarter. A range frame over that stream pools the scores of the last ``window`` target
    quarters over all horizons: one evaluation of the input, one shuffle, no self-join. Fewer than
    ``min_scores`` finite scores leave the factor NULL.
    """
    ids = [*keys, "model"]
    row = F.struct(*[c for c in ivl.columns if c not in ids])
    v = F.col("nonconformity_score").cast("double")
    score = F.when(~F.isnan(v) & (v < _inf()), v)
    events = F.array(
        F.struct(F.col("target_q").alias("_t"), score.alias("_s"), F.lit(False).alias("_ask"), row.alias("_row")),
        F.struct(F.col("origin_q").alias("_t"), F.lit(None).cast("double").alias("_s"), F.lit(True).alias("_ask"), row.alias("_row")),
    )
    stream = ivl.select(*ids, F.inline(events))
    start = W.unboundedPreceding if window is None else -(window - 1)
    w = W.partitionBy(*ids).orderBy("_t").rangeBetween(start, 0)
    pooled = stream.withColumn("_all", F.collect_list("_s").over(w)).where("_ask")
    enough = F.size("_all") >= min_scores
    return pooled.select(
        *ids, "_row.*", F.when(enough, F.size("_all")).cast("bigint").alias("calibration_n"),
        F.when(enough, _scale(F.array_sort("_all"), coverage)).alias("scale_factor"),
    )


def rolling_factors(
    ivl: DataFrame, keys: list[str], coverage: float, window: int | None = WINDOW_QUARTERS,
    min_scores: int = MIN_SCORES,
) -> DataFrame:
    """One row per (model, origin, horizon) that has enough known scores."""
    rows = with_rolling_factors(ivl, keys, coverage, window, min_scores)
    return rows.where(F.col("scale_factor").isNotNull()).select(
        *keys, "model", "origin_q", "horizon", "calibration_n", F.lit(float(coverage)).alias("target_coverage"),
        "scale_factor",
    )


def current_factors(
    ivl: DataFrame, keys: list[str], coverage: float, window: int | None = WINDOW_QUARTERS,
    min_scores: int = MIN_SCORES,
) -> DataFrame:
    """Serving factors at the latest target quarter observed by any model."""
    ids = [*keys, "model"]
    as_of = ivl.agg(F.max("target_q")).scalar()
    per_target = ivl.groupBy(*ids, "target_q").agg(
        _finite_scores().alias("_s"), F.collect_set("horizon").alias("_h")
    )
    inside = F.lit(True) if window is None else F.col("target_q") > F.col("_as_of") - window
    pooled = per_target.withColumn("_as_of", as_of).groupBy(*ids).agg(
        F.array_sort(F.flatten(F.collect_list(F.when(inside, F.col("_s"))))).alias("_all"),
        F.array_distinct(F.flatten(F.collect_list("_h"))).alias("_h"),
    )
    return pooled.where(F.size("_all") >= min_scores).select(
        *ids, F.explode(F.col("_h").cast("array<int>")).alias("horizon"), F.size("_all").cast("bigint").alias("calibration_n"),
        F.lit(float(coverage)).alias("target_coverage"), _scale(F.col("_all"), coverage).alias("scale_factor"),
    )


def scale_rows(rows: DataFrame, factor: str = "scale_factor") -> DataFrame:
    """Scale each side of the interval around its point; rows without a usable factor stay raw."""
    f = F.col(factor)
    ok = F.coalesce(f.isNotNull() & ~F.isnan(f) & (f < _inf()) & (f >= 0), F.lit(False))
    p, a = F.col("point_forecast"), F.col("actual")
    bounds = rows.withColumns(
        {
            "interval_calibrated": ok, "interval_scale_factor": f,
            "interval_lower": F.when(ok, p - (p - F.col("interval_lower")) * f).otherwise(F.col("interval_lower")),
            "interval_upper": F.when(ok, p + (F.col("interval_upper") - p) * f).otherwise(F.col("interval_upper")),
        }
    )
    lo, hi = F.col("interval_lower"), F.col("interval_upper")
    raw = lambda c, new: F.when(F.col("interval_calibrated"), new).otherwise(F.col(c)) if c in rows.columns else new
    return bounds.withColumns(
        {"hit": raw("hit", (lo <= a) & (a <= hi)), "interval_width": raw("interval_width", hi - lo)}
    ).drop(factor)


def apply_factors(ivl: DataFrame, factors: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Calibrate with a factor table keyed by model and horizon, and by origin when it carries one.

    ``check`` refuses a table with two factors for one key, which would repeat interval rows.
    """
    on = [*keys, "model", *(["origin_q"] if "origin_q" in factors.columns else []), "horizon"]
    if check:
        assert_unique(factors, on, "calibration factors")
    return scale_rows(ivl.join(factors.select(*on, F.col("scale_factor").alias("_f")), on, "left"), "_f")


def calibrate_rolling(ivl: DataFrame, keys: list[str], coverage: float, **kw) -> DataFrame:
    """Intervals calibrated with what was known at each origin, without joining factors back."""
    return scale_rows(with_rolling_factors(ivl, keys, coverage, **kw)).drop("calibration_n")


def coverage_counts(ivl: DataFrame, keys: list[str]) -> DataFrame:
    """n, hits and mean width per model, overall and per horizon."""
    rows = ivl.dropna(subset=["hit", "interval_width"])
    detail = rows.groupBy(*keys, "model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.sum("interval_width").alias("w")
    )
    both = with_overall(detail, [*keys, "model"], ["n", "hits", "w"])
    return both.select(
        *keys, "model", "grain", "horizon", "n", "hits", (F.col("hits") / F.col("n")).alias("empirical_coverage"),
        (F.col("w") / F.col("n")).alias("mean_interval_width"),
    )


def coverage_table(
    ivl: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 0.9, confidence: float = 0.95,
) -> DataFrame:
    """Coverage with exact binomial p-value and Clopper-Pearson bounds per reduced row."""
    nominal = hi - lo
    tested = coverage_counts(ivl, keys).withColumn(
        "_b", binomial_test(F.col("hits"), F.col("n"), nominal, confidence)
    )
    return tested.select(
        *keys, "model", "grain", "horizon", "n", F.lit(nominal).alias("nominal_coverage"), "empirical_coverage",
        F.col("_b.ci_lower").alias("coverage_ci_lower"), F.col("_b.ci_upper").alias("coverage_ci_upper"),
        F.col("_b.p_value").alias("binom_p_value"),
        (F.col("_b.p_value") < 1.0 - confidence).alias("significantly_miscalibrated"), "mean_interval_width",
    )


def held_out(origin: str, ids: list[str], fraction: float) -> tuple[Column, Column]:
    """Rank of a row's origin among its model's origins and the last rank used for calibration."""
    w = W.partitionBy(*ids)
    rank = F.dense_rank().over(w.orderBy(origin))
    n = F.size(F.collect_set(origin).over(w))
    return rank, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(fraction))))


def factor_summary(factors: DataFrame, keys: list[str]) -> DataFrame:
    return factors.groupBy(*keys, "model", "horizon").agg(
        F.median("calibration_n").alias("calibration_n"), F.avg("scale_factor").alias("scale_factor")
    )


def heldout_comparison(
    ivl: DataFrame, keys: list[str], fraction: float = 0.7, lo: float = 0.1, hi: float = 0.9, tests: bool = True, **kw,
) -> DataFrame:
    """Coverage before and after calibration on the origins after each model's calibration share.

    Every held-out origin is calibrated with scores known at it; at least one origin stays held out. Both
    sides come from one pass over the calibrated rows, which keep their raw hit and width.
    """
    ids = [*keys, "model"]
    rows = with_rolling_factors(ivl, keys, hi - lo, **kw).withColumns(
        {"_raw_hit": F.col("hit"), "_raw_width": F.col("interval_width")}
    )
    rank, cut = held_out("origin_q", ids, fraction)
    held = scale_rows(rows).withColumns({"_rank": rank, "_cut": cut}).where(F.col("_rank") > F.col("_cut"))
    detail = held.dropna(subset=["hit", "interval_width", "_raw_hit"]).groupBy(*ids, "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_raw_hit").alias("raw_hits"), F.sum("_raw_width").alias("raw_w"),
        F.count_if("hit").alias("cal_hits"), F.sum("interval_width").alias("cal_w"),
        F.median("calibration_n").alias("calibration_n"), F.avg("interval_scale_factor").alias("scale_factor"),
    )
    both = with_overall(
        detail, ids, ["n", "raw_hits", "raw_w", "cal_hits", "cal_w"], horizon_only=("calibration_n", "scale_factor")
    )
    sides = {"raw": ("raw_hits", "raw_w"), "calibrated": ("cal_hits", "cal_w")}
    n = F.col("n")
    out = []
    for name, (hits, width) in sides.items():
        out += [
            (F.col(hits) / n).alias(f"{name}_empirical_coverage"), (F.col(width) / n).alias(f"{name}_mean_interval_width"),
        ]
    if tests:
        both = both.withColumns({f"_{s}": binomial_test(F.col(h), n, hi - lo) for s, (h, _) in sides.items()})
        for s in sides:
            p = F.col(f"_{s}.p_value")
            out += [p.alias(f"{s}_binom_p_value"), (p < 0.05).alias(f"{s}_significantly_miscalibrated")]
    return both.select(
        *ids, "grain", "horizon", "calibration_n", n.alias("validation_n"), F.lit(hi - lo).alias("target_coverage"),
        "scale_factor", *out,
    )


def serve_intervals(
    forecasts: DataFrame, factors: DataFrame, coverage: DataFrame, keys: list[str], lo: float, hi: float,
    validated: tuple[float, float] = (0.1, 0.9),
) -> DataFrame:
    """Bounds and disclosed coverage for serving.

    Only the validated quantile pair is calibrated and disclosed; any other pair keeps raw bounds and
    NULL coverage. A factor or report row made for another nominal coverage is not used.
    """
    if (lo, hi) != validated:
        none = {"empirical_coverage": "double", "coverage_n": "bigint", "significantly_miscalibrated": "boolean"}
        return forecasts.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    on = [*keys, "model", "horizon"]
    nominal = F.lit(hi - lo)
    usable = factors.where(
        (F.col("scale_factor") >= 0) & (F.col("scale_factor") < _inf()) & close(F.col("target_coverage"), nominal)
    ).select(*on, F.col("scale_factor").alias("_f"))
    shown = coverage.where(
        F.col("horizon").isNotNull() & close(F.col("target_coverage"), nominal)
    ).select(
        *on, F.col("calibrated_empirical_coverage").alias("empirical_coverage"),
        F.col("validation_n").alias("coverage_n"),
        (F.col("calibrated_significantly_miscalibrated") if "calibrated_significantly_miscalibrated" in coverage.columns
         else F.lit(None).cast("boolean")).alias("significantly_miscalibrated"),
    )
    j = forecasts.join(usable, on, "left").join(shown, on, "left")
    p, f = F.col("forecast"), F.coalesce("_f", F.lit(1.0))
    return j.withColumns(
        {
            "interval_lower": F.when(F.col("_f").isNull(), F.col("interval_lower")).otherwise(
                p - f * (p - F.col("interval_lower"))),
            "interval_upper": F.when(F.col("_f").isNull(), F.col("interval_upper")).otherwise(
                p + f * (F.col("interval_upper") - p)),
        }
    ).drop("_f")
