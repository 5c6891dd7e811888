"""Summaries and profiles of panels and raw series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.calendar import q_idx, q_label
from panelcast.functions.numeric import ratio
from panelcast.operators.align import over_time
from panelcast.operators.features import label_regime


# Coverage classes and their lower bounds.
COVERAGE_CLASSES = [
    (0.95, "core_long_sample_candidate"), (0.80, "shorter_sample_candidate"), (0.50, "limited_sample_candidate"),
]
LOW_COVERAGE = "exclude_low_coverage"


def annual_summary(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    year = F.floor(F.col("q_idx") / 4).cast("int").alias("year")
    return df.groupBy(*keys, year).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def regime_summary(df: DataFrame, keys: list[str], bounds, cols: list[str]) -> DataFrame:
    return (
        label_regime(df, bounds)
        .where(F.col("regime").isNotNull())
        .groupBy(*keys, "regime")
        .agg(
            q_label(F.min("q_idx")).alias("first_quarter"), q_label(F.max("q_idx")).alias("last_quarter"),
            F.count(F.lit(1)).alias("quarters"), *[F.avg(c).alias(f"avg_{c}") for c in cols],
        )
    )


def error_by_horizon(
    bench: DataFrame, keys: list[str], forecast: str, actual: str, error: str | None = None,
    end_q: int | None = None,
) -> DataFrame:
    """Bias, MAE and RMSE of dated benchmark forecasts per horizon (error = actual - forecast)."""
    e = F.col(actual) - F.col(forecast)
    if error is not None and error in bench.columns:
        e = F.coalesce(F.col(error), e)
    rows = bench.where(
        (F.col("horizon_quarters") >= 0) & F.col(forecast).isNotNull() & F.col(actual).isNotNull()
    ).withColumn("_e", e)
    if end_q is not None:
        rows = rows.where(q_idx("forecast_date") + F.col("horizon_quarters") <= end_q)
    return rows.groupBy(*keys, "horizon_quarters").agg(
        F.count("_e").alias("n_forecasts"), F.min("forecast_date").alias("first_forecast"),
        F.max("forecast_date").alias("last_forecast"), F.avg("_e").alias("mean_error"),
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
    )


def seasonal_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    season = (F.col("q_idx") % 4 + 1).cast("int").alias("season")
    return df.groupBy(*keys, season).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def coverage_profile(df: DataFrame, keys: list[str], cols: list[str], material: float = 0.2) -> DataFrame:
    """Per column: non-missing rows, shares, first and last filled quarter, late start, sample class.

    All columns are profiled in one aggregation; only the single result row per key is turned long.
    """
    stats = []
    for c in cols:
        filled = F.when(F.col(c).isNotNull(), F.col("q_idx"))
        stats.append(
            F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.min(filled).alias("a"), F.max(filled).alias("b"))
        )
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("q_idx").alias("_start"), F.array(*stats).alias("_all")
    )
    long = agg.select(*keys, "_rows", "_start", F.explode("_all").alias("_s")).withColumn("variable", F.col("_s.variable"))
    n, rows = F.col("_s.n"), F.col("_rows")
    share = n / rows
    return long.select(
        *keys, "variable", n.alias("non_null_rows"), (rows - n).alias("missing_count"),
        ((rows - n) / rows).alias("missing_pct"), share.alias("coverage_pct"),
        q_label("_s.a").alias("first_non_null"), q_label("_s.b").alias("last_non_null"),
        F.coalesce(F.col("_s.a") != F.col("_start"), F.lit(False)).alias("late_start"),
        ((rows - n) / rows >= material).alias("substantial_missingness"),
        F.coalesce(*[F.when(share >= lo, F.lit(name)) for lo, name in COVERAGE_CLASSES], F.lit(LOW_COVERAGE)).alias(
            "coverage_class"
        ),
    )


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    n_cols = len([c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.lit(n_cols)).cast("bigint").alias("columns"),
        q_label(F.min("q_idx")).alias("first_quarter"), q_label(F.max("q_idx")).alias("last_quarter"),
    )


def integrity_summary(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows, columns, repeated and missing quarters; with an ``order`` (a position column, or ``"file"`` for the
    files scanned) also whether the quarters run forward in it, read from the same aggregation."""
    from panelcast.operators.quality import with_back_steps, with_place

    n_cols = len([c for c in df.columns if c not in (order, *keys)])
    count = F.count(F.lit(1)).alias("_n")
    if order is None:
        per_q = df.groupBy(*keys, "q_idx").agg(count)
    else:
        places = with_place(df, order).groupBy(*keys, "q_idx", "_file", "_block").agg(count, F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
        per_q = with_back_steps(places, keys, "q_idx").groupBy(*keys, "q_idx").agg(F.sum("_n").alias("_n"), F.bool_or("_back").alias("_back"))
    return per_q.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.first(F.lit(n_cols)).cast("bigint").alias("columns"),
        q_label(F.min("q_idx")).alias("first_quarter"), q_label(F.max("q_idx")).alias("last_quarter"),
        F.sum(F.col("_n") - 1).alias("duplicate_quarters"),
        (F.max("q_idx") - F.min("q_idx") + 1 - F.count(F.lit(1))).cast("bigint").alias("missing_quarters"),
        *([(~F.bool_or("_back")).alias("is_sorted")] if order else []),
    )


def level_shift(
    df: DataFrame, keys: list[str], value: str, span: tuple[int, int], before: tuple[int, int],
    after: tuple[int, int], threshold: float = 0.25,
) -> DataFrame:
    """Largest absolute step inside a span and difference of two yearly means against a threshold."""
    q = F.col("q_idx")
    inside = df.where(q.between(min(span[0], before[0]), max(span[1], after[1])))
    w = over_time(keys)
    prev_ok = F.lag("q_idx").over(w) >= span[0]
    step = F.when(prev_ok & q.between(*span), F.abs(F.col(value) - F.lag(value).over(w)))
    agg = inside.withColumn("_step", step).groupBy(*keys).agg(
        F.coalesce(F.max("_step"), F.lit(0.0)).alias("max_step"),
        F.coalesce(
            F.abs(F.avg(F.when(q.between(*after), F.col(value))) - F.avg(F.when(q.between(*before), F.col(value)))),
            F.lit(0.0),
        ).alias("mean_shift"),
    )
    return agg.withColumn(
        "visible_break", (F.col("max_step") >= threshold) | (F.col("mean_shift") >= threshold)
    )


def decompose_additive(df: DataFrame, keys: list[str], value: str, period: int = 4) -> DataFrame:
    """Trend (2 x m centred moving average), seasonal means that sum to zero, remainder.

    The trend is missing for the first and last m/2 rows.
    """
    half = period // 2
    w = over_time(keys)
    ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) * 0.5
    inner = reduce(
        Column.__add__,
        [F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value)
         for k in range(half - 1, -half, -1)],
    )
    t = df.withColumn("trend", (ends + inner) / period).withColumn("_season", F.pmod("q_idx", F.lit(period)))
    by_season = W.partitionBy(*keys, "_season")
    s = t.withColumn("_sm", F.avg(F.col(value) - F.col("trend")).over(by_season))
    # mean over the m seasonal means, each season once, taken from the seasons' first rows
    first = F.row_number().over(by_season.orderBy("q_idx")) == 1
    s = s.withColumn("_first", F.when(first, F.col("_sm")))
    centred = F.col("_sm") - F.avg("_first").over(W.partitionBy(*keys))
    return (
        s.withColumn("seasonal", centred)
        .withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_season", "_sm", "_first")
    )


def acf(df: DataFrame, keys: list[str], value: str, max_lag: int = 16) -> DataFrame:
    """Autocorrelations for lags 1..min(max_lag, n/2 - 1): one sort and one aggregation, no self-join."""
    rows = df.where(F.col(value).isNotNull())
    w = over_time(keys)
    whole = W.partitionBy(*keys)
    centred = rows.withColumn("_x", F.col(value) - F.avg(value).over(whole))
    lagged = centred.withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, max_lag + 1)})
    sums = [F.sum(F.col("_x") * F.col(f"_l{k}")).alias(str(k)) for k in range(1, max_lag + 1)]
    agg = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_x") * F.col("_x")).alias("_d"), *sums)
    names = [str(k) for k in range(1, max_lag + 1)]
    long = agg.unpivot([*keys, "_n", "_d"], names, "lag", "_s").withColumn("lag", F.col("lag").cast("int"))
    return long.where(F.col("lag") <= F.floor(F.col("_n") / 2) - 1).select(
        *keys, "lag", ratio("_s", "_d").alias("autocorrelation")
    )


def frequency_profile(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Rows, span, repeated dates and median spacing in days of raw observation dates.

    Counted per distinct day first; repeats add zero-day gaps by their count, so a hot series shuffles
    at most one row per day.
    """
    d = F.col(date).cast("date")
    days = df.groupBy(*keys, d.alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    gaps = days.where(F.col("_day").isNotNull()).withColumn(
        "_gap", F.date_diff("_day", F.lag("_day").over(W.partitionBy(*keys).orderBy("_day")))
    )
    summary = gaps.groupBy(*keys).agg(
        F.sum("_c").alias("rows"), F.min("_day").alias("start_date"), F.max("_day").alias("end_date"),
        F.sum(F.col("_c") - 1).alias("duplicate_dates"),
    )
    weights = gaps.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_gap").cast("double").alias("g"), F.lit(1).cast("bigint").alias("c")),
                F.struct(F.lit(0.0).alias("g"), (F.col("_c") - 1).alias("c")),
            )
        ).alias("w"),
    ).where(F.col("w.g").isNotNull() & (F.col("w.c") > 0))
    median = weights.groupBy(*keys).agg(
        F.percentile(F.col("w.g"), 0.5, F.col("w.c")).alias("median_spacing_days")
    )
    return summary.join(median, keys, "left")


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last n rows per group; the rank limit is applied before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_last_range(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    out = [F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}")]
    for c in cols:
        first, last = F.min_by(c, order), F.max_by(c, order)
        out += [
            first.alias(f"first_{c}"), last.alias(f"last_{c}"), (last - first).alias(f"change_{c}"),
            (F.max(c) - F.min(c)).alias(f"range_{c}"),
        ]
    return df.groupBy(*keys).agg(*out)


def even_sample(df: DataFrame, keys: list[str], period: str, n: int) -> DataFrame:
    """Rows of n evenly spaced distinct periods (positions round(i * (m - 1) / (n - 1)), half to even)."""
    periods = df.select(*keys, period).distinct()
    ranked = periods.withColumns(
        {
            "_i": F.row_number().over(W.partitionBy(*keys).orderBy(period)) - 1,
            "_m": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        }
    )
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / F.lit(float(max(n - 1, 1))))
    )
    keep = (F.col("_m") <= n) | F.array_contains(spots, F.col("_i").cast("double"))
    return df.join(ranked.where(keep).select(*keys, period), [*keys, period]).select(*df.columns)


def edges(df: DataFrame, keys: list[str], value: str, period: str = "q_idx") -> DataFrame:
    """First and latest period with a value, the latest value, and the largest value with its period."""
    filled = F.when(F.col(value).isNotNull(), F.col(period))
    return df.groupBy(*keys).agg(
        F.min(filled).alias("first_period"), F.max(filled).alias("last_period"),
        F.max_by(value, filled).alias("latest_value"), F.max(value).alias("peak_value"),
        F.max_by(period, F.struct(F.col(value), -F.col(period))).alias("peak_period"),
    )


def weighted_total(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("weighted_total"))


def nonzero_by_group(df: DataFrame, keys: list[str], value: str, eps: float = 1e-9) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.abs(value) > eps).alias("nonzero"), F.count(value).alias("terms")
    )


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))


def best_by_row(df: DataFrame, idx: list[str], name: str, value: str) -> DataFrame:
    """Name with the smallest value per row group, kept long; ties go to the smaller name."""
    return df.groupBy(*idx).agg(
        F.min_by(name, F.struct(F.col(value), F.col(name))).alias("best"), F.min(value).alias("best_value")
    )
