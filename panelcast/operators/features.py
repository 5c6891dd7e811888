"""Leakage-safe features on a panel with one row per entity and quarter.

All window features of one call share a single sort per entity. Lags are positional (previous stored
row); ``calendar=True`` takes the value of exactly k quarters before, NULL when that quarter is absent.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.numeric import finite, present, ratio, require_columns
from panelcast.operators.align import over_time
from panelcast.operators.skew import salted_join


def lag_of(c: str | Column, k: int, keys: list[str], calendar: bool = False) -> Column:
    if not calendar:
        return F.lag(c, k).over(over_time(keys))
    w = W.partitionBy(*keys).orderBy("q_idx").rangeBetween(-k, -k)
    return F.max(c).over(w)


def add_lags(df: DataFrame, keys: list[str], lag_map: Mapping[str, list[int]], calendar: bool = False) -> DataFrame:
    return df.withColumns(
        {f"{c}_lag{k}": lag_of(c, k, keys, calendar) for c in present(df, lag_map) for k in lag_map[c]}
    )


def add_growth(df: DataFrame, keys: list[str], spec: Mapping[str, str], calendar: bool = False) -> DataFrame:
    """Percent change of level columns; missing where the base is missing or zero, gaps never filled."""
    out = {}
    for src in present(df, spec):
        prev = lag_of(src, 1, keys, calendar)
        out[spec[src]] = ratio(F.col(src) - prev, prev) * 100
    return df.withColumns(out)


def add_change(df: DataFrame, keys: list[str], spec: Mapping[str, str], k: int = 1) -> DataFrame:
    return df.withColumns({spec[c]: F.col(c) - lag_of(c, k, keys) for c in present(df, spec)})


def change_over(df: DataFrame, keys: list[str], value: str, k: int = 4, out: str = "change") -> DataFrame:
    return add_change(df, keys, {value: out}, k)


def add_squares(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_sq": F.pow(F.col(c), 2) for c in present(df, cols)})


def add_interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns(
        {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns}
    )


def add_gap(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a) - F.col(b))


def event_leads(events: DataFrame) -> DataFrame:
    """Dummy names with their lead and whether all of their rows agree on it."""
    return events.groupBy("dummy_name").agg(
        F.min("lead_quarters").alias("lead_quarters"),
        (F.min("lead_quarters") == F.max("lead_quarters")).alias("consistent"),
    )


MAX_DUMMIES = 1000  # event names a table may have: each is a column


def add_event_dummies(df: DataFrame, events: DataFrame, on: list[str], names: Mapping[str, int] | None = None, spread: list[str] | None = None) -> DataFrame:
    """0/1 columns ``<name>_lag<lead>`` for quarters listed in the event table.

    The suffix records the lead; the dummy itself is not shifted. ``names`` (dummy -> lead) may be
    passed to choose among the event names; rows that disagree with a lead are an error either way.
    ``spread`` are the columns that tell the rows of a quarter apart, such as the entity keys.
    """
    require_columns(events, [*on, "dummy_name", "lead_quarters"], "event table")
    leads = event_leads(events).limit(MAX_DUMMIES + 1).collect()  # one row per dummy, checked before it is used
    if len(leads) > MAX_DUMMIES:
        raise ValueError(f"more than {MAX_DUMMIES} event names; each would be a column")
    bad = sorted(r.dummy_name for r in leads if not r.consistent)
    if bad:
        raise ValueError(f"rows must share one consistent lead_quarters value: {bad}")
    found = {r.dummy_name: r.lead_quarters for r in leads}
    if names is None:
        names = found
    elif other := sorted(n for n, lead in names.items() if n in found and found[n] != lead):
        raise ValueError(f"the event table has another lead_quarters for {other}")
    order = sorted(names)
    flags = events.groupBy(*on).agg(
        *[F.max((F.col("dummy_name") == n).cast("int")).alias(f"{n}_lag{int(names[n])}") for n in order]
    )
    # few quarters, possibly very many entities per quarter
    joined = salted_join(df, flags, on, spread, "left") if spread else df.join(flags, on, "left")
    return joined.fillna(0, subset=[f"{n}_lag{int(names[n])}" for n in order])


def label_regime(df: DataFrame, bounds: list[tuple[str, int | None, int | None]], idx: str = "q_idx") -> DataFrame:
    """Regime name by inclusive quarter bounds; open ends are None, outside every bound is NULL."""
    cases = []
    for name, lo, hi in bounds:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(idx) >= lo)
        if hi is not None:
            cond = cond & (F.col(idx) <= hi)
        cases.append(F.when(cond, F.lit(name)))
    return df.withColumn("regime", F.coalesce(*cases))


def log_diff_allowed(value: str, keys: list[str], share: float = 0.8) -> Column:
    whole = W.partitionBy(*keys)
    positive = F.count_if(F.col(value) > 0).over(whole)
    return positive >= F.lit(share) * F.count(value).over(whole)


def difference_variants(df: DataFrame, keys: list[str], value: str = "value", rate: Column | None = None) -> DataFrame:
    """First and second difference, and log difference where the series is (mostly) positive.

    ``rate`` marks series that are rates or growth already: they get no log difference.
    """
    w = over_time(keys)
    d1 = F.col(value) - F.lag(value).over(w)
    log_v = F.log(F.when(F.col(value) > 0, F.col(value)))
    allowed = log_diff_allowed(value, keys) & (~rate if rate is not None else F.lit(True))
    return (
        df.withColumns({"diff1": d1, "_lv": log_v, "_ok": allowed})
        .withColumns(
            {
                "diff2": F.col("diff1") - F.lag("diff1").over(w),
                "log_diff1": F.when(F.col("_ok"), F.col("_lv") - F.lag("_lv").over(w)),
            }
        )
        .drop("_lv", "_ok")
    )


def stationary_series(
    df: DataFrame, keys: list[str], orders: DataFrame, value: str = "value", min_log: int = 12,
    rate: Column | None = None,
) -> DataFrame:
    """The variant of each series that its integration order (``I(0)``/``I(1)``/``I(2)``) asks for."""
    v = difference_variants(df, keys, value, rate)
    on = [c for c in orders.columns if c in keys]
    j = v.join(orders, on, "left").withColumn("_nl", F.count("log_diff1").over(W.partitionBy(*keys)))
    pick = (
        F.when(F.col("integration_order") == "I(0)", F.col(value))
        .when(F.col("integration_order") == "I(2)", F.col("diff2"))
        .when(F.col("_nl") >= min_log, F.col("log_diff1"))
        .otherwise(F.col("diff1"))
    )
    return j.select(*keys, "q_idx", finite(pick).alias("stationary")).dropna(subset=["stationary"])


def zscore(df: DataFrame, keys: list[str], value: str = "value", ddof: int = 1, out: str = "z") -> DataFrame:
    """Z-score over the entity's full history; a constant series has no score."""
    whole = W.partitionBy(*keys)
    sd = (F.stddev_samp if ddof else F.stddev_pop)(value).over(whole)
    return df.withColumn(out, ratio(F.col(value) - F.avg(value).over(whole), F.nullif(sd, F.lit(0.0))))


def flag_outliers(df: DataFrame, keys: list[str], value: str = "value", threshold: float = 2.5) -> DataFrame:
    return zscore(df, keys, value, ddof=0).where(F.abs("z") >= threshold)


def flag_shocks(df: DataFrame, keys: list[str], value: str = "value", threshold: float = 2.0) -> DataFrame:
    scored = zscore(df, keys, value, ddof=1, out="shock_z")
    return scored.withColumn("flagged", F.coalesce(F.abs("shock_z") > threshold, F.lit(False)))


def expanding_mean(df: DataFrame, keys: list[str], value: str = "value", out: str = "expanding_mean") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(over_time(keys).rowsBetween(W.unboundedPreceding, 0)))


def expanding_scale(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Each row standardised with mean and population deviation of strictly earlier rows only.

    A zero deviation counts as 1, so a constant history leaves the centred value.
    """
    past = over_time(keys).rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for c in cols:
        sd = F.stddev_pop(c).over(past)
        out[f"{c}_scaled"] = (F.col(c) - F.avg(c).over(past)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns(out)


def direct_targets(df: DataFrame, keys: list[str], target: str, horizons: int) -> DataFrame:
    """Targets ``<target>_h1..H``: the value h stored rows ahead of the features."""
    w = over_time(keys)
    return df.withColumns({f"{target}_h{h}": F.lead(target, h).over(w) for h in range(1, horizons + 1)})


def time_series_folds(df: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """Chronological fold id per row: fold i is tested on its block after training on all rows before.

    The block length is ``n div (folds + 1)``; leading rows that are never tested have fold 0.
    """
    whole = W.partitionBy(*keys)
    numbered = df.withColumns(
        {"_rn": F.row_number().over(over_time(keys)), "_n": F.count(F.lit(1)).over(whole)}
    )
    size = F.floor(F.col("_n") / F.lit(folds + 1))
    into = F.col("_rn") - 1 - (F.col("_n") - folds * size)
    fold = F.when(into < 0, F.lit(0)).otherwise(F.floor(F.try_divide(into, size)) + 1)
    return numbered.withColumn("fold", F.coalesce(fold, F.lit(0)).cast("int")).drop("_rn", "_n")


def order_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, then lag features, then the rest."""
    head = present(df, preferred)
    lags = [c for c in df.columns if "_lag" in c and c not in head]
    return df.select(*head, *lags, *[c for c in df.columns if c not in head and c not in lags])
