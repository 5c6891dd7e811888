"""Calendar alignment: raw observations to quarters, many series to one table, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.calendar import q_idx, q_label
from panelcast.functions.numeric import close, require_columns, to_number


def over_time(keys: list[str], order: str = "q_idx"):
    """Window over one entity's history. Panels hold one row per entity and period, so a frame is
    bounded by the calendar however large the entity's raw data is."""
    return W.partitionBy(*keys).orderBy(order)


def resample(
    df: DataFrame, keys: list[str], date: str, value: str, how: str = "mean",
    spec: DataFrame | None = None,
) -> DataFrame:
    """One row per key and quarter by mean, last non-missing value or sum.

    With ``spec`` (columns ``*keys``, ``agg``) each series uses its own rule. All three rules combine
    map-side, so a series holding most of the rows does not load one task.
    """
    v = to_number(value)
    aggs = {
        "mean": F.avg(v),
        "last": F.max(F.when(v.isNotNull(), F.struct(F.col(date).alias("d"), v.alias("v"))))["v"],
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
    }
    keyed = df.withColumn("q_idx", q_idx(date)).where(F.col("q_idx").isNotNull())
    if spec is None:
        if how not in aggs:
            raise ValueError(f"Unsupported aggregation: {how}")
        out = keyed.groupBy(*keys, "q_idx").agg(aggs[how].alias("value"))
    else:
        wide = keyed.groupBy(*keys, "q_idx").agg(*[e.alias(f"_{n}") for n, e in aggs.items()])
        choice = F.when(F.col("agg") == "mean", F.col("_mean")).when(F.col("agg") == "last", F.col("_last")).when(
            F.col("agg") == "sum", F.col("_sum")
        )
        shared = [c for c in spec.columns if c in keys]
        out = wide.join(spec, shared).select(*keys, "q_idx", choice.alias("value"))
    return out.withColumn("quarter", q_label("q_idx"))


def merge_series(long: DataFrame, keys: list[str], names: list[str], series: str = "series_id", others: bool = False) -> DataFrame:
    """Outer merge of many series on the quarter as one grouped pivot (a single shuffle).

    A series that ``names`` does not list is an error (found in a pass over the reduced table), unless ``others``
    says that it may be left out.
    """
    if not others:
        unlisted = long.where(~F.col(series).isin(*names)).select(series).distinct().limit(5).collect()
        if unlisted:
            raise ValueError(f"series that are not merged: {sorted(str(r[0]) for r in unlisted)}")
    cells = [F.max(F.when(F.col(series) == n, F.col("value"))).alias(n) for n in names]
    return (
        long.where(F.col(series).isin(*names))
        .groupBy(*keys, "q_idx")
        .agg(*cells)
        .withColumn("quarter", q_label("q_idx"))
    )


def labelled_sample(
    pred: DataFrame, panel: DataFrame, keys: list[str], model: str, horizon: int,
    feature: str, required: list[str], check: bool = True,
) -> DataFrame:
    """Forecasts of one model and horizon joined to their target quarter's row; complete rows only.

    ``check`` refuses repeated forecasts of one target quarter (one small action).
    """
    chosen = pred.where((F.col("model") == model) & (F.col("horizon") == horizon)).select(
        *keys, F.col("target_q").alias("q_idx"), F.col("forecast").alias(feature)
    )
    if check:
        from panelcast.operators.quality import assert_unique

        assert_unique(chosen, [*keys, "q_idx"], f"{model} horizon {horizon} forecasts")
    return chosen.join(panel, [*keys, "q_idx"]).dropna(subset=[feature, *required])


def align_benchmark(
    bench: DataFrame, grid: DataFrame, keys: list[str], horizons: list[int], model: str = "benchmark",
) -> DataFrame:
    """Dated outside forecasts placed on the (origin, horizon) grid; the latest of an origin wins."""
    require_columns(bench, ["forecast_date", "horizon_quarters", "benchmark_forecast"])
    extra = [c for c in ("benchmark_actual", "benchmark_reported_error") if c in bench.columns]
    d = F.col("forecast_date").try_cast("date")
    usable = (
        bench.withColumn("_d", d)
        .where(
            F.col("_d").isNotNull()
            & F.col("horizon_quarters").isin(*horizons)
            & F.col("benchmark_forecast").isNotNull()
        )
        .withColumn("origin_q", q_idx("_d"))
    )
    payload = F.struct("benchmark_forecast", *extra)
    latest = usable.groupBy(*keys, "origin_q", F.col("horizon_quarters").cast("int").alias("horizon")).agg(
        F.max_by(payload, F.struct("_d", payload)).alias("_r")
    )
    joined = grid.select(*keys, "origin_q", "target_q", "horizon", "actual").join(
        latest, [*keys, "origin_q", "horizon"]
    )
    forecast = F.col("_r.benchmark_forecast")
    return joined.select(
        *keys, F.lit(model).alias("model"), "origin_q", "target_q", "horizon", "actual",
        forecast.alias("forecast"), (F.col("actual") - forecast).alias("error"),
        *[F.col(f"_r.{c}").alias(c) for c in extra],
    )


def asof_latest(
    df: DataFrame, keys: list[str], cols: list[str], origins: DataFrame, fallback: bool = False,
) -> DataFrame:
    """For every (keys, origin_q): the latest row with all ``cols`` present at or before the origin.

    Origins and rows share one sorted stream per entity, so there is no range join. With ``fallback``
    an origin that precedes every complete row takes the entity's latest complete row.
    """
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    rows = df.select(
        *keys, F.col("q_idx").alias("_t"), F.lit(0).alias("_is_origin"),
        F.when(complete, F.struct(F.col("q_idx").alias("asof_q"), *cols)).alias("_r"),
    )
    marks = origins.select(
        *keys, F.col("origin_q").alias("_t"), F.lit(1).alias("_is_origin"),
        F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"),
    )
    w = W.partitionBy(*keys).orderBy("_t", "_is_origin").rowsBetween(W.unboundedPreceding, 0)
    # an origin row sorts after the data row of the same quarter
    merged = rows.unionByName(marks).withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    if fallback:
        whole = W.partitionBy(*keys)
        merged = merged.withColumn(
            "_hit", F.coalesce("_hit", F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).over(whole))
        )
    return (
        merged.where("_is_origin = 1")
        .select(*keys, F.col("_t").alias("origin_q"), "_hit.asof_q", *[F.col(f"_hit.{c}").alias(c) for c in cols])
    )


def origin_row(df: DataFrame, keys: list[str], cols: list[str], targets: DataFrame) -> DataFrame:
    """Inputs of the quarter before each target, with a flag for missing or incomplete inputs."""
    prev = targets.select(*keys, "target_q", (F.col("target_q") - 1).alias("q_idx"))
    joined = prev.join(df.select(*keys, "q_idx", *cols), [*keys, "q_idx"], "left")
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return joined.withColumn("inputs_complete", ok)


def join_close(
    left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, how: str = "inner",
) -> DataFrame:
    """Equi-join plus a float tolerance on one pair of columns."""
    cond = close(F.col(f"l.{a}"), F.col(f"r.{b}"))
    for c in on:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    joined = left.alias("l").join(right.alias("r"), cond, how)
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in left.columns],
        *[F.col(f"r.{c}").alias(c) for c in right.columns if c not in on and c not in left.columns],
    )


def trailing_pairs(
    origins: DataFrame, rows: DataFrame, keys: list[str], origin: str, time: str, width: int,
) -> DataFrame:
    """Rows whose period lies in (origin - width, origin], as an equi-join on exploded offsets.

    The window width bounds the fan-out, and no range condition is left to a nested loop.
    """
    spread = origins.withColumn(
        time, F.explode(F.sequence(F.col(origin) - F.lit(width - 1), F.col(origin)))
    )
    return spread.join(rows, [*keys, time])


def join_summaries(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left")


def bridge_history(history: DataFrame, forecast: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last observed point of each entity put in front of its forecast rows."""
    last = history.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("q_idx", value), "q_idx").alias("_l")
    )
    head = last.select(
        *keys, F.col("_l.q_idx").alias("q_idx"), F.col(f"_l.{value}").alias("value"),
        F.lit("history").alias("part"),
    )
    body = forecast.select(
        *keys, F.col("target_q").alias("q_idx"), F.col("forecast").alias("value"),
        F.lit("forecast").alias("part"),
    )
    return head.unionByName(body)


def reconcile(
    derived: DataFrame, curated: DataFrame, keys: list[str], tol: float = 1e-8,
) -> DataFrame:
    """Values rebuilt from raw data against the stored table, for every quarter."""
    j = derived.select(*keys, "q_idx", F.col("value").alias("derived")).join(
        curated.select(*keys, "q_idx", F.col("value").alias("stored")), [*keys, "q_idx"], "full_outer"
    )
    same = close("derived", "stored", tol, tol)
    both_missing = F.col("derived").isNull() & F.col("stored").isNull()
    return j.withColumn("matches", F.coalesce(same, both_missing))


def calendar_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Quarters between each entity's first and last one that have no row."""
    span = df.groupBy(*keys).agg(F.min("q_idx").alias("_a"), F.max("q_idx").alias("_b"))
    full = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("q_idx"))
    return full.join(df.select(*keys, "q_idx").distinct(), [*keys, "q_idx"], "left_anti")
