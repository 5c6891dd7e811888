"""Walk-forward forecasts, common grids, metric tables and model comparison.

Prediction tables have one row per (keys, model, origin_q, horizon) with target_q, actual, forecast and
error = actual - forecast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelcast.functions.calendar import q_label
from panelcast.functions.numeric import close, ratio
from panelcast.operators.align import align_benchmark, over_time
from panelcast.operators.reshape import rank_of, stack_predictions

GRID = ["origin_q", "target_q", "horizon"]

# A forecaster gives the forecast column of one horizon, evaluated at the origin row.
Forecaster = Callable[[int], Column]


def seasonal_naive(value: str, keys: list[str], m: int = 4) -> Forecaster:
    """Repeats the last m values: horizon h takes the value m - 1 - (h - 1) % m rows before the origin."""
    return lambda h: F.lag(value, m - 1 - (h - 1) % m).over(over_time(keys))


def last_value(value: str, keys: list[str]) -> Forecaster:
    return lambda h: F.col(value)


def long_run_mean(value: str, keys: list[str]) -> Forecaster:
    return lambda h: F.avg(value).over(over_time(keys).rowsBetween(W.unboundedPreceding, 0))


def drift(value: str, keys: list[str]) -> Forecaster:
    w = over_time(keys).rowsBetween(W.unboundedPreceding, 0)
    first, n = F.first(value).over(w), F.count(value).over(w)
    return lambda h: F.col(value) + ratio((F.col(value) - first) * h, n - 1)


def walk_forward(
    df: DataFrame, keys: list[str], value: str, initial: int, horizons: list[int],
    forecasters: Mapping[str, Forecaster] | None = None, exog: list[str] | None = None,
    skip_origins: int = 0, max_origins: int | None = None,
) -> DataFrame:
    """Expanding-window backtest of expression forecasters over a shared grid.

    Origins run from row ``initial`` to the last row that still has every horizon ahead of it. Actuals and
    forecasts are window expressions on the origin row, so no training window is ever copied. Without
    forecasters the bare grid with actuals is returned. With ``exog`` an origin also needs ``initial``
    complete rows up to it, and ``skip_origins`` / ``max_origins`` cut the surviving origins into blocks.
    """
    if not horizons or min(horizons) < 1 or initial < 1:
        raise ValueError("horizons must be positive and initial at least 1")
    top = max(horizons)
    rows = df.where(F.col(value).isNotNull())
    w, whole = over_time(keys), W.partitionBy(*keys)
    fields = []
    for h in horizons:
        common = [
            F.lit(h).alias("horizon"), F.lead("q_idx", h).over(w).alias("target_q"),
            F.lead(value, h).over(w).cast("double").alias("actual"),
        ]
        if forecasters is None:
            fields.append(F.struct(*common))
        else:
            fields += [
                F.struct(F.lit(name).alias("model"), *common, f(h).cast("double").alias("forecast"))
                for name, f in forecasters.items()
            ]
    marked = rows.withColumns(
        {
            "_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole), "_cells": F.array(*fields),
        }
    )
    origins = (F.col("_rn") >= initial) & (F.col("_rn") <= F.col("_n") - top)
    if exog:
        complete = F.lit(True)
        for c in exog:
            complete = complete & F.col(c).isNotNull()
        usable = F.count_if(complete).over(w.rowsBetween(W.unboundedPreceding, 0))
        marked = marked.withColumn("_usable", usable)
        origins = origins & (F.col("_usable") >= initial)
    chosen = marked.where(origins)
    if skip_origins or max_origins is not None:
        chosen = chosen.withColumn("_o", F.row_number().over(w))
        keep = F.col("_o") > skip_origins
        if max_origins is not None:
            keep = keep & (F.col("_o") <= skip_origins + max_origins)
        chosen = chosen.where(keep)
    cells = chosen.select(*keys, F.col("q_idx").alias("origin_q"), F.explode("_cells").alias("_c"))
    out = cells.select(*keys, "origin_q", "_c.*")
    if forecasters is None:
        return out
    return out.withColumn("error", F.col("actual") - F.col("forecast"))


def walk_forward_groups(
    df: DataFrame, keys: list[str], value: str, initial: int, horizons: list[int],
    forecast: Callable, model: str,
) -> DataFrame:
    """Backtest of a Python forecaster ``forecast(history, steps) -> array`` that has no column form.

    One entity's history (one row per quarter, so bounded by the calendar) is handed to a task once and
    its origins are looped there; Spark spreads the entities.
    """
    top = max(horizons)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [T.StructField("model", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in GRID]
        + [T.StructField(c, T.DoubleType()) for c in ("actual", "forecast")]
    )

    def run(pdf):
        import pandas as pd

        pdf = pdf.dropna(subset=[value]).sort_values("q_idx")
        y, q = pdf[value].to_numpy(dtype=float), pdf["q_idx"].to_numpy()
        head = {k: pdf[k].iloc[0] for k in keys} if len(pdf) else {}
        out = []
        for pos in range(initial - 1, len(y) - top):
            path = forecast(y[: pos + 1], top)
            out += [
                {**head, "model": model, "origin_q": q[pos], "target_q": q[pos + h], "horizon": h,
                 "actual": y[pos + h], "forecast": float(path[h - 1])}
                for h in horizons
            ]
        return pd.DataFrame(out, columns=schema.fieldNames())

    rows = df.select(*keys, "q_idx", value)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0))
    return grouped.applyInPandas(run, schema).withColumn("error", F.col("actual") - F.col("forecast"))


def rolling_fixed_step_mse(df: DataFrame, keys: list[str], value: str, start: int, h: int, m: int = 4) -> DataFrame:
    """MSE of the seasonal random walk at a fixed step, over rows from position start + h - 1 on."""
    w = over_time(keys)
    rows = df.withColumns({"_rn": F.row_number().over(w), "_f": F.lag(value, m).over(w)})
    e = F.col(value) - F.col("_f")
    return rows.where((F.col("_rn") >= start + h) & F.col("_f").isNotNull()).groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse")
    )


def common_grid(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (origin, target, horizon) cells that every model of the entity has.

    Only complete rows count, and the number of models is taken among complete rows. With keys both
    counts are windows over the entity's partition (models x horizons x origins rows), so the backtest's
    own partitioning is reused and nothing is shuffled again.
    """
    complete = pred.dropna(subset=["actual", "forecast", "error"])
    if keys:
        models = lambda by: F.size(F.collect_set("model").over(W.partitionBy(*by)))
        counted = complete.withColumns({"_all": models(keys), "_m": models([*keys, *GRID])})
        return counted.where(F.col("_m") == F.col("_all")).drop("_all", "_m")
    cells = complete.groupBy(*GRID).agg(F.count_distinct("model").alias("_m"))
    total = complete.agg(F.count_distinct("model")).scalar()
    keep = cells.where(F.col("_m") == total).select(*GRID)
    return complete.join(keep, GRID, "left_semi")


def with_overall(
    detail: DataFrame, ids: list[str], sums: list[str], sets: tuple[str, ...] = (), horizon_only: tuple[str, ...] = (),
) -> DataFrame:
    """Per-horizon rows plus one overall row per id (horizon NULL): sums added, array columns united,
    ``horizon_only`` columns left missing.

    The few horizon rows of an id travel as one array, so the input is evaluated once.
    """
    kept, blank = [*sums, *sets], [F.lit(None).cast(detail.schema[c].dataType).alias(c) for c in horizon_only]
    overall = [F.sum(c).alias(f"_{c}") for c in sums] + [
        F.array_distinct(F.flatten(F.collect_list(c))).alias(f"_{c}") for c in sets
    ]
    packed = detail.groupBy(*ids).agg(
        F.collect_list(F.struct(F.col("horizon").cast("int").alias("horizon"), *kept, *horizon_only)).alias("_h"), *overall
    )
    total = F.struct(F.lit(None).cast("int").alias("horizon"), *[F.col(f"_{c}").alias(c) for c in kept], *blank)
    rows = packed.select(*ids, F.inline(F.concat("_h", F.array(total))))
    return rows.withColumn("grain", F.when(F.col("horizon").isNull(), "overall").otherwise("horizon"))


def _errors_by_horizon(pred: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    e = F.col("error")
    return pred.where(e.isNotNull()).groupBy(*keys, "model", "horizon").agg(
        F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), *extra
    )


RMSE = "sqrt(sse / n) AS rmse"
MAE = "sae / n AS mae"


def metric_table(pred: DataFrame, keys: list[str]) -> DataFrame:
    """n, RMSE and MAE per model, overall and per horizon."""
    both = with_overall(_errors_by_horizon(pred, keys), [*keys, "model"], ["n", "sse", "sae"])
    return both.selectExpr(*keys, "model", "grain", "horizon", "n", RMSE, MAE)


def horizon_label(horizons: Column) -> Column:
    """A sorted array of horizons as ``1-8``, ``3`` or ``1,3``."""
    lo, hi, n = F.array_min(horizons), F.array_max(horizons), F.size(horizons)
    text = lambda c: c.cast("string")
    return (
        F.when(n == 0, F.lit("none"))
        .when(n == 1, text(lo))
        .when(hi - lo + 1 == n, F.concat(text(lo), F.lit("-"), text(hi)))
        .otherwise(F.array_join(F.transform(horizons, text), ","))
    )


def metric_report(pred: DataFrame, keys: list[str], grid_name: str, status: str = "evaluated") -> DataFrame:
    """Metric table with origin counts (overall and per horizon) and each model's evaluated horizons."""
    ids = [*keys, "model"]
    h = F.col("horizon").cast("int")
    detail = _errors_by_horizon(pred, keys, F.collect_set("origin_q").alias("origins")).withColumn(
        "horizons", F.array(h)
    )
    both = with_overall(detail, ids, ["n", "sse", "sae"], ("origins", "horizons"))
    span = F.max(F.when(F.col("grain") == "overall", horizon_label(F.array_sort("horizons"))))
    return both.withColumn("evaluated_horizons", span.over(W.partitionBy(*ids))).select(
        *ids, "grain", "horizon", "n", F.expr(RMSE), F.expr(MAE), F.lit(grid_name).alias("comparison_grid"),
        F.lit(status).alias("evaluation_status"), F.size("origins").cast("bigint").alias("forecast_origin_n"),
        "evaluated_horizons",
    )


def assign_best(metrics: DataFrame, keys: list[str], model_order: list[str], full_label: str) -> DataFrame:
    """Lowest-RMSE model per horizon; overall only among models evaluated on every horizon.

    Ties go to the model listed first; they are judged at 9 decimals because distributed sums of equal
    errors may differ in their last bits. Metric tables are already reduced, so the window over one
    (keys, horizon) cell holds one row per model.
    """
    ok = F.col("rmse").isNotNull() & (
        (F.col("grain") != "overall") | (F.col("evaluated_horizons") == full_label)
    )
    rank = F.when(ok, F.struct(F.round("rmse", 9), rank_of("model", model_order), F.col("model")))
    w = W.partitionBy(*keys, "grain", "horizon")
    return metrics.withColumn("best_model", F.min_by("model", rank).over(w))


def model_comparison(
    preds: list[DataFrame], keys: list[str], horizons: list[int], model_order: list[str], grid_name: str = "shared_grid",
) -> DataFrame:
    """Common grid, metrics, grid metadata and best model in one report."""
    common = common_grid(stack_predictions(preds), keys)
    table = metric_report(common, keys, grid_name)
    hs = sorted(horizons)
    label = (
        str(hs[0]) if len(hs) == 1
        else f"{hs[0]}-{hs[-1]}" if hs == list(range(hs[0], hs[-1] + 1)) else ",".join(map(str, hs))
    )
    return assign_best(table, keys, model_order, label)


def report_order(metrics: DataFrame, keys: list[str], model_order: list[str]) -> DataFrame:
    """Sorted by horizon (overall first), then by the fixed model rank."""
    return metrics.orderBy(*keys, F.coalesce("horizon", F.lit(0)), rank_of("model", model_order), "model")


def order_by_model(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.orderBy(*keys, "model", F.coalesce("horizon", F.lit(0)))


def overall_slice(table: DataFrame, exclude: list[str], cols: list[str]) -> DataFrame:
    return table.where((F.col("grain") == "overall") & ~F.col("model").isin(*exclude)).select(*cols)


def combine_models(
    a: DataFrame, b: DataFrame, keys: list[str], weight: float = 0.5, model: str = "ensemble",
) -> DataFrame:
    """Weighted average of two prediction tables on shared cells; ``actuals_agree`` flags a mismatch."""
    on = [*keys, *GRID]
    right = b.select(*on, F.col("actual").alias("_actual"), F.col("forecast").alias("_forecast"))
    j = a.select(*on, "actual", "forecast").join(right, on)
    f = F.lit(weight) * F.col("forecast") + F.lit(1.0 - weight) * F.col("_forecast")
    return j.select(
        *keys, F.lit(model).alias("model"), *GRID, "actual", f.alias("forecast"),
        (F.col("actual") - f).alias("error"), close("actual", "_actual").alias("actuals_agree"),
    )


def assert_actuals_agree(combined: DataFrame) -> None:
    if not combined.where(~F.col("actuals_agree")).isEmpty():
        raise ValueError("the combined models disagree on actual values")


def _pair_errors(pred: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    cell = lambda m: F.max(F.when(F.col("model") == m, F.col("forecast")))
    return (
        pred.where(F.col("model").isin(a, b))
        .groupBy(*keys, *GRID)
        .agg(F.max("actual").alias("actual"), cell(a).alias("_fa"), cell(b).alias("_fb"))
        .dropna(subset=["_fa", "_fb", "actual"])
        .withColumns({"_a": F.col("_fa") - F.col("actual"), "_b": F.col("_fb") - F.col("actual")})
    )


def _grid_weight(saa: Column, sab: Column, sbb: Column, points: int = 101) -> Column:
    """Weight of the first model on an even grid that minimises the squared error.

    The error is a parabola in the weight, so the best grid point is the one nearest its vertex (the
    smaller one half-way); three sums replace the scan over weights.
    """
    steps = points - 1
    vertex = F.try_divide(sbb - sab, saa - 2 * sab + sbb)
    snapped = F.ceil(F.round(vertex * steps, 9) - 0.5) / F.lit(float(steps))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), snapped)), F.lit(0.0))


def best_weight_hindsight(pred: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    e = _pair_errors(pred, keys, a, b)
    s = e.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_a") * F.col("_a")).alias("saa"),
        F.sum(F.col("_a") * F.col("_b")).alias("sab"), F.sum(F.col("_b") * F.col("_b")).alias("sbb"),
    )
    return s.select(*keys, "horizon", "n", _grid_weight(F.col("saa"), F.col("sab"), F.col("sbb")).alias("weight"))


def best_weight_real_time(pred: DataFrame, keys: list[str], a: str, b: str, min_past: int = 8) -> DataFrame:
    """Weight per origin and horizon from errors whose target quarter was known at the origin.

    Every error enters the stream at its target quarter and is asked for at its origin quarter; running
    sums over that stream give each origin exactly the known errors. Fewer than ``min_past`` give no row.
    """
    e = _pair_errors(pred, keys, a, b)
    zero = F.lit(0.0)
    known = e.select(
        *keys, "horizon", F.col("target_q").alias("_t"), F.lit(0).alias("_ask"), F.lit(1).alias("_one"),
        (F.col("_a") * F.col("_a")).alias("saa"), (F.col("_a") * F.col("_b")).alias("sab"),
        (F.col("_b") * F.col("_b")).alias("sbb"), F.lit(None).cast("double").alias("actual"),
        F.lit(None).cast("double").alias("_fa"), F.lit(None).cast("double").alias("_fb"),
        F.lit(None).cast("int").alias("target_q"),
    )
    asked = e.select(
        *keys, "horizon", F.col("origin_q").alias("_t"), F.lit(1).alias("_ask"), F.lit(0).alias("_one"),
        zero.alias("saa"), zero.alias("sab"), zero.alias("sbb"), "actual", "_fa", "_fb", "target_q",
    )
    w = W.partitionBy(*keys, "horizon").orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    run = known.unionByName(asked).withColumns(
        {"n": F.sum("_one").over(w), **{c: F.sum(c).over(w) for c in ("saa", "sab", "sbb")}}
    )
    out = run.where((F.col("_ask") == 1) & (F.col("n") >= min_past)).withColumn(
        "weight", _grid_weight(F.col("saa"), F.col("sab"), F.col("sbb"))
    )
    f = F.col("weight") * F.col("_fa") + (1 - F.col("weight")) * F.col("_fb")
    return out.select(
        *keys, F.col("_t").alias("origin_q"), "target_q", "horizon", "n", "weight", "actual", f.alias("forecast"),
        (F.col("actual") - f).alias("error"),
    )


def baselines(
    df: DataFrame, keys: list[str], value: str, initial: int, horizons: list[int],
    bench: DataFrame | None = None, bench_keys: list[str] | None = None,
) -> DataFrame:
    """Seasonal naive, stacked with the aligned outside benchmark when one is given."""
    naive = walk_forward(df, keys, value, initial, horizons, {"seasonal_naive": seasonal_naive(value, keys)})
    if bench is None:
        return naive
    return stack_predictions([naive, align_benchmark(bench, naive, bench_keys or keys, horizons)])


def benchmark_gap(pred: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """Model errors against the model's actual beside the benchmark's errors against its own actual."""
    b = bench.select(
        *keys, *GRID, F.col("benchmark_actual"), F.col("benchmark_reported_error"),
    )
    j = pred.join(b, [*keys, *GRID])
    return j.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("origin_q").alias("origins"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.sqrt(F.avg(F.col("benchmark_reported_error") * F.col("benchmark_reported_error"))).alias("benchmark_rmse"),
        F.avg(F.abs(F.col("benchmark_actual") - F.col("actual"))).alias("mean_basis_gap"),
        F.max(F.abs(F.col("benchmark_actual") - F.col("actual"))).alias("max_basis_gap"),
    )


def compare_variants(a: DataFrame, b: DataFrame, keys: list[str], a_name: str, b_name: str) -> DataFrame:
    """RMSE of two variants of one model on shared cells, percent change, and origins only one has."""
    on = [*keys, *GRID]
    both = a.select(*on, F.col("error").alias("_ea")).join(
        b.select(*on, F.col("error").alias("_eb")), on, "full_outer"
    ).withColumn("_both", F.col("_ea").isNotNull() & F.col("_eb").isNotNull())
    per_origin = both.groupBy(*keys, "origin_q", "horizon").agg(
        F.sum(F.when(F.col("_both"), F.col("_ea") * F.col("_ea"))).alias("sa"),
        F.sum(F.when(F.col("_both"), F.col("_eb") * F.col("_eb"))).alias("sb"),
        F.count_if("_both").alias("n"),
        F.max(F.col("_ea").isNotNull()).alias("ha"), F.max(F.col("_eb").isNotNull()).alias("hb"),
    )
    t = per_origin.groupBy(*keys, "horizon").agg(
        F.sum("n").alias("n"), F.sqrt(ratio(F.sum("sa"), F.sum("n"))).alias(f"rmse_{a_name}"),
        F.sqrt(ratio(F.sum("sb"), F.sum("n"))).alias(f"rmse_{b_name}"),
        F.count_if(F.col("ha") & ~F.col("hb")).alias(f"origins_only_{a_name}"),
        F.count_if(F.col("hb") & ~F.col("ha")).alias(f"origins_only_{b_name}"),
    )
    return t.withColumn(
        "rmse_change_pct", ratio(F.col(f"rmse_{b_name}") - F.col(f"rmse_{a_name}"), F.col(f"rmse_{a_name}")) * 100
    )


def with_labels(pred: DataFrame) -> DataFrame:
    """Display labels for the integer quarters of a prediction table."""
    return pred.withColumns({"forecast_origin": q_label("origin_q"), "target_quarter": q_label("target_q")})
