"""Long tables of simulated draws: (keys, model, origin_q, draw_id, horizon, value).

A draw is a row, never an array element, so every summary is a grouped aggregate; quantiles go through
``exact_quantiles`` and therefore hold for groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.operators.bootstrap import draw_index
from panelcast.operators.skew import exact_quantiles, salted_join

FAN = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def fan(draws: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    return exact_quantiles(draws, ids, value, FAN)


def interval(draws: DataFrame, ids: list[str], lo: float, hi: float, value: str = "value") -> DataFrame:
    """Lower and upper quantile, median and mean."""
    return exact_quantiles(draws, ids, value, {"lower": lo, "median": 0.5, "upper": hi}, with_mean=True)


def sample_paths(draws: DataFrame, ids: list[str], n: int, seed: int, draw: str = "draw_id") -> DataFrame:
    """n whole paths per group, renumbered from 0 in draw order.

    Paths are ranked by an md5 of their id; the per-group limit is applied before the shuffle too.
    """
    paths = draws.select(*ids, draw).distinct()
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(draw).cast("string")).cast("binary"))
    w = W.partitionBy(*ids).orderBy("_k", draw)
    chosen = paths.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    numbered = chosen.select(
        *ids, draw, (F.row_number().over(W.partitionBy(*ids).orderBy(draw)) - 1).alias("path")
    )
    return draws.join(numbered, [*ids, draw])


def combine_draws(a: DataFrame, b: DataFrame, on: list[str], weight: float = 0.5, value: str = "value") -> DataFrame:
    """Weighted average of paired draws (same draw id and horizon)."""
    j = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    return j.select(*on, (weight * F.col("_a") + (1.0 - weight) * F.col("_b")).alias(value))


def recenter(draws: DataFrame, point: DataFrame | None, ids: list[str], target: str, spread: list[str], value: str = "value") -> DataFrame:
    """Shift each group's draws so that their median equals the given point; the spread is unchanged.

    Without ``point`` the target is the group's mean, taken from the same counted values as the median.
    ``spread`` tells the draws of a group apart (draw id, horizon). NULL ids are groups like any other.
    """
    med = exact_quantiles(draws, ids, value, {"_m": 0.5}, with_mean=point is None)
    key = F.struct(*ids) if ids else F.struct(F.lit(0).alias("all"))
    if point is None:
        shift = med.select(key.alias("_k"), (F.col("mean") - F.col("_m")).alias("_s"))
    else:
        aim = point.select(key.alias("_k"), F.col(target).alias("_t"))
        shift = med.select(key.alias("_k"), "_m").join(aim, "_k").select("_k", (F.col("_t") - F.col("_m")).alias("_s"))
    moved = salted_join(draws.withColumn("_k", key), shift, ["_k"], spread)
    return moved.withColumn(value, F.col(value) + F.col("_s")).select(*draws.columns)


def band_probabilities(draws: DataFrame, ids: list[str], lo: float, hi: float, value: str = "value") -> DataFrame:
    cut = F.avg((F.col(value) < lo).cast("double"))
    hike = F.avg((F.col(value) > hi).cast("double"))
    return draws.groupBy(*ids).agg(cut.alias("p_cut"), hike.alias("p_hike")).withColumn(
        "p_hold", 1.0 - F.col("p_cut") - F.col("p_hike")
    )


def cumulative_change_quantiles(
    draws: DataFrame, level: DataFrame, ids: list[str], h: int, qs: dict[str, float], level_col: str,
    value: str = "value",
) -> DataFrame:
    """Quantiles of the change from the current level to horizon h.

    Subtracting a per-group constant keeps the order, so quantiles are taken first and the level after:
    the draws themselves are never joined.
    """
    q = exact_quantiles(draws.where(F.col("horizon") == h), ids, value, qs)
    j = q.join(level.select(*ids, level_col), ids)
    return j.select(*ids, *[(F.col(n) - F.col(level_col)).alias(n) for n in qs])


def response_per_unit(irf: DataFrame, ids: list[str], shock: str) -> DataFrame:
    """Responses divided by the shocked variable's own impact at horizon 0 of the same draw."""
    rows = irf.where(F.col("shock") == shock)
    own = rows.where((F.col("horizon") == 0) & (F.col("response") == shock)).select(
        *ids, "draw_id", F.col("value").alias("_own")
    )
    return rows.join(own, [*ids, "draw_id"]).withColumn("value", F.col("value") / F.col("_own")).drop("_own")


def scenario(
    draws: DataFrame, irf: DataFrame, expected: DataFrame, ids: list[str], response: str, shock: str,
    shock_value: Column | float,
) -> DataFrame:
    """Baseline draws plus surprise times the per-unit response of the same draw.

    The surprise is the shock value minus the expected first-step value, the shock lands at step 1, so
    horizon h takes the response at h - 1.
    """
    sv = shock_value if isinstance(shock_value, Column) else F.lit(float(shock_value))
    size = expected.select(*ids, (sv - F.col("expected")).alias("shock_size"))
    unit = response_per_unit(irf, ids, shock).where(F.col("response") == response).select(
        *ids, "draw_id", (F.col("horizon") + 1).alias("horizon"), F.col("value").alias("_r")
    )
    base = draws.join(unit, [*ids, "draw_id", "horizon"])
    j = salted_join(base, size, ids, ["draw_id", "horizon"])
    c = F.col("shock_size") * F.col("_r")
    return j.withColumns({"contribution": c, "combined": F.col("value") + c}).drop("_r")


def residual_paths(
    point: DataFrame, resid: DataFrame, keys: list[str], horizons: list[int], n: int, seed: int,
) -> DataFrame:
    """Paths of point forecast plus a resampled, median-centred residual row.

    A draw takes all horizons of one origin, so the residuals stay correlated across horizons; only
    origins with every horizon are used. ``resid`` has (keys, origin_q, horizon, residual).
    """
    need = len(horizons)
    rows = resid.where(F.col("horizon").isin(*horizons) & F.col("residual").isNotNull())
    full = rows.groupBy(*keys, "origin_q").agg(
        F.count_distinct("horizon").alias("_h"),
        F.array_sort(F.collect_list(F.struct("horizon", "residual"))).alias("_r"),
    ).where(F.col("_h") == need)
    # one array of whole residual rows per entity; its length is the number of origins
    packed = full.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("origin_q", "_r"))).alias("_u"))
    med = full.select(*keys, F.inline("_r")).groupBy(*keys, "horizon").agg(F.median("residual").alias("_m"))
    row = lambda d: F.get(F.col("_u"), draw_index(seed, d, F.lit(0), F.size("_u")).cast("int"))
    made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.struct(d.alias("draw_id"), row(d).alias("_x")))
    drawn = packed.select(*keys, F.inline(made)).select(*keys, "draw_id", F.col("_x.origin_q").alias("source_q"), F.col("_x._r").alias("_r"))
    long = drawn.select(*keys, "draw_id", "source_q", F.inline("_r"))
    centred = long.join(med, [*keys, "horizon"]).select(
        *keys, "draw_id", "source_q", "horizon", (F.col("residual") - F.col("_m")).alias("_e")
    )
    j = centred.join(point.select(*keys, "horizon", "forecast"), [*keys, "horizon"])
    return j.select(
        *keys, "draw_id", "source_q", "horizon", (F.col("forecast") + F.col("_e")).alias("value")
    )


def convolve(irf: DataFrame, shocks: DataFrame, keys: list[str], periods: int | None = None) -> DataFrame:
    """contribution[t] = sum over h of irf[h] * shock[t - h], per response and shock.

    An equi-join on the shock gives each shock quarter its responses at every later quarter; partial sums
    combine map-side. ``irf`` has (keys, response, shock, horizon, value), ``shocks`` (keys, shock, q_idx, value).
    """
    r = irf if periods is None else irf.where(F.col("horizon") < periods)
    end = F.max("q_idx").over(W.partitionBy(*keys))
    j = shocks.select(*keys, "shock", "q_idx", F.col("value").alias("_s"), end.alias("_end")).join(
        r.select(*keys, "shock", "response", "horizon", F.col("value").alias("_r")), [*keys, "shock"]
    )
    t = (F.col("q_idx") + F.col("horizon")).cast("int")
    return (
        j.where(t <= F.col("_end"))
        .groupBy(*keys, t.alias("q_idx"), "response", "shock")
        .agg(F.sum(F.col("_r") * F.col("_s")).alias("contribution"))
    )
