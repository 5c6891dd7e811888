"""Deterministic resampling with replacement and paired bootstrap gaps.

The position drawn for (seed, replicate, slot) is an md5 remainder, so a rerun, a retried task or another
engine draws the same rows. The position has no key in it: entities with equally many units draw alike, as paired
comparisons across entities need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


BLOCK = 100  # replicates that one row of packed units makes


def draw_index(seed: int, rep: Column, slot: Column, n: Column) -> Column:
    """0-based position: the first 32 bits of md5("seed:rep:slot") modulo n."""
    text = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def resample(units: DataFrame, keys: list[str], order: str, reps: int, seed: int) -> DataFrame:
    """``reps`` resamples of each key's units (rows with rep and slot), as many slots as units."""
    whole = W.partitionBy(*keys)
    numbered = units.withColumns(
        {"_i": (F.row_number().over(whole.orderBy(order)) - 1).cast("bigint"), "_n": F.count(F.lit(1)).over(whole)}
    )
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = sizes.select(
        *keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    ).select(*keys, "_n", "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("slot"))
    picks = slots.withColumn("_i", draw_index(seed, F.col("rep"), F.col("slot"), F.col("_n"))).drop("_n")
    return picks.join(numbered.drop("_n"), [*keys, "_i"]).drop("_i")


def _packed_reps(units: DataFrame, keys: list[str], order: str, stats: list[str], reps: int, seed: int) -> DataFrame:
    """Per key and replicate the sums of ``stats`` over a resample of the key's units.

    A key's units (one per origin or period, bounded by the calendar) travel as one array, so all
    replicates are computed after a single shuffle and no resampled row is materialised.
    """
    packed = units.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, F.array(*[F.col(c).cast("double") for c in stats]).alias("v")))).alias("_u")
    )
    last, n = F.lit(reps - 1), F.size("_u")
    blocks = packed.select(*keys, "_u", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK))).alias("_b"))
    # a few replicates per task also where one group holds all units
    blocks = blocks.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_b")
    zero = F.array(*[F.lit(0.0)] * len(stats))

    def total(rep: Column) -> Column:
        picks = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.get(F.col("_u"), draw_index(seed, rep, s, n).cast("int"))["v"])
        return F.aggregate(picks, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))

    # replicates are made inside the row, so the units are not copied for each of them
    summed = F.transform(F.sequence(F.col("_b"), F.least(F.col("_b") + (BLOCK - 1), last)), lambda rep: F.struct(rep.alias("rep"), total(rep).alias("_t")))
    out = blocks.select(*keys, F.inline(summed))
    return out.select(*keys, "rep", *[F.col("_t")[i].alias(c) for i, c in enumerate(stats)])


def bootstrap_gap(
    pred: DataFrame, keys: list[str], a: str, b: str, reps: int = 2000, seed: int = 42,
    error_a: str = "error", error_b: str = "error", other: DataFrame | None = None,
) -> DataFrame:
    """Paired bootstrap of RMSE(a) - RMSE(b), resampling whole forecast origins.

    Both models come from ``pred``, or model b's error column from ``other`` on the same cells.
    """
    cell = [*keys, "origin_q", "horizon"]
    left = pred.where(F.col("model") == a).select(*cell, F.col(error_a).alias("_ea"))
    source = other if other is not None else pred.where(F.col("model") == b)
    right = source.select(*cell, F.col(error_b).alias("_eb"))
    per_origin = (
        left.join(right, cell)
        .dropna(subset=["_ea", "_eb"])
        .groupBy(*keys, "origin_q")
        .agg(
            F.sum(F.col("_ea") * F.col("_ea")).alias("sse_a"), F.sum(F.col("_eb") * F.col("_eb")).alias("sse_b"),
            F.count(F.lit(1)).alias("cells"),
        )
    )
    gap = F.sqrt(F.col("sse_a") / F.col("cells")) - F.sqrt(F.col("sse_b") / F.col("cells"))
    boot = _packed_reps(per_origin, keys, "origin_q", ["sse_a", "sse_b", "cells"], reps, seed).withColumn("_g", gap)
    ci = F.percentile("_g", [0.025, 0.975]).alias("_q")
    point = per_origin.groupBy(*keys).agg(
        F.sum("sse_a").alias("sse_a"), F.sum("sse_b").alias("sse_b"), F.sum("cells").alias("cells"),
        F.count(F.lit(1)).alias("origins"),
    )
    if keys:
        j = point.join(boot.groupBy(*keys).agg(ci), keys)
    else:
        j = point.withColumn("_q", boot.agg(ci).scalar())
    return j.select(
        *keys, "origins", gap.alias("gap"), F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper")
    )


def _macro_f1(tp: list[str], predicted: list[str], actual: list[str]) -> Column:
    parts = [
        F.coalesce(F.try_divide(2 * F.col(t), F.col(p) + F.col(c)), F.lit(0.0))
        for t, p, c in zip(tp, predicted, actual)
    ]
    return sum(parts[1:], parts[0]) / len(parts)


def bootstrap_f1_gap(
    paired: DataFrame, keys: list[str], period: str, actual: str, a: str, b: str, classes: list[str],
    reps: int = 2000, seed: int = 42,
) -> DataFrame:
    """Paired bootstrap of macro-F1(a) - macro-F1(b) over periods.

    ``paired`` has one row per unit with the actual label and both predicted labels as columns.
    """
    is_ = lambda c, k: (F.col(c) == k).cast("double")
    aggs, names = [], {"ta": [], "pa": [], "tb": [], "pb": [], "ac": []}
    for i, k in enumerate(classes):
        for name, e in (
            ("ta", is_(actual, k) * is_(a, k)), ("pa", is_(a, k)), ("tb", is_(actual, k) * is_(b, k)),
            ("pb", is_(b, k)), ("ac", is_(actual, k)),
        ):
            names[name].append(f"{name}{i}")
            aggs.append(F.sum(e).alias(f"{name}{i}"))
    units = paired.dropna(subset=[actual, a, b]).groupBy(*keys, period).agg(*aggs)
    stats = [c for group in names.values() for c in group]
    gap = _macro_f1(names["ta"], names["pa"], names["ac"]) - _macro_f1(names["tb"], names["pb"], names["ac"])
    boot = _packed_reps(units, keys, period, stats, reps, seed).withColumn("_g", gap)
    ci = F.percentile("_g", [0.025, 0.975]).alias("_q")
    point = units.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stats], F.count(F.lit(1)).alias("periods"))
    if keys:
        j = point.join(boot.groupBy(*keys).agg(ci), keys)
    else:
        j = point.withColumn("_q", boot.agg(ci).scalar())
    return j.select(
        *keys, "periods", gap.alias("gap"), F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper")
    )
