"""Joins and exact quantiles that survive a group holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.sources.stage import written

SALTS = 16  # copies of the small side unless the caller or ``spark.panelcast.salts`` says otherwise


def salted_join(
    big: DataFrame, per_group: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int | None = None,
) -> DataFrame:
    """Join rows to a table with at most one row per key without sending a hot key to one task.

    ``per_group`` is replicated ``salts`` times and each row of ``big`` picks one replica from a hash of the
    ``spread`` columns, which must tell the rows of a key apart. Only keys and spread are read for it, so other
    columns stay prunable. A key with a share s of all rows puts s / salts on a task: choose salts of at least
    s times the number of tasks. Meant for tables with few rows per key on the right; where the right side is
    as long as the left, a plain join with the adaptive skew split is the better plan.
    """
    n = salts or int(big.sparkSession.conf.get("spark.panelcast.salts", str(SALTS)))
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(n)).cast("int"), F.lit(0))
    right = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return big.withColumn("_salt", salt).join(right, [*keys, "_salt"], how).drop("_salt")


BIN_ROWS = 200_000  # different values of a group that one task may rank
CUTS = 255  # cut points a group gets in one round


def _search(cuts, v) -> Column:
    """How many of the ascending ``cuts`` lie below ``v``, in eight halvings."""
    step = lambda at, s: F.when(F.try_element_at(cuts, at + s) < v, at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(7, -1, -1)]), F.lit(0), step)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: Mapping[str, float], with_count: bool = False, with_mean: bool = False,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact for groups of any size, by one path for all sizes.

    Equal values are counted first (map-side combined), so a (group, value) is one row however often it occurs.
    While a group has more than ``bin_rows`` of them, cut points are written as data, approximate quantiles of
    its values; they deal the values into bins, the bins' counts give the rank before each, and only bins that
    hold a wanted rank go on, as groups of the next round. Then a running count gives every value its ranks.
    What is a bin depends on the written cut points alone: a plan that computes a branch twice, or a task that
    runs again, deals alike. A group of 12 million different values takes one round, one of 3 billion two.

    NULL values do not count, but a group of NULLs alone stays, with NULL quantiles; NULL keys are groups.
    Infinities are values; between two different infinities the interpolated value is NaN.
    """
    names, probs = list(quantiles), [float(p) for p in quantiles.values()]
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("_k"), F.col(value).cast("double").alias("_v"))
    counts = written(rows.groupBy("_k", "_v").agg(F.count("_v").alias("_c")))
    weight = F.sum("_c")
    groups = counts.groupBy("_k").agg(weight.alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.nullif(weight, F.lit(0))).alias("_mean"))
    position = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    wanted = [rank for pos in position for rank in (F.floor(pos), F.ceil(pos))]
    # _b numbers the bins of a group in order, _start is the rank of a bin's first value
    open_ = counts.where("_v IS NOT NULL").select("_k", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_start"), "_v", "_c")
    while (open_.groupBy("_k", "_b").count().agg(F.max("count")).first()[0] or 0) > bin_rows:
        open_ = _refined(open_, groups, wanted, bin_rows)
    inside = W.partitionBy("_k", "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    hi = F.col("_start") + F.sum("_c").over(inside)
    ranked = open_.join(groups, "_k").withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_c"))
    picks = [F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(wanted)]
    stats = groups.join(ranked.groupBy("_k").agg(*picks), "_k", "left")
    out = []
    for i, (name, pos) in enumerate(zip(names, position)):
        part = pos - F.floor(pos)
        lo, hi = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        # equal ends first: infinity times zero is no number
        out.append(F.when((part == 0) | (lo == hi), lo).otherwise(lo * (1 - part) + hi * part).alias(name))
    more = [F.col("_n").alias("n_values")] * with_count + [F.col("_mean").alias("mean")] * with_mean
    return stats.select(*[F.col("_k").getField(k).alias(k) for k in keys], *out, *more)


def _refined(open_: DataFrame, groups: DataFrame, wanted: list[Column], bin_rows: int) -> DataFrame:
    """The values of the bins that hold a wanted rank, after bins of more than ``bin_rows`` values are cut."""
    steps = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    large = open_.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_d"), F.percentile_approx("_v", steps, 10_000).alias("_cuts")).where(F.col("_d") > bin_rows)
    cuts = written(large.select("_k", "_b", "_cuts"))
    # a bin's few rows of cut points meet its many values on several tasks
    dealt = salted_join(open_, cuts, ["_k", "_b"], ["_v"], "left")
    finer = F.col("_b") * F.lit(CUTS + 1) + F.coalesce(F.when(F.col("_cuts").isNotNull(), _search(F.col("_cuts"), F.col("_v"))), F.lit(0))
    dealt = dealt.select("_k", "_b", finer.alias("_f"), "_start", "_v", "_c")
    totals = dealt.groupBy("_k", "_b", "_f", "_start").agg(F.sum("_c").alias("_t"))
    before = W.partitionBy("_k", "_b").orderBy("_f").rowsBetween(W.unboundedPreceding, -1)
    bins = totals.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_t").over(before), F.lit(0))).join(groups.select("_k", "_n"), "_k")
    holds = reduce(Column.__or__, [(r >= F.col("_first")) & (r < F.col("_first") + F.col("_t")) for r in wanted])
    kept = bins.where(holds).select("_k", "_f", F.col("_first").alias("_go"))
    values = salted_join(dealt.drop("_b", "_start"), kept, ["_k", "_f"], ["_v"])
    return written(values.select("_k", F.col("_f").alias("_b"), F.col("_go").alias("_start"), "_v", "_c"))


def bounded_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """The same quantiles in one aggregation, for groups whose size the caller has fixed (simulation counts)."""
    probs = [float(p) for p in quantiles.values()]
    agg = df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), probs).alias("_q"))
    return agg.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)])
