"""Stressed default rates and expected loss over segments (or single exposures) and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.quality import assert_keys


def stressed_pd(base: Column, delta: Column, sensitivity: Column) -> Column:
    """Base plus sensitivity points per unit of change; never below the base, never above 1."""
    return F.least(F.lit(1.0), F.greatest(base, base + sensitivity * delta / 100))


def credit_stress(exposures: DataFrame, scenarios: list[dict]) -> DataFrame:
    """One row per exposure and scenario with stressed PD and expected loss.

    Scenarios (name, probability_weight, delta) are a short list known when the plan is built, so they are
    an exploded literal array: exposures are not shuffled, however many there are.
    """
    missing = [s["name"] for s in scenarios if s.get("probability_weight") is None]
    if missing:
        raise ValueError(f"scenario weights missing for scenarios: {sorted(missing)}")
    cells = F.array(*[
        F.struct(
            F.lit(s["name"]).alias("scenario"), F.lit(float(s["probability_weight"])).alias("probability_weight"),
            F.lit(float(s["delta"])).alias("delta"),
        )
        for s in scenarios
    ])
    rows = exposures.withColumn("_s", F.explode(cells)).select("*", "_s.*").drop("_s")
    pd = stressed_pd(F.col("pd_base"), F.col("delta"), F.col("sensitivity"))
    return rows.withColumn("pd_stressed", pd).withColumn(
        "expected_loss", F.col("pd_stressed") * F.col("lgd") * F.col("ead") / (1 + F.col("discount_rate"))
    )


def join_assumptions(exposures: DataFrame, assumptions: list[DataFrame], on: str = "segment") -> DataFrame:
    """Attach per-segment assumption tables; an exposure segment without assumptions is an error.

    There are few segments: Spark broadcasts their table when its measured size allows, else splits hot segments.
    """
    out = exposures
    for table in assumptions:
        assert_keys(exposures, table, [on], "stress assumptions")
        out = out.join(table, [on])
    return out


def segment_totals(stressed: DataFrame, keys: list[str]) -> DataFrame:
    """Probability-weighted expected loss per segment."""
    return stressed.groupBy(*keys).agg(
        F.sum(F.col("probability_weight") * F.col("expected_loss")).alias("weighted_expected_loss")
    )
