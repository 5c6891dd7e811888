"""Wide/long conversions and nested payloads to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import horizon_label_to_int, q_from_label, q_label
from panelcast.functions.numeric import to_number


def to_long(df: DataFrame, ids: list[str], cols: list[str], drop_missing: bool = True) -> DataFrame:
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    long = typed.unpivot(ids, cols, "variable", "value")
    return long.where(F.col("value").isNotNull()) if drop_missing else long


def to_wide(df: DataFrame, idx: list[str], col: str, val: str, values: list, how: str = "first") -> DataFrame:
    """Pivot with the value list given up front, so no extra job discovers it."""
    agg = {"first": F.max(val), "avg": F.avg(val), "sum": F.sum(val)}[how]
    return df.groupBy(*idx).pivot(col, values).agg(agg)


def tidy_horizon_matrices(matrices: dict[str, DataFrame], date: str = "forecast_date") -> DataFrame:
    """Several (date x ``t+h``) matrices to one row per date and horizon, one column per matrix.

    Stacked and regrouped once instead of chained full outer joins. A ``source`` column of the first
    matrix is carried along. Labels that are not of the form ``t`` / ``t+h`` / ``t-h`` are kept with a
    NULL horizon so that a quality check can report them.
    """
    parts = []
    for name, m in matrices.items():
        labels = [c for c in m.columns if c.strip().lower().startswith("t")]
        src = F.col("source") if "source" in m.columns else F.lit(None).cast("string")
        base = m.select(
            F.col(date).try_cast("date").alias("forecast_date"), src.alias("source"),
            *[to_number(c).alias(c) for c in labels],
        ).where(F.col("forecast_date").isNotNull())
        parts.append(
            base.unpivot(["forecast_date", "source"], labels, "horizon_label", "value").withColumn(
                "_m", F.lit(name)
            )
        )
    stacked = reduce(DataFrame.unionByName, parts)
    cells = [F.max(F.when(F.col("_m") == n, F.col("value"))).alias(n) for n in matrices]
    return (
        stacked.groupBy("forecast_date", "horizon_label")
        .agg(F.max("source").alias("source"), *cells)
        .withColumn("horizon_quarters", horizon_label_to_int("horizon_label"))
    )


def tidy_ratio_rows(
    df: DataFrame, label_col: str, labels: dict[str, str], start_q: int, period_cols: list[str],
) -> DataFrame:
    """Ratio rows laid out across period columns to long percent rows.

    Periods before ``start_q`` are cut, each source measure gets its basis text and
    ``measures_in_quarter`` counts measures sharing a quarter (more than one is a data error).
    """
    measure = F.lower(F.trim(label_col))
    wanted = df.where(measure.isin(*[k.lower() for k in labels]))
    long = to_long(wanted, [label_col], period_cols)
    basis = F.coalesce(*[F.when(measure == k.lower(), F.lit(v)) for k, v in labels.items()])
    tidy = long.select(
        q_from_label("variable").alias("q_idx"),
        (F.col("value") * 100).alias("ratio_percent"),
        F.trim(label_col).alias("source_measure"),
        basis.alias("measurement_basis"),
    ).where(F.col("q_idx") >= start_q)
    per_quarter = tidy.groupBy("q_idx").agg(F.count(F.lit(1)).alias("measures_in_quarter"))
    return tidy.join(per_quarter, "q_idx").withColumn("quarter", q_label("q_idx"))


def explode_arrays(df: DataFrame, keys: list[str], arrays: dict[str, str]) -> DataFrame:
    """Parallel arrays (source column -> output column) to one row per position, from step 1."""
    zipped = F.arrays_zip(*[F.col(src).alias(out) for src, out in arrays.items()])
    exploded = df.select(*keys, F.posexplode(zipped).alias("_p", "_z"))
    return exploded.select(
        *keys, (F.col("_p") + 1).alias("horizon"),
        *[F.col("_z").getField(out).alias(out) for out in arrays.values()],
    )


def explode_scenarios(
    df: DataFrame, keys: list[str], maps: dict[str, str], scenarios: DataFrame | None = None,
) -> DataFrame:
    """Maps keyed by scenario to one row per scenario that any map has; scenario attributes joined when given."""
    named = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps])))
    rows = df.select(*keys, *maps, F.explode(named).alias("scenario"))
    out = rows.select(
        *keys, "scenario",
        *[F.try_element_at(F.col(m), F.col("scenario")).alias(name) for m, name in maps.items()],
    )
    return out if scenarios is None else out.join(scenarios, ["scenario"], "left")


def explode_payload(df: DataFrame, json_col: str, schema: str, context: list[str], items: str) -> DataFrame:
    """A JSON payload to one row per item of its array, repeating the shared context fields."""
    parsed = df.select(F.from_json(F.col(json_col), schema).alias("_j"))
    return parsed.select(
        *[F.col(f"_j.{c}").alias(c) for c in context], F.explode(F.col(f"_j.{items}")).alias("_i")
    ).select(*context, "_i.*")


def rank_of(col: str | Column, order: list[str], other: int | None = None) -> Column:
    """Position of a label in a fixed list; unlisted labels share the rank after the last."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order) if other is None else other))


def stack_predictions(frames: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Union of prediction tables; columns a model lacks are NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if columns is None:
        return out
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns])


def nested_to_long(df: DataFrame, keys: list[str], tensor: str, responses: list[str], shocks: list[str]) -> DataFrame:
    """A [horizon][response][shock] array to long rows with names for the two inner axes."""
    h = df.select(*keys, F.posexplode(tensor).alias("horizon", "_r"))
    r = h.select(*keys, "horizon", F.posexplode("_r").alias("_ri", "_s"))
    s = r.select(*keys, "horizon", "_ri", F.posexplode("_s").alias("_si", "value"))
    name = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)
    return s.select(
        *keys, "horizon", name(responses, F.col("_ri")).alias("response"),
        name(shocks, F.col("_si")).alias("shock"), "value",
    )


def compare_screens(
    a: DataFrame, b: DataFrame, on: list[str], a_name: str, b_name: str, corr: str, p_value: str,
    threshold: float = 0.10,
) -> DataFrame:
    """Two screen summaries side by side: difference in strength and whether the signal changed."""
    left = a.select(*on, *[F.col(c).alias(f"{a_name}_{c}") for c in (corr, p_value)])
    right = b.select(*on, *[F.col(c).alias(f"{b_name}_{c}") for c in (corr, p_value)])
    j = left.join(right, on, "full_outer")
    signal = lambda n: F.coalesce(F.col(f"{n}_{p_value}") <= threshold, F.lit(False))
    return j.withColumns(
        {
            "abs_corr_diff": F.abs(f"{b_name}_{corr}") - F.abs(f"{a_name}_{corr}"),
            "signal_changed": signal(a_name) != signal(b_name),
        }
    )
