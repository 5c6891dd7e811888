"""The curated build as one run: align, merge, derive, check, and publish behind the gate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.calendar import horizon_label_to_int
from panelcast.operators import align, features, quality
from panelcast.sources.sinks import publish_if_clean, read_published

#: A quality record; every check can be turned into this shape, stacked and handed to the gate.
RECORD = {
    "dataset": "string", "status": "string", "rows": "bigint", "columns": "bigint", "start_date": "string", "end_date": "string",
    "missing_values": "bigint", "duplicate_dates": "bigint", "notes": "string",
}


@dataclass(frozen=True)
class Recipe:
    """What is derived from the merged series, in this order."""

    series: list[str]
    growth: Mapping[str, str] = field(default_factory=dict)
    lags: Mapping[str, list[int]] = field(default_factory=dict)
    squares: list[str] = field(default_factory=list)
    products: list[tuple[str, str]] = field(default_factory=list)


def curate(raw: DataFrame, keys: list[str], date: str, value: str, recipe: Recipe, events: DataFrame | None = None, spec: DataFrame | None = None, series: str = "series_id") -> DataFrame:
    """Raw observations to one row per key and quarter with growth, lags, squares, products and event dummies."""
    long = align.resample(raw, [*keys, series], date, value, spec=spec)
    out = align.merge_series(long, keys, recipe.series, series)
    out = features.add_growth(out, keys, recipe.growth)
    out = features.add_lags(out, keys, recipe.lags)
    out = features.add_interactions(features.add_squares(out, recipe.squares), recipe.products)
    return out if events is None else features.add_event_dummies(out, events, ["q_idx"], spread=keys)


def as_records(checked: DataFrame, dataset: Column | str, keys: list[str]) -> DataFrame:
    """A check's result in the nine fields, with the keys; what a check does not know is 1, 0 or empty."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    blank = {"columns": F.lit(1), "start_date": F.lit(""), "end_date": F.lit(""), "missing_values": F.lit(0), "duplicate_dates": F.lit(0)}
    pick = lambda c: name if c == "dataset" else F.coalesce(F.col(c), blank[c]) if c in checked.columns and c in blank else blank.get(c, F.col(c) if c in checked.columns else None)
    return checked.select(*keys, *[pick(c).cast(kind).alias(c) for c, kind in RECORD.items()])


def label_records(df: DataFrame, keys: list[str], label: str, dataset: str) -> DataFrame:
    """A FAIL record per key whose horizon labels cannot all be read, else a PASS record."""
    bad = F.count_if(F.col(label).isNotNull() & horizon_label_to_int(label).isNull())
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), bad.alias("_bad"), F.count_if(F.col(label).isNull()).alias("missing_values"))
    note = F.when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" unreadable horizon labels"))).otherwise(quality.OK)
    return as_records(counted.withColumns({"status": F.when(F.col("_bad") > 0, "FAIL").otherwise("PASS"), "notes": note}), dataset, keys)


def quality_table(
    raw: DataFrame, curated: DataFrame, keys: list[str], date: str, value: str, target: str, required: list[str], min_rows: int,
    series: str = "series_id", contract: T.StructType | None = None,
) -> DataFrame:
    """One table of nine-field records: every source series, the curated table, its columns and its contract."""
    sources = quality.check_series(raw, [*keys, series], date, [value])
    out = as_records(sources, F.concat(F.lit("source:"), F.col(series)), keys)
    out = out.unionByName(as_records(quality.check_curated(curated, keys, target, required, min_rows), "curated", keys))
    columns = [c for c in curated.columns if c not in (*keys, "q_idx", "quarter")]
    out = out.unionByName(as_records(quality.check_columns(curated, keys, columns), F.concat(F.lit("column:"), F.col("variable")), keys))
    if contract is not None:
        typed = quality.check_schema(curated, contract)
        typed = as_records(typed, F.concat(F.lit("contract:"), F.col("column_name")), [])
        out = out.unionByName(typed, allowMissingColumns=True)
    return out


def build(raw, keys, date, value, recipe: Recipe, target: str, min_rows: int, directory: str, events=None, contract: T.StructType | None = None) -> DataFrame:
    """The whole run: what is written once is checked, and published with its report (QualityGateError on a FAIL row)."""
    check = lambda staged: quality_table(raw, staged, keys, date, value, target, ["q_idx", target], min_rows, contract=contract)
    publish_if_clean(curate(raw, keys, date, value, recipe, events), check, directory)
    return read_published(raw.sparkSession, directory)
