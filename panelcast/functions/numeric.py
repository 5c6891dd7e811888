"""Null-safe arithmetic and moment expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Lenient number parse: text that is not a number and NaN both become NULL."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def finite(c: Column | str) -> Column:
    v = col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def scrub_inf(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite (and NaN) values become missing."""
    return df.withColumns({c: finite(c) for c in cols if c in df.columns})


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs, NULL for a constant side.

    Built from population moments so that it works as a grouped and as a window aggregate and never
    raises on zero variance.
    """
    a, b = _pair(x, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def safe_corr_over(x: Column | str, y: Column | str, window) -> Column:
    a, b = _pair(x, y)
    return ratio(
        F.covar_pop(a, b).over(window), F.stddev_pop(a).over(window) * F.stddev_pop(b).over(window)
    )


def pair_count(x: Column | str, y: Column | str) -> Column:
    return F.count_if(finite(x).isNotNull() & finite(y).isNotNull())


def _pair(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    a, b = finite(x), finite(y)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def close(a: Column | str, b: Column | str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def round_report(df: DataFrame, digits: Mapping[str, int] | int = 6) -> DataFrame:
    """Round report columns; an int rounds every floating column."""
    if isinstance(digits, int):
        digits = {c: digits for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


def parse_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def numeric_complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Coerce the named columns to numbers and keep rows where all of them are present."""
    require_columns(df, cols)
    return df.withColumns({c: to_number(c) for c in cols}).dropna(subset=cols)


def require_columns(df: DataFrame, cols, what: str = "frame") -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]
