"""Quarter arithmetic.

A quarter is the integer ``year * 4 + quarter - 1``: shifting is plain addition, gaps are plain
subtraction, and Parquet min/max statistics on the column prune row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_PATTERN = r"^\d{4}Q[1-4]$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q_idx(date: Column | str) -> Column:
    d = _col(date)
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def q_label(idx: Column | str) -> Column:
    i = _col(idx)
    return F.concat(F.floor(i / 4).cast("string"), F.lit("Q"), (i % 4 + 1).cast("int").cast("string"))


def q_from_label(label: Column | str) -> Column:
    s = F.trim(_col(label))
    return F.when(
        s.rlike(LABEL_PATTERN),
        F.substring(s, 1, 4).try_cast("int") * 4 + F.substring(s, 6, 1).try_cast("int") - 1,
    ).cast("int")


def q_add(idx: Column | str, h: Column | int) -> Column:
    return (_col(idx) + h).cast("int")


def q_start(idx: Column | str) -> Column:
    i = _col(idx)
    return F.make_date(F.floor(i / 4).cast("int"), (i % 4 * 3 + 1).cast("int"), F.lit(1))


def q_end(idx: Column | str) -> Column:
    return F.last_day(F.add_months(q_start(idx), 2))


def next_quarters(df: DataFrame, idx: str, steps: int, out: str = "target_q") -> DataFrame:
    """One row per horizon 1..steps with the quarter it targets."""
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        out, q_add(idx, F.col("horizon"))
    )


def parse_temporal(text: Column | str) -> Column:
    """``2020Q1`` labels become the quarter's first day, anything else an ISO date or NULL."""
    s = F.trim(_col(text).cast("string"))
    return F.when(s.rlike(LABEL_PATTERN), q_start(q_from_label(s))).otherwise(
        s.try_cast("date")
    )


def filter_years(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Inclusive calendar-year filter written as a date range so that it reaches the scan."""
    d = F.col(date)
    kind = dict(df.dtypes)[date]
    lo = F.make_date(F.lit(first), F.lit(1), F.lit(1)).cast(kind)
    hi = F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)).cast(kind)
    return df.where((d >= lo) & (d < hi))


def restrict_to_window(df: DataFrame, end_q: int, idx: str = "q_idx") -> DataFrame:
    return df.where(F.col(idx) <= F.lit(end_q))


def restrict_dates(df: DataFrame, date: str, first_q: int | None, last_q: int | None) -> DataFrame:
    """Rows of the quarters first_q to last_q, as a range of the date itself so that it reaches the scan."""
    d, kind = F.col(date), dict(df.dtypes)[date]
    start = lambda q: F.lit(f"{q // 4:04d}-{q % 4 * 3 + 1:02d}-01").cast(kind)
    if first_q is not None:
        df = df.where(d >= start(first_q))
    return df if last_q is None else df.where(d < start(last_q + 1))


def horizon_label_to_int(label: Column | str) -> Column:
    """``t`` -> 0, ``t+3`` -> 3, ``t-1`` -> -1; anything else is NULL."""
    s = F.regexp_replace(F.lower(_col(label).cast("string")), r"\s", "")
    return F.when(s == "t", F.lit(0)).otherwise(
        F.when(s.rlike(r"^t[+-]\d+$"), F.regexp_extract(s, r"^t\+?(-?\d+)$", 1).try_cast("int"))
    )
