"""Data-quality records, one aggregation pass per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelcast.functions.calendar import parse_temporal, q_idx, q_label
from panelcast.functions.numeric import require_columns, to_number

# Note texts of the quality report.
OK = "ok"
EMPTY = "dataset is empty"
TOO_FEW = "row count below minimum"
INVALID_DATES = "invalid date values"
DUPLICATE_DATES = "duplicate dates"
UNSORTED = "dates are not sorted"
NO_COLUMN = "missing value column:"
NO_DATE = "missing date column:"
NON_NUMERIC = "non-numeric values"
MISSING = "missing values"
MISSING_QUARTERS = "missing quarters in date range"
FUTURE = "future date values"
OUTSIDE = "values outside 0-100 percent"
NO_REQUIRED = "missing required columns:"
DUPLICATE_QUARTERS = "duplicate quarters"
FEW_USABLE = "usable rows below minimum"
SPARSE = "missing after quarterly merge"


def _number_note(n: Column, text: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}")))


def _status(fails: list[Column], warns: list[Column]) -> Column:
    hit = lambda cs: F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in cs], F.lit(False))
    return F.when(hit(fails), "FAIL").when(hit(warns), "WARNING").otherwise("PASS")


def _notes(parts: list[Column]) -> Column:
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", F.lit(OK)).otherwise(text)


def with_file_order(df: DataFrame, out: str = "_pos") -> DataFrame:
    """Position of a row in its input as read; needed because sortedness is a property of the file."""
    return df.withColumn(out, F.monotonically_increasing_id())


def with_place(df: DataFrame, order: str) -> DataFrame:
    """A row's place as (_file, _block, _pos): of the file it was read from, or of a position column.

    ``order="file"`` needs rows that come from a scan of files, of any format, through projections and filters
    alone. Files follow each other by name, a file's blocks by their offset, a block's rows as they are read;
    one block is one task's, so in which order tasks run does not matter.
    """
    if order != "file":
        return df.withColumns({"_file": F.lit(""), "_block": F.lit(0).cast("long"), "_pos": F.col(order).cast("long")})
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_pos": F.monotonically_increasing_id()})


def with_back_steps(places: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Marks rows (keys, date, _file, _block, _first, _last) before which the dates of their key go back.

    ``places`` holds one row per date and block, so a window over a key sees calendar-sized rows only. Dates run
    forward when each, in order of its first row, is no earlier than the one before and begins after its last
    row. NULL dates are passed over.
    """
    here = F.when(F.col(date).isNotNull(), F.struct("_file", "_block", "_last", date))
    along = W.partitionBy(*keys).orderBy("_file", "_block", "_first").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(here, ignorenulls=True).over(along)
    same = (before["_file"] == F.col("_file")) & (before["_block"] == F.col("_block"))
    back = (before[date] > F.col(date)) | (same & F.col(date).isNotNull() & (before["_last"] > F.col("_first")))
    return places.withColumn("_back", F.coalesce(back, F.lit(False)))


def unsorted_flags(df: DataFrame, keys: list[str], date: Column, order: str = "file") -> DataFrame:
    """Whether each dataset's dates run back anywhere in the given order; raw rows are combined before any shuffle."""
    rows = with_place(df.withColumn("_d", date), order)
    places = rows.where(F.col("_d").isNotNull()).groupBy(*keys, "_d", "_file", "_block").agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
    return with_back_steps(places, keys, "_d").groupBy(*keys).agg(F.bool_or("_back").alias("unsorted"))


def _no_date_records(df: DataFrame, keys: list[str], date: str, columns: int) -> DataFrame:
    """A FAIL record per dataset for a table without its date column."""
    data = [c for c in df.columns if c not in keys]
    missing = sum((F.count_if(F.col(c).isNull()) for c in data), F.lit(0))
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing_values"))
    return agg.select(
        *keys, F.lit("FAIL").alias("status"), "rows", F.lit(columns).cast("bigint").alias("columns"), F.lit("").alias("start_date"),
        F.lit("").alias("end_date"), "missing_values", F.lit(0).cast("bigint").alias("duplicate_dates"), F.lit(f"{NO_DATE} {date}").alias("notes"),
    )


def check_series(
    df: DataFrame, keys: list[str], date: str, values: list[str], min_rows: int = 1,
    order: str | None = None, percent: bool = False, as_of: str | None = None,
) -> DataFrame:
    """Quality record per dataset (``keys``): row count, bad and repeated dates, non-numeric and missing
    values, sortedness when an ``order`` is given: a position column, or ``"file"`` for the order of the files
    that are scanned. It is read from the same aggregation, in one scan (see :func:`with_place`).

    ``percent=True`` adds the ratio checks: missing quarters, dates after ``as_of`` and values outside
    0-100. Dates are counted per distinct day first, so repeated dates of a hot dataset combine map-side.
    """
    require_columns(df, keys)
    if date not in df.columns:
        return _no_date_records(df, keys, date, len([c for c in df.columns if c not in (order, *keys)]))
    have = [c for c in values if c in df.columns]
    absent = [c for c in values if c not in df.columns]
    typed = df.withColumn("_d", parse_temporal(date))
    per_day = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(have):
        num = to_number(c)
        raw = F.col(c)
        is_nan = raw.try_cast("double").isNotNull() & num.isNull()
        per_day += [
            F.count_if(num.isNull() & raw.isNotNull() & ~is_nan).alias(f"_bad{i}"),
            F.count_if(raw.isNull() | F.coalesce(is_nan, F.lit(False))).alias(f"_miss{i}"),
            F.count_if((num < 0) | (num > 100)).alias(f"_out{i}"),
        ]
    if order is None:
        days = typed.groupBy(*keys, "_d").agg(*per_day).withColumn("_back", F.lit(False))
    else:
        counts = ["_n"] + [f"_{k}{i}" for i in range(len(have)) for k in ("bad", "miss", "out")]
        ends = [F.min("_pos").alias("_first"), F.max("_pos").alias("_last")]
        places = with_place(typed, order).groupBy(*keys, "_d", "_file", "_block").agg(*per_day, *ends)
        days = with_back_steps(places, keys, "_d").groupBy(*keys, "_d").agg(*[F.sum(c).alias(c) for c in counts], F.bool_or("_back").alias("_back"))
    total = [
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("_n"))), F.lit(0)).alias("_invalid"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_dates"),
        F.min("_d").alias("_a"), F.max("_d").alias("_b"),
        F.count_distinct(q_idx("_d")).alias("_quarters"),
        F.coalesce(F.sum(F.when(F.col("_d") > F.lit(as_of).cast("date"), F.col("_n"))), F.lit(0)).alias("_future"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("unsorted"),
    ]
    for i in range(len(have)):
        total += [F.coalesce(F.sum(f"_{k}{i}"), F.lit(0)).alias(f"_{k}{i}") for k in ("bad", "miss", "out")]
    agg = days.groupBy(*keys).agg(*total)
    rows = F.coalesce("rows", F.lit(0))
    missing = sum((F.coalesce(f"_miss{i}", F.lit(0)) for i in range(len(have))), F.lit(0))
    fails = [
        F.when(rows == 0, F.lit(EMPTY)),
        F.when(rows < min_rows, F.lit(f"{TOO_FEW} {min_rows}")),
        _number_note(F.col("_invalid"), INVALID_DATES),
        _number_note(F.col("duplicate_dates"), DUPLICATE_DATES),
    ]
    unsorted = F.when(F.col("unsorted"), F.lit(UNSORTED))
    value_fails = [F.lit(f"{NO_COLUMN} {c}") for c in absent] + [
        F.when(
            F.col(f"_bad{i}") > 0,
            F.concat(F.lit(f"{c} has "), F.col(f"_bad{i}").cast("string"), F.lit(f" {NON_NUMERIC}")),
        )
        for i, c in enumerate(have)
    ]
    base = _status(fails + value_fails, [unsorted])
    miss_note = F.when(base == "PASS", _number_note(missing, MISSING))
    fail2, warn2, extra = [], [], []
    if percent:
        span = q_idx("_b") - q_idx("_a") + 1 - F.col("_quarters")
        gap = _number_note(span, MISSING_QUARTERS)
        future = _number_note(F.col("_future"), FUTURE) if as_of else F.lit(None)
        outside = [
            F.when(
                F.col(f"_out{i}") > 0,
                F.concat(F.lit(f"{c} has "), F.col(f"_out{i}").cast("string"), F.lit(f" {OUTSIDE}")),
            )
            for i, c in enumerate(have)
        ]
        warn2, fail2, extra = [gap], [future, *outside], [gap, future, *outside]
    return agg.select(
        *keys,
        _status(fails + value_fails + fail2, [unsorted, miss_note, *warn2]).alias("status"),
        rows.cast("bigint").alias("rows"),
        F.lit(len([c for c in df.columns if c not in (order, *keys)])).cast("bigint").alias("columns"),
        F.coalesce(F.col("_a").cast("string"), F.lit("")).alias("start_date"),
        F.coalesce(F.col("_b").cast("string"), F.lit("")).alias("end_date"),
        missing.cast("bigint").alias("missing_values"),
        F.col("duplicate_dates").cast("bigint").alias("duplicate_dates"),
        _notes([*fails, unsorted, *value_fails, miss_note, *extra]).alias("notes"),
    )


def check_ratio(df, keys, date, values, as_of: str, min_rows: int = 1, order: str | None = None) -> DataFrame:
    return check_series(df, keys, date, values, min_rows, order, percent=True, as_of=as_of)


def check_curated(
    df: DataFrame, keys: list[str], target: str, required: list[str], min_rows: int = 80, idx: str = "q_idx",
) -> DataFrame:
    """Record of the finished table: required columns, repeated and missing quarters, usable targets."""
    if idx not in df.columns:
        return _no_date_records(df, keys, idx, len([c for c in df.columns if c not in keys]))
    absent = [c for c in required if c not in df.columns]
    data = [c for c in df.columns if c not in keys]
    usable = F.count(target) if target in df.columns else F.lit(0)
    missing = sum((F.count_if(F.col(c).isNull()) for c in data), F.lit(0))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(idx).alias("_a"), F.max(idx).alias("_b"),
        F.count_distinct(idx).alias("_q"), usable.alias("_use"), missing.alias("missing_values"),
    )
    dup = F.col("rows") - F.col("_q")
    fails = [
        F.lit(f"{NO_REQUIRED} {', '.join(absent)}") if absent else F.lit(None).cast("string"),
        _number_note(dup, DUPLICATE_QUARTERS),
        F.when(F.col("_use") < min_rows, F.lit(f"{target} {FEW_USABLE} {min_rows}")),
    ]
    gap = _number_note(F.col("_b") - F.col("_a") + 1 - F.col("_q"), MISSING_QUARTERS)
    return agg.select(
        *keys, _status(fails, [gap]).alias("status"), "rows",
        F.lit(len(data)).cast("bigint").alias("columns"),
        q_label("_a").alias("start_date"), q_label("_b").alias("end_date"), "missing_values",
        dup.alias("duplicate_dates"), _notes([*fails, gap]).alias("notes"),
    )


def check_columns(df: DataFrame, keys: list[str], cols: list[str], limit: float = 0.5) -> DataFrame:
    """Missing share of every column in one pass; the wide result row is then turned long."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    long = agg.unpivot([*keys, "_n"], cols, "variable", "rows")
    missing = F.col("_n") - F.col("rows")
    share = F.coalesce(F.try_divide(missing.cast("double"), F.col("_n")), F.lit(1.0))
    note = F.format_string(f"%.1f%% {SPARSE}", share * 100)
    return long.select(
        *keys, "variable", F.when(share > limit, "WARNING").otherwise("PASS").alias("status"), "rows",
        missing.alias("missing_values"), F.when(share > limit, note).otherwise(F.lit(OK)).alias("notes"),
    )


def check_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Typed contract without coercion: wrong or absent columns and NULLs in required ones fail.

    Columns outside the contract are allowed.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for f in contract.fields:
        if f.name not in actual:
            rows.append((f.name, "column is absent", None))
        elif actual[f.name] != f.dataType:
            rows.append((f.name, f"expected {f.dataType.simpleString()}, found {actual[f.name].simpleString()}", None))
        elif not f.nullable:
            rows.append((f.name, None, f.name))
        else:
            rows.append((f.name, None, None))
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, (_, _, c) in enumerate(rows) if c]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    records = []
    for i, (name, problem, c) in enumerate(rows):
        n = F.col(f"_n{i}") if c else F.lit(0).cast("bigint")
        text = F.lit(problem) if problem else _number_note(n, MISSING)
        records.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.when(text.isNotNull(), "FAIL").otherwise("PASS").alias("status"),
                F.coalesce(text.cast("string"), F.lit(OK)).alias("notes"),
            )
        )
    return one.select("_rows", F.explode(F.array(*records)).alias("r")).select(
        "r.column_name", "r.status", F.col("_rows").alias("rows"), "r.notes"
    )


def consecutive_periods(df: DataFrame, keys: list[str], idx: str = "q_idx") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(idx).alias("first_q"), F.max(idx).alias("last_q"),
        ((F.max(idx) - F.min(idx) + 1 == F.count(F.lit(1))) & (F.count_distinct(idx) == F.count(F.lit(1)))).alias(
            "consecutive"
        ),
    )


def assert_consecutive(df: DataFrame, keys: list[str], idx: str = "q_idx", context: str = "panel") -> None:
    if not consecutive_periods(df, keys, idx).where(~F.col("consecutive")).isEmpty():
        raise ValueError(f"{context} must contain consecutive quarterly observations.")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str], context: str = "frame") -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{context} has duplicate rows for key ({', '.join(keys)})")


def missing_keys(required: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    return required.select(*on).distinct().join(have.select(*on).distinct(), on, "left_anti")


def assert_keys(required: DataFrame, have: DataFrame, on: list[str], context: str) -> None:
    if not missing_keys(required, have, on).isEmpty():
        raise ValueError(f"{context}: keys without a match on ({', '.join(on)})")
