"""Reading raw series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.numeric import numeric_complete, require_columns, to_number

STEM = r"^(.+)_(\d{4})_(\d{4})$"


def read_series(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema; a missing path raises when the plan is analysed."""
    return spark.read.schema(schema).csv(path, header=True)


def read_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Only the named columns; everything else is pruned from the scan."""
    require_columns(df, cols)
    return df.select(*cols)


def load_complete(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    return numeric_complete(df.select(*keys, *cols), cols)


def file_name(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"([^/]+?)(\.[^./]*)?$", 1)


def latest_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Newest download per series from names like ``<series>_<first year>_<last year>.csv``.

    The largest last year wins, on a tie the smallest first year; names without a year range are kept
    as a series of their own.
    """
    stem = file_name(path)
    ranged = stem.rlike(STEM)
    parsed = files.select(
        "*",
        F.when(ranged, F.regexp_extract(stem, STEM, 1)).otherwise(stem).alias("series"),
        F.when(ranged, F.regexp_extract(stem, STEM, 2).try_cast("int")).alias("first_year"),
        F.when(ranged, F.regexp_extract(stem, STEM, 3).try_cast("int")).alias("last_year"),
    )
    rank = F.struct(F.col("last_year"), -F.col("first_year"), F.col(path))
    best = parsed.groupBy("series").agg(F.max(rank).alias("_b"))
    return best.select(
        "series",
        (-F.col("_b").getField("col2")).alias("first_year"),
        F.col("_b.last_year").alias("last_year"),
        F.col(f"_b.{path}").alias(path),
    )


def read_latest(spark: SparkSession, directory: str, schema, folders: bool = False) -> DataFrame:
    """All rows of a download directory that belong to the newest file of each series.

    The directory is listed without reading content, and only the newest files are scanned. One path per series
    is kept on the driver. ``folders`` takes a folder ``<name>.csv`` of part files, as Spark writes, for a file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    if folders:
        listed = listed.where(F.col("path").endswith(".csv")).select(F.regexp_replace("path", "/[^/]+$", "").alias("path")).distinct()
    newest = latest_files(listed).select("series", "path").collect()
    if not newest:
        return spark.createDataFrame([], schema).withColumns({"path": F.lit(None).cast("string"), "series": F.lit(None).cast("string")})
    rows = spark.read.schema(schema).csv([r.path for r in newest], header=True).withColumn("path", F.col("_metadata.file_path"))
    if folders:
        rows = rows.withColumn("path", F.regexp_replace("path", "/[^/]+$", ""))
    stem = file_name("path")
    return rows.withColumn("series", F.when(stem.rlike(STEM), F.regexp_extract(stem, STEM, 1)).otherwise(stem))


def typed_series(df: DataFrame, date: str, value: str) -> DataFrame:
    """Strict dates (a bad one raises), lenient numbers (a bad one is missing)."""
    return df.withColumns({date: F.col(date).cast("date"), value: to_number(value)})
