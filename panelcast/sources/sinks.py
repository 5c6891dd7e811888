"""Writers, load manifest and the quality-gated publish."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.skew import salted_join
from panelcast.sources.pointer import move_pointer, read_pointer


def trim_strings(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f.name: F.trim(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    )


FILE_ROWS = 1_000_000  # rows of one series that a file of its own holds


def write_series(df: DataFrame, directory: str, series_col: str = "series_id", file_rows: int = FILE_ROWS) -> None:
    """One CSV folder per series, in as many files as its measured number of rows asks for.

    Rows are counted per series first; a series of more than ``file_rows`` is spread over several tasks by a hash
    of its rows, small ones have one file. The folder must be new: nothing is replaced.
    """
    rows = trim_strings(df)
    files = rows.groupBy(series_col).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_files"))
    _with_files(rows, files, series_col).write.mode("errorifexists").partitionBy(series_col).option("header", True).csv(directory)


def _with_files(rows: DataFrame, files: DataFrame, series_col: str) -> DataFrame:
    """Rows dealt to tasks by series and file number; a NULL series is one like any other."""
    part = F.pmod(F.xxhash64(*rows.columns), F.col("_files")).alias("_file")
    named = files.select(F.struct(series_col).alias("_s"), "_files")
    dealt = salted_join(rows.withColumn("_s", F.struct(series_col)), named, ["_s"], rows.columns).withColumn("_file", part)
    return dealt.repartition(F.col(series_col), F.col("_file")).select(*rows.columns)


#: The tables of one published set, by their number in its pointer.
DATA, QUALITY, CSV = 0, 1, 2


def publish_set(
    df: DataFrame, directory: str, quality: DataFrame | Callable[[DataFrame], DataFrame] | None = None, partition_by: list[str] | None = None, csv: bool = False,
) -> str:
    """Publish a table, its quality report and a CSV copy as one set: a reader sees all of it or the set before.

    The table is written once, into a new folder; the report is made from what was written (``quality`` is a
    function of that table, or a finished report) and the CSV copy too. A report with a FAIL row ends the run
    (QualityGateError). The pointer that names all parts comes last, and nothing is ever replaced: a death between
    any two writes leaves the last complete set, and older sets stay readable by their number.
    """
    spark, folder = df.sparkSession, f"{directory}/set-{uuid.uuid4().hex}"
    parts = [(DATA, f"{folder}/data")]
    rows = df.repartition(*partition_by) if partition_by else df
    split = lambda w: w.partitionBy(*partition_by) if partition_by else w
    split(rows.write).parquet(f"{folder}/data")
    staged = spark.read.schema(df.schema).parquet(f"{folder}/data")
    if quality is not None:
        report = quality(staged) if callable(quality) else quality
        report.write.parquet(f"{folder}/quality")
        parts.append((QUALITY, f"{folder}/quality"))
        if not spark.read.parquet(f"{folder}/quality").where(F.col("status") == "FAIL").isEmpty():
            raise QualityGateError(f"the quality report {folder}/quality contains FAIL rows; nothing was published")
    if csv:
        split(staged.repartition(*partition_by).write if partition_by else staged.write).option("header", True).csv(f"{folder}/csv")
        parts.append((CSV, f"{folder}/csv"))
    move_pointer(spark, directory, parts)
    return folder


def read_published(spark: SparkSession, directory: str, part: int = DATA, number: int | None = None) -> DataFrame:
    """A part of the newest set, or of the set with a ``number``."""
    parts = read_pointer(spark, directory, number)
    if part not in parts:
        raise FileNotFoundError(f"{directory} has no such part of a published set")
    return spark.read.option("header", True).csv(parts[part]) if part == CSV else spark.read.parquet(parts[part])


def write_curated(df: DataFrame, directory: str, partition_by: list[str] | None = None) -> str:
    """Parquet and CSV copies of the curated table in one set, split by a coarse key when one is given."""
    return publish_set(df, directory, partition_by=partition_by, csv=True)


def publish_if_clean(df: DataFrame, quality: DataFrame | Callable[[DataFrame], DataFrame], directory: str) -> str:
    """Publish table and report together, only when no check failed (see :func:`publish_set`)."""
    return publish_set(df, directory, quality)


def saved_files(spark: SparkSession, directory: str, kind: str = "parquet") -> DataFrame:
    """One row per data file in a folder and below: path, bytes, rows, columns and their names.

    Sizes come from the file listing, rows from one scan that reads no data column of Parquet, names from the
    files' own schema; files without rows are listed too.
    """
    read = spark.read.option("header", True).option("recursiveFileLookup", True).format(kind).load(directory)
    # names and sizes alone: the contents are not read
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(directory)
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:///")  # noqa: E731 - local paths are spelt in two ways
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # given as a URL
    counted = read.groupBy(local(named).alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    out = listed.select(local(F.col("path")).alias("path"), F.col("length").alias("bytes")).join(counted, "path", "left")
    return out.select(
        "path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(len(read.columns)).cast("bigint").alias("columns"), F.lit(", ".join(read.columns)).alias("column_names")
    )


def load_manifest(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows and columns per saved file."""
    cols = [c for c in df.columns if c != path]
    return df.groupBy(path).agg(
        F.count(F.lit(1)).alias("rows"),
        F.first(F.lit(len(cols))).cast("bigint").alias("columns"),
        F.first(F.lit(", ".join(cols))).alias("column_names"),
    )


def publish_tables(tables: dict[str, DataFrame], database: str | None = None) -> DataFrame:
    """Save tables (or temp views without a database) and return one load record per table."""
    spark = next(iter(tables.values())).sparkSession
    records = None
    for name, df in tables.items():
        if database:
            df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
            loaded = spark.table(f"{database}.{name}")
        else:
            df.createOrReplaceTempView(name)
            loaded = df
        row = load_record(loaded, name)
        records = row if records is None else records.unionByName(row)
    return records


def load_record(df: DataFrame, name: str) -> DataFrame:
    """Quality record of a finished load."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing_values")).select(
        F.lit(f"table:{name}").alias("dataset"),
        F.when(F.col("rows") == 0, "FAIL").otherwise("PASS").alias("status"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "missing_values",
        F.when(F.col("rows") == 0, "table is empty").otherwise("ok").alias("notes"),
    )


class QualityGateError(RuntimeError):
    """The quality report holds a FAIL row, so the data was not published."""
