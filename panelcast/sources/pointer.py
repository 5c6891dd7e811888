"""Which folders hold the current version of a table: numbered pointers that are added, never replaced."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _entries(spark: SparkSession, directory: str) -> list[str]:
    """Names in a folder of the file system that Spark sees; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(spark: SparkSession, directory: str) -> list[int]:
    return sorted(int(n.split("-")[1]) for n in _entries(spark, directory) if n.startswith("pointer-"))


def read_pointer(spark: SparkSession, directory: str, number: int | None = None) -> dict[int, str]:
    """Folder per part that the highest finished pointer names, or the one with a number; empty before the first write.

    Data without any finished pointer is an error: a first write that died before its pointer, or a folder that
    lost its pointers, must not pass for an empty table.
    """
    for n in reversed(_numbers(spark, directory)) if number is None else [number]:
        pointer = f"{directory}/pointer-{n}"
        if "_SUCCESS" in _entries(spark, pointer):
            rows = spark.read.schema("part long, path string").parquet(pointer).where("path IS NOT NULL").collect()
            return {r.part: r.path for r in rows}
    if any(n.startswith("data-") for n in _entries(spark, directory)):
        raise RuntimeError(f"{directory} has data but no finished pointer; remove the folder or restore its pointers")
    return {}


def read_sizes(spark: SparkSession, directory: str) -> dict[int, tuple[str | None, int]]:
    """Folder and rows per part of the current version; an empty part has no folder."""
    read_pointer(spark, directory)  # raises if data has lost its pointer
    for n in reversed(_numbers(spark, directory)):
        pointer = f"{directory}/pointer-{n}"
        if "_SUCCESS" in _entries(spark, pointer):
            return {r.part: (r.path, r.rows) for r in spark.read.schema("part long, path string, rows long").parquet(pointer).collect()}
    return {}


def move_pointer(spark: SparkSession, directory: str, parts: list[tuple]) -> None:
    """Add the next pointer from (part, path) or (part, path, rows); two writers at once collide on its name instead
    of losing one's work."""
    number = (_numbers(spark, directory) or [0])[-1] + 1
    schema = "part long, path string" + (", rows long" if len(parts[0]) == 3 else "")
    rows = spark.createDataFrame(parts, schema).coalesce(1)
    rows.write.mode("errorifexists").parquet(f"{directory}/pointer-{number}")
