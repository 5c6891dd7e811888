"""Keyed merges of batch tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelcast.operators.quality import assert_unique
from panelcast.sources.pointer import move_pointer, read_sizes


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Insert new keys; for known keys keep the stored row and only fill its missing ``fill`` columns.

    Running the same merge twice gives the same table.
    """
    cols = stored.columns
    old = stored.withColumn("_old", F.lit(True))
    joined = old.alias("o").join(incoming.select(*cols).alias("n"), keys, "full_outer")
    known = F.col("_old").isNotNull()
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in fill:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*out)


PART_ROWS = 2_000_000  # rows above which a part of a merged table is split
HASH_BITS = 48  # bits of the key's hash that parts are told by


def _code(depth: Column) -> Column:
    """Number of the part of ``depth`` bits that a row with hash ``_h`` is in: a one, then the hash's low bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), depth)
    return one + F.col("_h").bitwiseAND(one - 1)


def _placed(rows: DataFrame, keys: list[str], leaves: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` with ``_leaf``, the one part of ``leaves`` that holds their key, and what else ``leaves`` says of it.

    A part is a node of a binary trie over the low bits of the key's hash, so a row has one candidate per depth
    that occurs and just one of them exists.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << HASH_BITS)))
    candidates = F.array(*[_code(F.lit(d)) for d in depths])
    return hashed.withColumn("_leaf", F.explode(candidates)).join(leaves, "_leaf")


def merge_table(spark, directory: str, incoming: DataFrame, keys: list[str], fill: list[str], parts: int = 1, part_rows: int = PART_ROWS) -> DataFrame:
    """Apply ``upsert`` to a versioned Parquet table and return it.

    The table lies in parts by the hash of the key, an extendible hash directory: a part that would pass
    ``part_rows`` is split into as many as hold it, so folders, tasks and the share that a merge rewrites follow
    the table's size. Only parts that ``incoming`` touches are read, merged and written anew; a new pointer then
    names all parts with their rows. A job that dies before the pointer leaves the old table as it was, and a
    reader of an older version keeps its files. A new table starts with ``parts`` parts, a power of two. A part
    that cannot be split further, as its rows share a hash, stays larger. The driver holds one entry per part.
    """
    if parts < 1 or parts & (parts - 1):
        raise ValueError("parts must be a power of two")
    assert_unique(incoming, keys)
    now = read_sizes(spark, directory) or {parts + i: (None, 0) for i in range(parts)}
    if any(rows is None for _, rows in now.values()):
        raise ValueError(f"{directory} is no merged table with counted parts")
    depths = sorted({leaf.bit_length() - 1 for leaf in now})
    leaves = spark.createDataFrame([(leaf,) for leaf in now], "_leaf long")
    arrived = {r["_leaf"]: r["count"] for r in _placed(incoming.select(*keys), keys, leaves, depths).groupBy("_leaf").count().collect()}
    if not arrived:
        kept = [path for path, _ in now.values() if path]
        return spark.read.schema(incoming.schema).parquet(*kept) if kept else incoming
    grown = {}  # touched part: depth after the merge, from stored plus incoming rows, which bound the merged ones
    for leaf, n in arrived.items():
        depth, bound = leaf.bit_length() - 1, now[leaf][1] + n
        grown[leaf] = min(HASH_BITS, depth + max(0, math.ceil(math.log2(bound / part_rows))))
    known = [now[leaf][0] for leaf in grown if now[leaf][0]]
    merged = upsert(spark.read.schema(incoming.schema).parquet(*known), incoming, keys, fill) if known else incoming
    touched = spark.createDataFrame(list(grown.items()), "_leaf long, _depth int")
    target = _placed(merged, keys, touched, sorted({leaf.bit_length() - 1 for leaf in grown})).withColumn("_part", _code(F.col("_depth")))
    fresh = [(1 << d) + low for leaf, d in grown.items() for low in range(leaf - (1 << leaf.bit_length() - 1), 1 << d, 1 << leaf.bit_length() - 1)]
    version = f"{directory}/data-{uuid.uuid4().hex}"
    target.drop("_h", "_leaf", "_depth").repartition(len(fresh), "_part").write.partitionBy("_part").parquet(version)
    stored = spark.read.option("basePath", version).schema(StructType([*incoming.schema.fields, StructField("_part", LongType())])).parquet(version)
    sizes = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}
    now = {leaf: entry for leaf, entry in now.items() if leaf not in grown}
    now |= {p: (f"{version}/_part={p}" if p in sizes else None, sizes.get(p, 0)) for p in fresh}
    move_pointer(spark, directory, [(p, *now[p]) for p in sorted(now)])
    return spark.read.schema(incoming.schema).parquet(*[path for path, _ in now.values() if path])


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the largest ``order`` (map-side combined, no window)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def snapshot_errors(table: DataFrame, forecast: str = "point_forecast", actual: str = "actual") -> DataFrame:
    """Errors of saved forecasts whose actual has been published."""
    err = F.col(actual) - F.col(forecast)
    return table.where(F.col(actual).isNotNull()).withColumns({"error": err, "absolute_error": F.abs(err)})
