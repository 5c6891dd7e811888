"""What the text operators share: input columns, shared folders, salted joins, worker caches, components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.stage import checkpoint_folder, fresh_folder

#: The six ASCII white-space characters; words are what lies between them. Fixed value.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet in the folder that the cluster shares and continue from the files.

    Cuts the lineage: a lost executor rereads the files, and several readers share one computation.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(folds: int) -> Column:
    """Fold of a document: crc32 of its id as text modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join rows to a table with one row per key without sending a hot key to one task.

    ``spread`` picks one of ``salts`` copies of the key's row, so it must vary among the rows of a key.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Bits of the filter below: at most 2**17 words of 64 bits, so the table that is broadcast never exceeds 2 MB.
FILTER_BITS = 1 << 23


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, flag: str | None = None) -> DataFrame:
    """Rows whose key may be among the wanted: none of those is lost, a few others pass.

    A join that follows then shuffles little more than its result. A null key is not among them. With ``flag``
    all rows stay and that column tells.
    """
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    words = wanted.select(bit(wanted_key).alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 AS INT)))").alias("_bits"))
    marked = rows.withColumn("_b", F.when(F.col(key).isNotNull(), bit(key))).withColumn("_w", F.shiftright("_b", 6))
    set_ = F.expr("coalesce(shiftrightunsigned(_bits, cast(_b & 63 AS INT)) & 1, 0) = 1")
    if flag:
        return marked.join(F.broadcast(words), "_w", "left").withColumn(flag, set_).drop("_w", "_b", "_bits")
    return marked.join(F.broadcast(words), "_w").where(set_).drop("_w", "_b", "_bits")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks. Callers bound its size.

    A worker serves one operator after another: asking for another name forgets what the last one kept.
    """
    holder = sys.modules.setdefault("panelcast_worker_cache", types.ModuleType("panelcast_worker_cache"))
    kept = vars(holder).setdefault("kept", {})
    if name not in kept:
        kept.clear()
    return kept.setdefault(name, {})


def slices(batch, text_column: int, chars: int = 1 << 20):
    """An Arrow batch in parts of about ``chars`` characters of text, at least one row each."""
    import pyarrow.compute as pc

    lengths, low = pc.utf8_length(batch.column(text_column)).fill_null(0).to_pylist(), 0
    while low < batch.num_rows:
        high, total = low, 0
        while high < batch.num_rows and (high == low or total + lengths[high] <= chars):
            total += lengths[high]
            high += 1
        yield batch.slice(low, high - low)
        low = high


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component), component the smallest id reachable.

    Alternates the two star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Minima are pre-aggregated per task, so a hub costs one row per task; each round is
    written to the shared folder. Ends when a round changes nothing; raises if ``max_rounds`` are not enough
    (the rounds grow with the logarithm of the longest path).
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = written(now), None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, ["a"], F.col("b"), "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, down, ["a"], F.col("b"), "inner")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct())
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark == seen:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = mark
    raise RuntimeError(f"no components after {max_rounds} rounds")


__all__ = ["SPACES", "ascii_lower", "checkpoint_folder", "components", "crc_fold", "fresh_folder", "id_and_text", "maybe_in", "partitions", "salted_join", "slices", "table", "worker_cache", "written"]
