"""Token ids in Parquet list columns, in document order, with selective reads of metadata or tokens."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.llm.common import fresh_folder, id_and_text, partitions, slices
from panelcast.llm.subwords import word_encoder

SCHEMA = "shard int, doc_id long, at long, n_tokens long, tokens array<int>"
#: Parquet settings: format version 2 delta-encodes the ascending metadata; token ids, of which there are few
#: different ones, get a dictionary; small pages with a page index let a reader skip inside a row group.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#at": "false",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.page.row.count.limit": "2000", "parquet.page.size": str(256 << 10),
    "parquet.columnindex.truncate.length": "64", "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, row_group_bytes: int = 32 << 20) -> None:
    """Write the ids of every text, ``end_id`` appended, to Parquet files in ascending ``doc_id`` order.

    One file per range of ids (``shards``, the session's shuffle partitions unless given). A row holds its
    shard, id, place ``at`` within the shard, length and ids. Ranges are cut by id, then by the hash of the
    text, so that one repeated id does not fill a shard alone. A null text holds the end id only; rows with a
    null id come first; repeated rows are written each; other columns are left out; no rows give no files'
    rows, which :func:`read_tokens` reads as an empty table.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).repartitionByRange(shards or partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, shard, at = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                ids, ends = encoder.encode(part.column(1), end_id)
                n = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), part.column(0), pa.array(at + ends[:-1]), pa.array(n), lists],
                    ["shard", "doc_id", "at", "n_tokens", "tokens"],
                )
                at += int(ends[-1])

    out = rows.mapInArrow(encode, SCHEMA).write
    for k, v in {**LAYOUT, "parquet.block.size": str(row_group_bytes)}.items():
        out = out.option(k, v)
    out.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; select columns or filter on doc_id to read only their pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard with the number of ids before it, from two metadata columns; no token page is read."""
    sums = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file: stays the size of the file list
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, read back from the files."""

    def checksum(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(3)
            flat, cut = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), lists.offsets.to_numpy()
            places = (4 * cut.astype(np.int64)).tolist()
            crcs = [crc32(flat[x:y]) for x, y in zip(places, places[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(cut).astype(np.int64)), pa.array(crcs, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    sums = read_tokens(spark, path).select("shard", "doc_id", "at", "tokens").mapInArrow(checksum, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(shard_starts(spark, path)), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` and return the index read back from the files."""
    path = path or fresh_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return token_index(docs.sparkSession, path)
