"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is still grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import SPACES, salted_join, written

PREFIX = 64  # code points of the normalised text in the second level's hash
#: Bits of the filter that tells the last scan which rows are still in a group: at most 2**17 words of 64 bits,
#: so the table that is broadcast never exceeds 2 MB, whatever the input. A false hit only costs one more hash.
FILTER_BITS = 1 << 23


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _levels(docs: DataFrame) -> DataFrame:
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), normalised(F.col("text")).alias("_norm"))
    return norm.withColumns({
        "_len": F.length("_norm"), "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX)),
        "_chars": F.coalesce(F.length("text"), F.lit(0)), "_text": F.xxhash64("text"),
    })


def _bit() -> Column:
    return F.pmod(F.xxhash64("_len", "_prefix"), F.lit(FILTER_BITS))


def _refined(docs: DataFrame, digests: bool) -> tuple[DataFrame, DataFrame]:
    """The rows that had their full hash taken (``_hit``: those of surviving groups), and the rest."""
    narrow = written(_levels(docs).select("doc_id", "_len", "_prefix"))
    lengths = narrow.groupBy("_len").count().where("count > 1").select("_len")
    prefixes = narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count().where("count > 1")
    words = prefixes.select(_bit().alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 AS INT)))").alias("_bits"))
    words = F.broadcast(words)

    def suspect(df: DataFrame) -> DataFrame:
        hit = F.expr("coalesce(shiftrightunsigned(_bits, cast(_b & 63 AS INT)) & 1, 0) = 1")
        return df.withColumn("_b", _bit()).withColumn("_w", F.shiftright("_b", 6)).join(words, "_w", "left").withColumn("_hit", hit)

    rows = suspect(_levels(docs))
    if not digests:
        rows = rows.where("_hit")
    full = written(rows.select("doc_id", "_chars", "_text", "_hit", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")))
    if digests:
        return full, full.where("not _hit").select("doc_id", "text_sha256")
    return full, suspect(narrow).where("not _hit").select("doc_id", F.lit(None).cast("string").alias("text_sha256"))


def _best(full: DataFrame) -> DataFrame:
    """Per text that occurs more than once: how often, and the row that stays (most code points, least id)."""
    order = F.struct("_chars", (-F.col("doc_id")).alias("neg"), "_text")
    groups = full.where("_hit").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("_best"))
    return groups.where("group_size > 1").select("text_sha256", "group_size", (-F.col("_best.neg")).alias("keep_id"), F.col("_best._text").alias("_keep_text"), F.lit(True).alias("_grouped"))


def exact_groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; of equal texts the one with the most code points
    stays, then the smallest id. First level: counts per normalised length. Second: rows of lengths that occur
    more than once, counted by prefix hash. Third: the texts are read again and only those of surviving groups
    get the full hash; ``digests`` asks for it on all rows (else text_sha256 is null for a text without a copy).

    Null texts equal empty ones. Rows repeated with one id count as rows of the group and all carry the same
    result. A null id is an id of its own, after all others. Other columns are not read. No rows give no rows.
    """
    full, single = _refined(docs, digests)
    found = salted_join(full.where("_hit"), _best(full), ["text_sha256"], F.col("doc_id"))
    found = found.select(
        "doc_id", F.when(F.col("_grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256",
    )
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = found.unionByName(single)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, one row of each group of equal texts.

    Rows are told by id and text; of rows repeated with both, the smallest in all columns (as JSON) stays.
    """
    full, _ = _refined(docs, digests=False)
    found = salted_join(full.where("_hit"), _best(full), ["text_sha256"], F.col("doc_id"), "inner")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_text") == F.col("_keep_text"))
    marks = written(found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_mark")).agg(F.bool_or(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    joined = rows.join(marks, (F.col("_text") == F.col("_mark")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    out = joined.where("_stays IS NULL OR (_stays AND _n = 1)").select("_row")
    if not marks.where("_stays AND _n > 1").isEmpty():
        again = joined.where("_stays AND _n > 1").groupBy("_doc", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        out = out.unionByName(again.select("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
