"""Document fingerprints by I-Match: hashes of the terms of several randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.llm.common import SPACES, ascii_lower, partitions

SUBSETS = 24  # per density
DIGITS = 6  # hexadecimal digits of a subset's hash
COMMON = 0.05  # terms in more than this share of documents lie below the band
OWN = 0.25  # share of a text's terms that the band holds at least; below it all terms are taken
LOAD = 0.5  # band terms that a subset of the chosen density holds, at least


def terms(text: Column) -> Column:
    """Distinct words of a text as 64-bit hashes, A-Z as lower case."""
    hashes = F.array_distinct(F.transform(F.split(ascii_lower(text), SPACES + "+"), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))  # what stands before a leading or after a trailing space


def common_terms(docs: DataFrame, share: float = COMMON, least: int = 2) -> list[int]:
    """Terms whose inverse document frequency lies below the band: in more than ``share`` of all distinct documents.

    Documents with the same set of terms count once, however many there are. A term is in no more sets than rows,
    so sets are counted only for terms in enough rows. Fewer than (mean distinct words of a row) * rows / sets /
    share terms are, so what is collected and compared with does not grow with the corpus.
    """
    sets = docs.select(terms(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    sets = sets.select(F.xxhash64(F.sort_array("t")).alias("s"), "t")
    n, distinct = docs.count(), sets.select("s").distinct().count()
    enough = F.col("count") > max(share * distinct, least)
    counts = sets.select(F.explode("t").alias("t")).groupBy("t").count()
    often = sorted(r.t for r in counts.where(enough).select("t").collect())
    if n == distinct or not often:
        return often
    once = sets.select("s", F.explode(F.array_intersect("t", F.lit(often))).alias("t")).distinct()
    return sorted(r.t for r in once.groupBy("t").count().where(enough).select("t").collect())


def fingerprint(found: Column, common: list[int]) -> list[Column]:
    """The steps from distinct terms to the fingerprint, as columns to be added one after another.

    The band's terms are those not ``common``, or all if these are less than OWN of the text's: near copies that are
    a large part of the corpus would else be known only by the words in which they differ. The band's other edge is the rarest term of the corpus. A lexicon subset
    of density 2**-level is one class of a random partition of all terms into 2**level; there are SUBSETS of
    them for the level at which a subset holds about one term of the text, and as many for the next level, so
    that two texts of nearly equal size share a level. A subset's hash is that of its sorted terms, empty if it
    has none.
    """
    band = F.array_except(found, F.lit(common)) if common else found
    band = F.when(F.size(band) >= OWN * F.size(found), band).otherwise(found) if common else band
    size = F.size(band)
    level = F.when(size > 0, F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)) / F.lit(LOAD))))).otherwise(-1).cast("int")
    return [band.alias("band"), level.alias("level")]


def _subsets(band: Column, width: Column) -> Column:
    """(subset, term) of the SUBSETS subsets of one density 1 / width, sorted: subset j is class j mod width of
    the partition numbered j div width."""
    rounds = F.greatest(F.ceil(F.lit(float(SUBSETS)) / width), F.lit(1)).cast("int")
    number = lambda t, r: r.cast("long") * width + F.pmod(F.xxhash64(t, r), width)

    def one(r: Column) -> Column:
        own = F.filter(band, lambda t: number(t, r) < SUBSETS)  # few are left to be made pairs of
        return F.transform(own, lambda t: F.struct(number(t, r).alias("j"), t.alias("t")))

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), one)))


def _hashes(placed: Column) -> Column:
    """Per subset the hash of its sorted terms, as a number of DIGITS + 1 hexadecimal digits; 0 if it has none."""
    first = 16**DIGITS

    def one(j: Column) -> Column:
        own = F.filter(placed, lambda e: e["j"] == j)
        return F.when(F.size(own) > 0, F.pmod(F.xxhash64(F.transform(own, lambda e: e["t"])), F.lit(first)) + first).otherwise(F.lit(0).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)


def with_fingerprint(rows: DataFrame, text: str, common: list[int], name: str) -> DataFrame:
    """``rows`` plus ``name``: struct of level, the hashes of two densities, and the fingerprint as text.

    A text without a word has level -1 and the hash of its words in order; its likeness to another
    is 1 if they are equal and 0 else. Equal texts have equal fingerprints.
    """
    t, b, lv, w, p, q = (f"_{name}_{x}" for x in ("t", "b", "lv", "w", "p", "q"))
    rows = rows.withColumn(t, terms(F.col(text)))
    rows = rows.withColumn(b, fingerprint(F.col(t), common)[0])
    rows = rows.withColumn(lv, fingerprint(F.col(b), [])[1])
    rows = rows.withColumn(w, F.pow(F.lit(2.0), F.greatest(F.col(lv), F.lit(0))).cast("long"))
    # from SUBSETS classes on, the first SUBSETS of either density lie in the same few terms
    few = F.when(F.col(w) >= SUBSETS, F.filter(F.col(b), lambda x: F.pmod(F.xxhash64(x, F.lit(0)), F.col(w)) < SUBSETS)).otherwise(F.col(b))
    rows = rows.withColumn(b, few)
    rows = rows.withColumn(p, _subsets(F.col(b), F.col(w))).withColumn(q, _subsets(F.col(b), F.col(w) * 2))
    rows = rows.withColumn(p, _hashes(F.col(p))).withColumn(q, _hashes(F.col(q)))
    shown = lambda c: F.array_join(F.transform(F.col(c), lambda h: F.when(h == 0, "-").otherwise(F.hex(h))), "")
    plain = F.concat(F.lit("-:"), F.sha2(F.concat_ws(" ", F.transform(F.col(t), lambda x: x.cast("string"))).cast("binary"), 256))
    whole = F.when(F.col(lv) < 0, plain).otherwise(F.concat(F.col(lv).cast("string"), F.lit(":"), shown(p), F.lit(":"), shown(q)))
    out = F.struct(F.col(lv).alias("level"), F.col(p).alias("dense"), F.col(q).alias("sparse"), whole.alias("text"))
    return rows.withColumn(name, out).drop(t, b, lv, w, p, q)


def with_likeness(rows: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: the share of equal hashes among the subsets that either of the fingerprints ``x`` and
    ``y`` has terms of, at the densities both have; 1 for equal fingerprints, 0 without a common density."""
    a, b, lx, ly = F.col(x), F.col(y), F.col(f"{x}.level"), F.col(f"{y}.level")
    none = F.array().cast("array<bigint>")
    left = F.when(lx == ly, F.concat(a["dense"], a["sparse"])).when(lx + 1 == ly, a["sparse"]).when(ly + 1 == lx, a["dense"]).otherwise(none)
    right = F.when(lx == ly, F.concat(b["dense"], b["sparse"])).when(lx + 1 == ly, b["dense"]).when(ly + 1 == lx, b["sparse"]).otherwise(none)
    both = f"_{name}_both"
    rows = rows.withColumn(both, F.zip_with(left, right, lambda p, q: F.when(p != q, 1).when(p == 0, 0).otherwise(2)))
    equal = F.size(both) - F.size(F.array_remove(both, 2))
    either = F.size(F.array_remove(both, 0))
    share = F.when(a["text"] == b["text"], 1.0).when((lx < 0) | (ly < 0), 0.0).otherwise(equal / F.greatest(either, F.lit(1)))
    return rows.withColumn(name, share).drop(both)


def fingerprints(docs: DataFrame, common: list[int] | None = None) -> DataFrame:
    """doc_id and ``fingerprint`` (struct with the readable ``text``) of every row; a null text counts as empty.

    One pass for the document frequencies and one over the texts. Repeated rows and null ids give rows.
    """
    common = common_terms(docs) if common is None else common
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return with_fingerprint(rows, "_text", common, "fingerprint").drop("_text")


def _block(doc_id: Column, splits: list[int]) -> Column:
    """Number of splits at or below the id, by binary search over the fixed list; null ids come first."""
    at = F.lit(0)
    step = 1 << max(len(splits).bit_length() - 1, 0)
    while step and splits:
        nxt = F.get(F.lit(splits), at + F.lit(step - 1))
        at = at + F.when(nxt <= doc_id, step).otherwise(0)
        step >>= 1
    return at


def with_next(docs: DataFrame, rows_of: list[str], blocks: int | None = None, prepare=lambda heads: heads) -> DataFrame:
    """Rows (doc_id, columns of ``rows_of``) plus ``next``, those columns of the row with the next higher id, and
    the range ``_block``, the order ``_order`` within an id, and ``_after``: the first row of the following range, as ``prepare``
    makes it from these few rows.

    The last row is followed by the first; rows with one id are ordered by the hash of the text. Ids are cut
    into ranges of like size; a window works inside a range, and a range's last row gets the first of the next
    range by a join on the range, which needs no further shuffle of the texts.
    """
    n = blocks or partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first().c
    block = _block(F.col("doc_id"), sorted(set(cuts or [])))
    rows = docs.withColumns({"_block": block, "_order": F.xxhash64(*rows_of)})
    # a range's first id from the ids alone, then its row; a null id comes before all others
    first = docs.select(block.alias("_at"), "doc_id").groupBy("_at").agg(F.when(F.count_if(F.col("doc_id").isNull()) == 0, F.min("doc_id")).alias("_id"))
    found = rows.join(F.broadcast(first), (F.col("_block") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")))  # one row per range
    heads = found.groupBy("_block").agg(F.min_by(F.struct(*rows_of), "_order").alias("_head"))
    heads = prepare(heads.select("_block", "_head.*"))
    heads = heads.select("_block", F.struct(*[c for c in heads.columns if c != "_block"]).alias("_head"))
    every = W.partitionBy(F.lit(0)).orderBy("_block")  # one row per range
    around = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("_block", F.coalesce(F.lead("_head").over(every), F.first("_head").over(around)).alias("_after"))
    inside = rows.withColumn("next", F.lead(F.struct(*rows_of)).over(W.partitionBy("_block").orderBy("doc_id", "_order")))
    joined = inside.join(heads, "_block", "left")
    far = F.struct(*[F.col(f"_after.{c}").alias(c) for c in rows_of])
    return joined.withColumn("next", F.coalesce("next", far))


def against_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint against that of its edited text and of the next document.

    The edited text has the last quarter (floor) of the code points replaced by the first as many, or all, of
    the next document in id order.
    """
    common = common_terms(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    near = with_next(rows, ["_text"], prepare=lambda heads: with_fingerprint(heads, "_text", common, "_own"))
    marked = with_fingerprint(near, "_text", common, "_own")
    cut = F.floor(F.length("_text") / 4).cast("int")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 4) AS INT))"), F.substring(F.col("next._text"), F.lit(1), cut))
    both = with_fingerprint(marked.withColumn("_edited", edited), "_edited", common, "_changed")
    # a follower in the same range has its fingerprint already; a range's last row gets the next head's
    following = F.lead("_own").over(W.partitionBy("_block").orderBy("doc_id", "_order"))
    both = both.withColumn("_other", F.coalesce(following, F.col("_after._own")))
    both = with_likeness(with_likeness(both, "_own", "_changed", "near_edited"), "_own", "_other", "near_next")
    return both.select(
        "doc_id", F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("_own.text").alias("fingerprint"), F.col("_changed.text").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
