"""One query per text operator, with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import byte_bpe, centroids, chat, exact, imatch, lm, neardup, packing, secret_scan, simhash, token_files, token_pairs, toxicity
from panelcast.llm.common import crc_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written in id order and read back: place, length and checksum."""
    return token_files.encoded_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


@query
def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with its place, score and the forest's decision."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


@query
def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how near it is to its edited text's and the next document's."""
    return imatch.against_edits(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those equal to it."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), digests=True)


ORACLE["op4_exact_dedup"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""


@query
def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted(turns.unionByName(own))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded from them."""
    ranks, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), piece_pattern()
    return byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)


@query
def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from those outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs.withColumn("held", crc_fold(10) == 0))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the labels outside the held-out fold."""
    return toxicity.fit(docs, labels.where(crc_fold(3) != 1))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "score").select("doc_id", (crc_fold(3) == 1).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates on 4-word shingles."""
    return neardup.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op10_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces placed in sequences of 4096 ids."""
    own = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return packing.pack(own).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op11_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of two tokenizers, its links weighed by how many documents hold them."""
    return token_pairs.aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's cluster after ten rounds."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def rounds_sql(k: int, rounds: int, seed: int, size: int = 64) -> str:
    """Lloyd's rounds as a chain of tables: nearest(vec) of each round, then the floors of its means."""
    steps = [f"""vecs AS MATERIALIZED (
        SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM vecs ORDER BY c LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT vecs.n, c{r}.c, list_sum(list_transform(list_zip(vecs.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vecs, c{r}) GROUP BY n)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM (
        SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM a{r} JOIN vecs USING (n), range(1, {size + 1}) t(i) GROUP BY c, i) GROUP BY c),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN vecs USING (n) JOIN c{rounds} USING (c)"""


ORACLE["op12_centroids"] = rounds_sql(k=8, rounds=10, seed=3)


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its component of fingerprints within four bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, seed=42, radius=4)
