"""Clusters of integer vectors by Lloyd's rounds in which only vectors whose bound has expired are looked at.

Every cluster keeps a heap of its vectors' gaps: the distance to the second nearest centroid less that to the
own one, plus the drift the cluster had seen when the vector was put there. The drift a cluster accumulates in
a round is how far its own centroid moved plus how far any other did. A vector keeps its cluster for certain
while its key is above the accumulated drift, so a round pops the heap's head up to that drift and no more.

The heap lies in the shared folder as sorted runs, one a round: rows in order of (cluster, key), with their
vector. Popping is a range read of each run, which Parquet's row groups and pages answer by their statistics;
what was popped is scanned against all centroids and pushed as the next run. Drifts only grow, so a row popped
once lies below every later range and no run is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh_folder, written

#: Components beyond this are refused: the squared distance of 64 such differences would not fit a long.
LARGEST = 1 << 27
#: Relative allowance for rounding in bounds; an early pop costs a scan, a late one would be an error.
ROUNDING = 1e-9
#: Bounds of a parquet run: small row groups and pages, so that a range read skips most of a run.
RUN = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "1000"}
SCHEMA = "vec_id long, v array<int>, old int, cluster int, key double"


def whole_vectors(vectors: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): rows whose ``embedding`` has ``size`` finite components, each turned into floor(scale * x).

    Other columns are not read. A component of 2 ** 27 or more after scaling raises an error.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    checked = F.when(fits, x).otherwise(F.raise_error(F.lit(f"a scaled component of {LARGEST} or more")))
    rows = vectors.where((F.size(x) == size) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("x"))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id; equal hashes in order of their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r.v for r in rows.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _matrix(column):
    """An Arrow list column of equal lengths as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.empty((0, 0), np.int64)


def _squared(v, centroids):
    """Exact squared distances [vector, centroid]."""
    import numpy as np

    return np.stack([np.einsum("ij,ij->i", d, d) for d in (v - c for c in centroids)], axis=1)


def scanned(rows: DataFrame, centroids: list[list[int]], drift: list[float]) -> DataFrame:
    """``rows(vec_id, v, old)`` with their nearest centroid and the key under which its heap holds them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at = np.array(centroids, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                far = _squared(_matrix(part.column(1)), at)
                own = np.argmin(far, axis=1)  # the first of equal ones
                each = np.arange(len(own))
                upper = np.sqrt(far[each, own].astype(np.float64))
                if len(at) > 1:
                    far[each, own] = np.iinfo(np.int64).max
                    lower = np.sqrt(far.min(axis=1).astype(np.float64))
                    seen = np.array(drift)[own]
                    # above the drift in any case: what was popped lies at or below it; one without a gap is popped at the next move
                    key = np.maximum(lower - upper - ROUNDING * (lower + upper + 1) + seen, np.nextafter(seen, np.inf))
                else:
                    key = np.full(len(own), np.finfo(np.float64).max)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(own.astype(np.int32)), pa.array(key)], ["vec_id", "v", "old", "cluster", "key"]
                )

    return rows.mapInArrow(run, SCHEMA)


def push(rows: DataFrame) -> str:
    """Write rows as one sorted run of the heaps; every task writes its own rows, whatever their cluster."""
    path = fresh_folder(rows.sparkSession)
    rows.sortWithinPartitions("cluster", "key").write.options(**RUN).parquet(path)
    return path


def head(runs: DataFrame, low: list[float], high: list[float] | None) -> DataFrame:
    """The heaps' rows with low < key <= high of their cluster, or all above low; a filter the scan is given."""

    def own(c: int) -> Column:
        above = (F.col("cluster") == c) & (F.col("key") > low[c])
        return above & (F.col("key") <= high[c]) if high else above

    return runs.where(reduce(Column.__or__, [own(c) for c in range(len(low))]))


def moved_sums(run: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per cluster how many vectors came less those that left, and the change of the sum of their components.

    Summed within each task first; at most two rows a task and cluster are shuffled.
    """

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[int, list] = {}
        for batch in batches:
            v, old, new = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in np.union1d(old, new).tolist():
                if c >= 0:
                    came, left = new == c, old == c
                    held = sums.setdefault(c, [0, 0])
                    held[0] += int(came.sum()) - int(left.sum())
                    held[1] = held[1] + v[came].sum(axis=0) - v[left].sum(axis=0)
        if sums:
            rows = [(c, p, x) for c, (n, s) in sums.items() for p, x in enumerate([n, *s.tolist()])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "x"])

    changed = run.where("old <> cluster").select("v", "old", "cluster").mapInArrow(partial, "cluster int, place int, x long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in changed.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("cluster", "place").collect():
        n, sums = out.get(r.cluster, (0, []))
        out[r.cluster] = (int(r.x), sums) if r.place == 0 else (n, [*sums, int(r.x)])
    return out


def moved_means(counts: list[int], sums: list[list[int]], centroids: list[list[int]]) -> list[list[int]]:
    """The exact floor of each cluster's mean; an empty cluster's centroid stays."""
    return [[s // n for s in own] if n else at for n, own, at in zip(counts, sums, centroids)]


def grown(drift: list[float], before: list[list[int]], after: list[list[int]]) -> list[float]:
    """Accumulated drift of every cluster after its centroid and the others have moved."""
    went = [sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 for a, b in zip(before, after)]
    others = [max((w for j, w in enumerate(went) if j != c), default=0.0) for c in range(len(went))]
    return [d + (w + o) * (1 + ROUNDING) for d, w, o in zip(drift, went, others)]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors(vec_id, embedding)``; see :func:`whole_vectors` for which are kept. Centroids start as the k
    kept vectors with the smallest sha256 of ``seed:vec_id``; each of ``rounds`` rounds assigns every vector to
    the nearest (squared Euclidean distance, ties to the smaller number) and replaces every centroid by the
    exact floor of its vectors' mean; an empty cluster's stays. Then all are assigned once more. distance is the
    squared one, summed over the cluster and over all in the inertias.

    A null id is hashed as an empty one and kept; repeated rows count each. With fewer than k vectors there are
    as many clusters as vectors; without any there are no rows. Only centroids, counts and sums, k rows of
    them, come to the driver.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors))
    centroids = first_centroids(rows, k, seed)
    drift, counts, sums = [0.0] * len(centroids), [0] * len(centroids), [[0] * len(c) for c in centroids]
    if not centroids:
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    runs = [push(scanned(rows.withColumn("old", F.lit(-1)), centroids, drift))]
    for _ in range(rounds):
        for c, (n, change) in moved_sums(spark.read.schema(SCHEMA).parquet(runs[-1])).items():
            counts[c] += n
            sums[c] = [s + x for s, x in zip(sums[c], change)]
        before, centroids = centroids, moved_means(counts, sums, centroids)
        popped_to, drift = drift, grown(drift, before, centroids)
        if before == centroids:
            break  # no later round moves anything
        expired = head(spark.read.schema(SCHEMA).parquet(*runs), popped_to, drift)
        runs.append(push(scanned(expired.select("vec_id", "v", F.col("cluster").alias("old")), centroids, drift)))
    return described(head(spark.read.schema(SCHEMA).parquet(*runs), drift, None), centroids)


def described(live: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The live rows with their distance, the inertias and the digest of their centroid."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at = np.array(centroids, np.int64)
        for batch in batches:
            own = batch.column(2).to_numpy()
            d = _matrix(batch.column(1)) - at[own] if len(own) else np.empty((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", d, d))], ["vec_id", "cluster", "distance"])

    rows = written(live.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids])
    return rows.select(
        "vec_id", "cluster", "distance", per_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"),
    )
