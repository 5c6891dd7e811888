"""Near duplicates: b-bit MinHash with band candidates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.llm.common import components, id_and_text, maybe_in, partitions, salted_join, slices, written
from panelcast.llm.words import shingle_sets

BANDS, ROWS, BITS = 24, 4, 4
#: Two documents at the threshold of 0.8 share no band with probability 0.59 ** 24 = 3e-6; estimates from 96
#: minima of 4 bits have a standard error of 0.043 there, so 0.2 of slack loses as few.
SLACK = 0.2
BUCKET = 2048  # a larger bucket is one candidate group without estimates: only more pairs to confirm
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_500_000  # what one confirming task holds of a candidate group, at most about twice
PIVOTS = 16  # members of a large candidate group that meet all others


def _minima(hashes, bounds):
    """Per row and hash function the least value; rows without shingles are left out of ``bounds``."""
    import numpy as np

    from panelcast.llm.words import _mix

    starts = bounds[:-1]
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    seeds = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for lo in range(0, len(starts), 64):  # a few rows at a time stay in the cache
        hi = min(lo + 64, len(starts))
        own = hashes[bounds[lo] : bounds[hi]]
        cut = starts[lo:hi] - bounds[lo]
        for k in range(BANDS * ROWS):
            out[lo:hi, k] = np.minimum.reduceat((own + seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), cut)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, one key per band, and the packed low bits of the minima."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from panelcast.llm.words import _mix

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                hashes, cut = shingle_sets(part.column(1), words)
                n = np.diff(cut)
                some = np.flatnonzero(n)
                first, second = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys, sigs = [None] * len(n), [None] * len(n)
                if len(some):
                    starts = cut[:-1][some]
                    first[some] = np.add.reduceat(_mix(hashes + np.uint64(1)), starts)
                    second[some] = np.bitwise_xor.reduceat(_mix(hashes + np.uint64(2)), starts)
                    least = _minima(hashes, np.append(starts, len(hashes)))
                    band = np.zeros((len(some), BANDS), np.uint64)
                    for r in range(ROWS):
                        band = _mix(band + least[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                    low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
                    packed = low[:, 0::2] | low[:, 1::2] << BITS
                    for i, b, s in zip(some.tolist(), band.view(np.int64).tolist(), packed):
                        keys[i], sigs[i] = b, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary")


def similarity(left, right):
    """Estimated similarity of packed signatures: equal fields, corrected for those equal by chance."""
    import numpy as np

    x = left ^ right
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (1 - unequal / (BANDS * ROWS) - chance) / (1 - chance)


def _forest(m: int, linked) -> list[tuple[int, int]]:
    """Tree edges of the graph of m nodes whose row i of neighbours is ``linked(i, open)`` among the open nodes."""
    import numpy as np

    free, out = np.ones(m, bool), []
    for seed in range(m):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue and free.any():
            i = queue.pop()
            for j in np.flatnonzero(linked(i, free) & free).tolist():
                free[j] = False
                out.append((i, j))
                queue.append(j)
    return out


def candidate_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that join all documents of a bucket whose estimates reach the threshold less the slack.

    Buckets are streamed in order of their key. The links are a forest per bucket: never all pairs.
    """
    bar = threshold - SLACK

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def emit(ids, sigs, last_key, keys):
            """Links inside the complete buckets of these sorted rows."""
            bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(bounds, len(keys)))
            two = bounds[sizes == 2]
            good = two[similarity(sigs[two], sigs[two + 1]) >= bar] if len(two) else two
            a, b = [ids[good]], [ids[good + 1]]
            for lo, m in zip(bounds[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = sigs[lo : lo + m]
                tree = np.array(_forest(m, lambda i, _: similarity(own[i], own) >= bar), np.int64).reshape(-1, 2)
                a.append(ids[lo + tree[:, 0]])
                b.append(ids[lo + tree[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held = None  # rows of the last bucket, which may go on
        hub = None  # (key, id) of a bucket too large for estimates
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
            if hub is not None:
                same = int(np.searchsorted(keys, hub[0], "right"))
                if same:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(same, hub[1])), pa.array(ids[:same])], ["a", "b"])
                    keys, ids, sigs = keys[same:], ids[same:], sigs[same:]
                if not len(keys):
                    continue
                hub = None
            if held is not None:
                keys, ids, sigs = np.concatenate([held[0], keys]), np.concatenate([held[1], ids]), np.concatenate([held[2], sigs])
            tail = int(np.searchsorted(keys, keys[-1], "left"))
            if tail:
                yield emit(ids[:tail], sigs[:tail], None, keys[:tail])
            held = keys[tail:], ids[tail:], sigs[tail:]
            if len(held[1]) > BUCKET:
                hub = held[0][0], held[1][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[1]), hub[1])), pa.array(held[1])], ["a", "b"])
                held = None
        if held is not None and len(held[0]):
            yield emit(held[1], held[2], None, held[0])

    n = partitions(reps.sparkSession)
    rows = reps.select(F.explode("bands").alias("key"), "rep", "sig").repartition(n, "key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def _parts(n, shingles):
    """Number of blocks that hold ``n`` sets of ``shingles`` shingles together."""
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def blocked(groups: DataFrame) -> DataFrame:
    """Members of the candidate groups ``(rep, cand, n_shingles)`` with the number of blocks ``nb`` of their group, their
    own ``blk``, and whether they are one of the PIVOTS members that visit every block."""
    sizes = groups.groupBy("cand").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    member = salted_join(groups, sizes.select("cand", _parts(F.col("m"), F.col("s")).alias("nb")), ["cand"], F.col("rep"), "inner")
    member = written(member.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")))
    order = W.partitionBy("cand").orderBy(F.xxhash64("rep", F.lit(5)), "rep")
    pivots = member.where("nb > 1").select("cand", "rep", F.row_number().over(order).alias("_n")).where(F.col("_n") <= PIVOTS)
    return member.join(pivots.select("rep", F.lit(True).alias("pivot")), "rep", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))


def confirmed_links(docs: DataFrame, member: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of members whose full sets reach the threshold, a forest per confirming task.

    ``member(rep, cand, tasks)``: the members of a candidate group that share one of the ``tasks`` (i, j) meet in it.
    """
    mine = maybe_in(id_and_text(docs), "doc_id", member.select(F.col("rep").alias("doc_id")), "doc_id")
    texts = mine.join(member, F.col("doc_id") == F.col("rep"), "inner").select("cand", "rep", "text", F.explode("tasks").alias("_t"))
    copies = texts.select("cand", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), "rep", "text")
    rows = copies.repartition(partitions(docs.sparkSession), "cand", "i", "j").sortWithinPartitions("cand", "i", "j", "rep")

    def confirm(ids, sets) -> list[tuple[int, int]]:
        import numpy as np

        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            return [(ids[0], ids[1])] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) and both else []
        length = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        cut = np.concatenate([[0], np.cumsum(length)])
        owner = np.repeat(np.arange(len(sets)), length)
        order = np.argsort(code, kind="stable")
        listed, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])

        def linked(i, free):
            own = code[cut[i] : cut[i + 1]]
            lo, n = start[own], start[own + 1] - start[own]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            both = np.bincount(listed[at], minlength=len(sets))
            return (100 * both >= percent * (length + length[i] - both)) & (both > 0)

        return [(ids[a], ids[b]) for a, b in _forest(len(sets), linked)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, ids, sets, out = None, [], [], []
        for batch in batches:
            for part in slices(batch, 4, 1 << 20):
                hashes, cut = shingle_sets(part.column(4), words)
                keys = list(zip(*[part.column(c).to_pylist() for c in range(3)]))
                for r, k in enumerate(keys):
                    if k != key:
                        if len(ids) > 1:
                            out += confirm(ids, sets)
                        key, ids, sets = k, [], []
                    ids.append(part.column(3)[r].as_py())
                    sets.append(hashes[cut[r] : cut[r + 1]].copy())
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["a", "b"])
                    out = []
        if len(ids) > 1:
            out += confirm(ids, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def linked_components(docs: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) over all links of ``groups(rep, cand, n_shingles)`` that full sets confirm.

    Every block of a group is one task, which the group's pivots visit as well: members of a large group of near
    copies are joined through these, and each text is copied once and a pivot's once a block. What lies in one component by then
    needs no further comparison; only members outside their group's largest component, the rest, still meet every
    block. A rest that is the group itself costs all pairs of blocks; no link is lost in either case.
    """
    one = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    member = written(blocked(groups))
    visits = F.when(F.col("pivot"), F.transform(every(F.col("nb")), lambda i: one(i, F.lit(0)))).otherwise(F.array(one(F.col("blk"), F.lit(0))))
    links = written(confirmed_links(docs, member.select("rep", "cand", visits.alias("tasks")), words, percent))
    found = components(links)
    large = member.where("nb > 1").join(found, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep"))
    roots = large.groupBy("cand", "root").agg(F.count(F.lit(1)).alias("n"))
    main = roots.groupBy("cand").agg(F.max(F.struct("n", "root")).alias("_m")).select("cand", F.col("_m.root").alias("main"))
    told = written(salted_join(large.select("cand", "rep", "n_shingles", "nb", "blk", "root"), main, ["cand"], F.col("rep"), "inner").withColumn("rest", F.col("root") != F.col("main")))
    spread = told.where("rest").groupBy("cand").agg(_parts(F.count(F.lit(1)), F.sum("n_shingles")).alias("nr"))
    asked = salted_join(told, spread, ["cand"], F.col("rep"), "inner")
    own = F.pmod(F.xxhash64("rep", F.lit(9)), F.col("nr"))
    meets = F.transform(every(F.col("nr")), lambda i: one(i, F.col("blk")))
    comes = F.when(F.col("rest"), F.transform(every(F.col("nb")), lambda j: one(own, j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    asked = written(asked.select("rep", "cand", F.array_union(meets, comes).alias("tasks")))
    if asked.isEmpty():
        return found
    more = confirmed_links(docs, asked, words, percent)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class; class representatives meet in band buckets; estimates from packed
    low bits form candidate groups; in these the full sets confirm links (100 * intersection >= percent *
    union); components run over the confirmed links. component_id is the smallest id reachable.

    A null or empty text has no shingles, links with nothing and stays. A null id links with nothing either:
    its component_id is null and it stays. Several texts under one id count as one document with all their
    links, and n_shingles is each row's own. Other columns are not read. No rows give no rows.
    """
    rows = written(signatures(docs, words))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(reps)
    cands = components(candidate_links(reps, percent / 100)).withColumnsRenamed({"node": "rep", "component": "cand"})
    groups = reps.select("rep", "n_shingles").join(cands, "rep").groupBy("rep", "cand").agg(F.max("n_shingles").alias("n_shingles"))
    linked = linked_components(docs, written(groups), words, percent)
    classes = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").where("n > 1 OR component IS NOT NULL")
    classes = classes.select("set_a", "set_b", F.coalesce("component", "rep").alias("_class"))
    keyed = rows.select("doc_id", "n_shingles", "set_a", "set_b").withColumn("set_a", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_a")))
    out = salted_join(keyed, classes, ["set_a", "set_b"], F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce("_class", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, one document of each group of near duplicates; a kept id keeps all its rows."""
    gone = written(near_groups(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"))
    kept = rows.join(gone, F.col("_doc") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
