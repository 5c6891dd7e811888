"""Near duplicates by SimHash: majority fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import components, id_and_text, salted_join, slices, written

#: Fingerprints in a strip at most (two strips are one task's work, 2 MB each), and strips at least, for enough tasks.
STRIP, STRIPS = 1 << 18, 12
TILE = 256  # fingerprints in a tile; 256 x 2048 words of 8 bytes fit a core's cache
RUN_TILES = 8  # tiles of the other strip compared at once
HELD_LINKS = 500_000  # links held before they are merged into the forest
QUARTERS = 4  # population counts of 16 bits each, besides that of all 64


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator:
    """Hashes of a text's shingles, repeats included, in arrays of some 100,000."""
    import numpy as np
    from xxhash import xxh64_intdigest

    own = text.lower().split()  # of bytes: A-Z alone, and the six ASCII white-space characters
    if not own:
        return
    if len(own) <= words:
        yield np.array([xxh64_intdigest(b" ".join(own), seed)], np.uint64)
        return
    for low in range(0, len(own) - words + 1, 100_000):
        part = own[low : low + 100_000 + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(part) - words + 1].tolist()
        stops = ends[words - 1 :].tolist()
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """64 bits, each set if more than half of the shingles' hashes set it; 0 without words."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp the 64 bits as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def strips(reps: DataFrame) -> tuple[DataFrame, int]:
    """``reps(fp, rep)`` written with the number of their strip, and how many strips there are.

    Strips are ranges in the order of population counts, of all bits and of quarters, so that tiles cut from
    them span few counts. The number is fixed when the table is written.
    """
    counts = [F.bit_count("fp")] + [F.bit_count(F.expr(f"shiftrightunsigned(fp, {16 * q}) & 65535L")) for q in range(QUARTERS)]
    n = reps.count()
    k = max(1, min(STRIPS, n // (32 * TILE)), -(-n // STRIP))
    ordered = reps.select("fp", "rep", F.array(*counts).alias("_order")).repartitionByRange(k, "_order", "fp")
    return written(ordered.select("fp", "rep", F.spark_partition_id().alias("strip"))), k


def _sorted_tiles(fp):
    """Positions in order of population counts, and each tile's least and greatest counts."""
    import numpy as np

    counts = np.stack([np.bitwise_count(fp)] + [np.bitwise_count((fp >> np.uint64(16 * q)) & np.uint64(0xFFFF)) for q in range(QUARTERS)]).astype(np.int16)
    order = np.lexsort((fp, counts[4], counts[3], counts[2], counts[1]))
    counts = counts[:, order]
    at = np.arange(0, len(fp), TILE)
    return order, np.minimum.reduceat(counts, at, axis=1), np.maximum.reduceat(counts, at, axis=1)


def _merge(label, a, b) -> None:
    """Give linked positions one label, the smallest, in rounds of hooking and pointer jumping."""
    import numpy as np

    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def close_in_strips(x, y, radius: int, same: bool):
    """A star forest over two strips of fingerprints, as (position, position) arrays; y's follow x's.

    Tiles whose population counts, of all bits or summed over the quarters, differ beyond the radius are
    skipped: each bit that differs changes one count by one. All others are compared by exclusive or and bit
    counts. Memory is that of one row of tiles, never of the links.
    """
    import numpy as np

    ox, lox, hix = _sorted_tiles(x)
    oy, loy, hiy = (ox, lox, hix) if same else _sorted_tiles(y)
    sx, sy = x[ox], y[oy]
    label = np.arange(len(x) if same else len(x) + len(y))
    px, py, found, n = ox, oy if same else oy + len(x), ([], []), 0
    for t in range(lox.shape[1]):
        gap = np.maximum(0, np.maximum(loy - hix[:, t : t + 1], lox[:, t : t + 1] - hiy))
        near = np.flatnonzero((gap[0] <= radius) & (gap[1:].sum(axis=0) <= radius))
        if same:
            near = near[near >= t]
        tile, own = sx[t * TILE : (t + 1) * TILE], px[t * TILE : (t + 1) * TILE]
        for low in range(0, len(near), RUN_TILES):
            at = (near[low : low + RUN_TILES, None] * TILE + np.arange(TILE)).ravel()
            at = at[at < len(sy)]
            r, c = np.nonzero(np.bitwise_count(tile[:, None] ^ sy[at][None, :]) <= radius)
            a, b = own[r], py[at[c]]
            new = label[a] != label[b]
            found[0].append(a[new])
            found[1].append(b[new])
            n += len(found[0][-1])
            if n > HELD_LINKS:
                _merge(label, *map(np.concatenate, found))
                found, n = ([], []), 0
    if n:
        _merge(label, *map(np.concatenate, found))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def links(reps: DataFrame, radius: int) -> DataFrame:
    """(a, b): a forest per pair of strips that joins the ``rep`` of fingerprints within the radius."""
    rows, k = strips(reps)
    # every strip meets every strip, itself included: k copies of 16 bytes a fingerprint
    pairs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: F.struct(F.least(F.col("strip"), o).alias("i"), F.greatest(F.col("strip"), o).alias("j")))
    copies = rows.withColumn("_p", F.explode(pairs)).select(F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "strip", "fp", "rep")
    dealt = copies.repartition(k * (k + 1), "i", "j").sortWithinPartitions("i", "j", "strip", "fp")

    def compare(ids, fps, strip):
        import numpy as np
        import pyarrow as pa

        ids, fps, strip = np.concatenate(ids), np.concatenate(fps).view(np.uint64), np.concatenate(strip)
        cut = int(np.searchsorted(strip, strip[0], "right"))
        same = cut == len(strip)
        a, b = close_in_strips(fps[:cut], fps[:cut] if same else fps[cut:], radius, same)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        pair, held = None, ([], [], [])

        for batch in batches:
            i, j, strip, fp, rep = (batch.column(c).to_numpy() for c in range(5))
            new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else []
            for low, high in zip(new, [*new[1:], len(i)]):
                if pair != (i[low], j[low]):
                    # a pair of which one strip is empty or which has one strip only is nothing to compare, unless it is (i, i)
                    if pair and (pair[0] == pair[1] or held[2][0][0] != held[2][-1][-1]):
                        yield compare(*held)
                    pair, held = (i[low], j[low]), ([], [], [])
                for h, c in zip(held, (rep, fp, strip)):
                    h.append(c[low:high])
        if pair and (pair[0] == pair[1] or held[2][0][0] != held[2][-1][-1]):
            yield compare(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts are taken in lower case (A-Z) as words between ASCII white space; a shingle is ``words`` words joined
    by a space, repeats included, or the whole sequence where there are fewer. Fingerprints that differ in at
    most ``radius`` bits are linked, all of them and exactly; component_id is the smallest id reachable.

    A null or empty text, or one of white space alone, has fingerprint zero and is linked like any other. A
    null id links with nothing and has a null component. Repeated rows stay; several texts under one id are one
    document with all their links. Other columns are not read. No rows give no rows.
    """
    rows = written(fingerprints(docs, words, seed))
    known = rows.where("doc_id IS NOT NULL")
    reps = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # an id with several fingerprints joins their groups; a group's own ids are joined through its least one
    several = known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    more = known.join(several, "doc_id", "left_semi").distinct().join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links(reps, radius).unionByName(more)).withColumnsRenamed({"node": "rep", "component": "_class"})
    classes = reps.join(found, "rep", "left").select(F.col("fp").alias("_fp"), F.coalesce("_class", "rep").alias("component_id"))
    keyed = rows.withColumn("_fp", F.when(F.col("doc_id").isNotNull(), F.col("fp")))
    out = salted_join(keyed, classes, ["_fp"], F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
