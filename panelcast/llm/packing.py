"""Packing documents into sequences of a fixed length: best fit, then swap-based local search."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import id_and_text, slices, written
from panelcast.llm.subwords import word_encoder

GROUP = 8192  # pieces that one search sees
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Token pieces of every whole text, ``end_id`` appended: doc_id, piece, start, length, ids_crc32 [, ids].

    Only documents longer than ``capacity`` are cut, into pieces of that length; the last may be shorter. A null
    or empty text is the end id alone. Rows are treated each by itself: repeated rows give repeated pieces.
    ``lean`` gives the same rows with less memory and more time in the workers.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = word_encoder(tokenizer, lean)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for part in slices(batch, 1, 1 << 20 if lean else 2 << 20):
                ids, ends = encoder.encode(part.column(1), end_id)
                per_doc = -(-np.diff(ends) // capacity)
                piece = np.arange(int(per_doc.sum())) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                low = np.repeat(ends[:-1], per_doc) + piece * capacity
                high = np.minimum(low + capacity, np.repeat(ends[1:], per_doc))
                raw = memoryview(ids).cast("B")
                crcs = [crc32(raw[x:y]) for x, y in zip((4 * low).tolist(), (4 * high).tolist())]
                rows = [part.column(0).take(pa.array(np.repeat(np.arange(len(per_doc)), per_doc))), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array((high - low).astype(np.int32)), pa.array(crcs, pa.int64())]
                if with_ids:
                    rows.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(rows, names)

    return id_and_text(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def search(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions) for items that each fit: best fit of the longest first, then local search.

    The search takes the emptiest bin and tries, for its items from the longest: a move into the bin that it
    fills best; an exchange with one shorter item, or with two that are shorter together, of a fuller bin.
    Each step adds to the sum of squared fills, so it ends; a bin that empties is gone. Bins from which nothing
    helps are left for good once tried with no change. It stops at the least number of bins that the sum allows.
    """
    from bisect import bisect_left, insort

    bins: list[list[int]] = []
    room: list[int] = []
    order: list[tuple[int, int]] = []  # (room, bin), sorted: the tightest bin that still takes an item
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(order, (lengths[i], -1))
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = left - lengths[i]
        if room[b]:
            insort(order, (room[b], b))
    least = -(-sum(lengths) // capacity)
    alive, idle = {b for b in range(len(bins)) if room[b]}, set()
    count = len(bins)

    def better(i: int, mine: int) -> tuple[int, list[int]] | None:
        """The bin and what leaves it for item ``i`` of bin ``mine``: nothing, one item or two."""
        need, best = lengths[i], None
        for b in alive:
            if b == mine or room[b] > room[mine]:  # only fuller bins gain
                continue
            if need <= room[b]:
                gain, out = need, []
            else:
                over = need - room[b]  # what must leave at least; what leaves must be shorter than the item
                gain, out = 0, []
                sizes = sorted((lengths[j], j) for j in bins[b])
                at = bisect_left(sizes, (over, -1))
                if at < len(sizes) and sizes[at][0] < need:
                    gain, out = need - sizes[at][0], [sizes[at][1]]
                low, high = 0, len(sizes) - 1
                while low < high:  # the lightest two that make room
                    two = sizes[low][0] + sizes[high][0]
                    if two < over:
                        low += 1
                    else:
                        if two < need and need - two > gain:
                            gain, out = need - two, [sizes[low][1], sizes[high][1]]
                        high -= 1
            if gain and (best is None or (gain, room[mine] - room[b]) > best[0]):
                best = ((gain, room[mine] - room[b]), b, out)
                if best[0][0] == need and room[b] == need:
                    break
        return best and (best[1], best[2])

    while count > least and alive - idle:
        victim = max(alive - idle, key=lambda b: (room[b], -b))
        changed = False
        for i in sorted(bins[victim], key=lambda i: (-lengths[i], i)):
            if (step := better(i, victim)) is None:
                continue
            b, out = step
            bins[victim].remove(i)
            bins[b].append(i)
            for j in out:
                bins[b].remove(j)
                bins[victim].append(j)
            given = lengths[i] - sum(lengths[j] for j in out)
            room[victim] += given
            room[b] -= given
            if not room[b]:
                alive.discard(b)
            changed = True
            idle.discard(b)
            break
        if not bins[victim]:
            alive.discard(victim)
            count -= 1
            idle.clear()
        elif not changed:  # nor does anything help a bin with items of the same lengths
            own = sorted(lengths[i] for i in bins[victim])
            idle.update(b for b in alive if room[b] == room[victim] and sorted(lengths[i] for i in bins[b]) == own)
    return [b for b in bins if b]


def _place(capacity: int, last: bool):
    """The search over one group of rows (_row, length); which of its bins are dealt again."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_row").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = search(lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        at = np.empty(len(pdf), np.int64)
        seq = np.empty(len(pdf), np.int64)
        again = np.zeros(len(pdf), bool)
        rows = pdf["_row"].tolist()
        first = [min(rows[i] for i in b) for b in bins]  # a sequence is named after one of its items
        # at most half of the bins, the emptiest, are dealt again: their length at least halves every turn, ties or not
        emptiest = set(sorted(range(len(bins)), key=lambda k: (fill[k], first[k]))[: len(bins) // 2])
        for k, b in enumerate(bins):
            where = 0
            for i in b:
                at[i], seq[i] = where, first[k]
                where += lengths[i]
                again[i] = not last and fill[k] < capacity and k in emptiest
        return pd.DataFrame({"_row": pdf["_row"], "length": pdf["length"], "sequence_id": seq, "offset": at, "_again": again})

    return run


def pack(items: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """``items`` (with a column ``length`` of 1 to ``capacity``) plus sequence_id and offset.

    Full items are sequences of their own. The rest is dealt evenly into groups of about ``group`` items, by a
    hash of the row's place so that repeated rows spread, and each group is searched by itself. The items of the
    emptier half of a group's bins are dealt again, until one group holds them all; what is dealt again has at most
    half the length of the turn before, so this ends. Every sequence has its items at gapless offsets from 0. No
    rows give no rows; columns of ``items`` that have the names of the new ones are replaced.
    """
    held = written(items.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    other = [f for f in held.schema.fields if f.name != "_row"]
    full = held.where(F.col("length") >= capacity).select(*[f.name for f in other], F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = held.where(F.col("length") < capacity)
    left, turn, done = rest.select("_row", "length"), 0, []
    while True:
        n, size = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = min(-(-n // group), size // (4 * capacity))  # a group holds several bins' length, however short its items
        last = groups <= 1

        dealt = left.withColumn("_g", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(max(groups, 1))))
        placed = written(dealt.groupBy("_g").applyInPandas(_place(capacity, last), "_row long, length int, sequence_id long, offset long, _again boolean"))
        done.append(placed.where("not _again").select("_row", "sequence_id", "offset"))
        if last:
            break
        left, turn = placed.where("_again").select("_row", "length"), turn + 1
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    return rest.join(places, "_row").select(*[f.name for f in other], "sequence_id", "offset").unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; ``packed`` comes from pieces made ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
