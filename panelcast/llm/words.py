"""Words of Arrow text columns as 64-bit hashes, computed on whole byte buffers."""

from __future__ import annotations

BLOCK = 2 << 20  # bytes hashed at once; a longer word is hashed whole


def _mix(x):
    """A bijective finisher on unsigned 64-bit integers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables():
    import numpy as np

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    signs = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]
    return space, np.where(space, np.uint64(0), signs)


def hash_words(column):
    """(hashes, bounds): the hash of every word of an Arrow string column and where each row's words begin.

    A-Z count as lower case; words are what lies between ASCII white space. ``bounds`` has one entry more than
    there are rows. Null rows have no words.
    """
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base:end]
    edges = offsets - base
    space, signs = _tables()
    step = np.uint64(0xD6E8FEB86659FD93)
    hashes, places, at = [], [], 0
    size = end - base
    while at < size:
        stop = min(at + BLOCK, size)
        while stop < size and not space[raw[stop]]:  # a block ends where a word does
            stop += 1
        part = raw[at:stop]
        word = ~space[part]
        new = word.copy()
        new[1:] &= ~word[:-1]
        inside = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, stop, "left")] - at
        inside = inside[(inside > 0) & (inside < len(part))]
        new[inside] = word[inside]  # a row's first sign starts a word whatever stands before it
        starts = np.flatnonzero(new)
        if len(starts):
            lead = int(starts[0])
            gaps = np.diff(np.append(starts, len(part)))
            place = np.arange(len(part) - lead) - np.repeat(starts - lead, gaps)
            power = np.cumprod(np.full(int(gaps.max()) + 1, step, np.uint64))
            sums = np.add.reduceat(signs[part[lead:]] * power[place], starts - lead)
            length = np.add.reduceat(word[lead:].astype(np.uint64), starts - lead)
            hashes.append(_mix(sums + length))
            places.append(starts + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    found = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(found, edges, "left")


def shingle_sets(column, size: int):
    """(hashes, bounds): per row the distinct hashes of its runs of ``size`` words, ascending.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    import numpy as np

    words, cut = hash_words(column)
    n = np.diff(cut)
    out, ends = [], [0]
    factors = _mix(np.arange(7, 7 + size, dtype=np.uint64))
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            runs += words[j : len(words) - size + 1 + j] * factors[j]
        runs = _mix(runs)
    for a, m in zip(cut[:-1].tolist(), n.tolist()):
        if m >= size:
            own = np.unique(runs[a : a + m - size + 1])
        elif m:
            own = _mix((words[a : a + m] * factors[:m]).sum(keepdims=True) + np.uint64(m))
        else:
            own = words[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else words[:0]), np.array(ends, np.int64)
