"""Byte-level BPE encoding and decoding with a segment tree of pair ranks over byte positions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from panelcast.llm.common import id_and_text, slices, worker_cache

NONE = 1 << 30  # rank of a pair that is no token
REMEMBERED = 1_000_000  # pieces a worker remembers, in two generations: about 200 MB at most
SHORT = 64  # bytes up to which pieces are merged together, as rows of one array
LANES = 8192


class ByteBPE:
    """Encoder and decoder for ranks ``{bytes: id}`` and a pattern that cuts texts into pieces.

    A piece that is a token is its own id. Else its bytes are the leaves of a segment tree that holds, per
    position, the rank of the pair starting there; the root names the leftmost pair of least rank. A merge
    changes three leaves: the merged pair's, its right token's (gone) and its left neighbour's, each a walk to
    the root. Live neighbours are linked lists over positions.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.ranks, self.ids = ranks, {i: t for t, i in ranks.items()}
        # the pattern's white space is the Unicode property, which leaves out the separators 1C to 1F
        self.find = regex.compile(pattern).findall
        self.careful = regex.compile(r"(?<!\s) (?!\s)").split
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pair = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    # ---- one piece of any length: scalar tree

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece; each merge costs three walks of logarithmic length."""
        n, get = len(piece), self.pair.get
        token = self.byte_ids[list(piece)].tolist()
        size = 1 << max(n - 1, 1).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = get(token[i] << 32 | token[i + 1], NONE)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, rank: int) -> None:
            at += size
            tree[at] = rank
            at >>= 1
            while at:
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while tree[1] < NONE:
            least, at = tree[1], 1
            while at < size:
                at = 2 * at if tree[2 * at] == least else 2 * at + 1
            at -= size
            right = after[at]
            token[at] = least
            after[at] = nxt = after[right]
            put(right, NONE)
            if nxt < n:
                before[nxt] = at
            put(at, get(least << 32 | token[nxt], NONE) if nxt < n else NONE)
            if (prev := before[at]) >= 0:
                put(prev, get(token[prev] << 32 | least, NONE))
        out, at = [], 0
        while at < n:
            out.append(token[at])
            at = after[at]
        return out

    # ---- many short pieces at once: one tree per row

    def _rank(self, left, right):
        import numpy as np

        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NONE)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of at most SHORT bytes; the same tree walks for all rows in step."""
        import numpy as np

        n = np.array([len(p) for p in pieces])
        size = 1 << int(max(n.max() - 1, 1)).bit_length()
        width = size + 2  # column size stands for "no neighbour"
        rows = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        token = np.zeros((rows, width), np.int64)
        token[:, :size] = self.byte_ids[raw]
        tree = np.full((rows, 2 * size), NONE, np.int64)
        live = np.arange(size)[None, :] < n[:, None]
        ranks = self._rank(token[:, : size - 1], token[:, 1:size])
        tree[:, size : 2 * size - 1] = np.where(live[:, 1:], ranks, NONE)
        for level in range(size.bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        after[np.arange(rows), n - 1] = size  # past the last token
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        before[:, 0] = size

        def put(r, at, rank):
            at = at + size
            tree[r, at] = rank
            at = at >> 1
            while at[0]:
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
                at = at >> 1

        busy = np.nonzero(tree[:, 1] < NONE)[0]
        while len(busy):
            r = busy
            least, at = tree[r, 1], np.ones(len(r), np.int64)
            for _ in range(size.bit_length() - 1):
                at = 2 * at + (tree[r, 2 * at] != least)
            at -= size
            right = after[r, at]
            nxt = after[r, right]
            token[r, at] = least
            live[r, right] = False
            after[r, at] = nxt
            put(r, right, np.full(len(r), NONE))
            has = nxt < size
            before[r[has], nxt[has]] = at[has]
            put(r, at, np.where(has, self._rank(least, token[r, nxt]), NONE))
            prev = before[r, at]
            has = prev < size
            if has.any():
                put(r[has], prev[has], self._rank(token[r[has], prev[has]], least[has]))
            busy = r[tree[r, 1] < NONE]
        flat = token[:, :size][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]

    # ---- texts

    def _merged(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        import numpy as np

        done, short = {}, []
        for p in pieces:
            if (whole := self.ranks.get(p)) is not None:
                done[p] = whole.to_bytes(4, "little")
            elif len(p) <= SHORT:
                short.append(p)
            else:
                done[p] = np.array(self.merge_long(p), "<u4").tobytes()
        short.sort(key=len)  # rows of like size share an array
        for i in range(0, len(short), LANES):
            done.update(zip(short[i : i + LANES], self.merge_short(short[i : i + LANES])))
        return done

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: a space between two others that are no space starts one."""
        parts = self.careful(text) if "  " in text else text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; equal parts are merged once."""
        chunks = [self._chunks(text) for text in texts]
        young, old, unseen = self.young, self.old, []
        for c in set().union(*chunks).difference(young):
            if (known := old.get(c)) is not None:
                young[c] = known
            else:
                unseen.append(c)
        cut = {c: [p.encode() for p in self.find(c)] for c in unseen}
        done = self._merged(list({p for ps in cut.values() for p in ps}))
        young.update({c: b"".join([done[p] for p in ps]) for c, ps in cut.items()})
        out = [b"".join(map(young.__getitem__, parts)) for parts in chunks]
        for c in unseen:
            if len(c) > 256:  # long parts hardly come again
                del young[c]
        if len(young) > REMEMBERED // 2:
            self.old, self.young = young, {"": b""}
        return out

    def decoded(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.ids.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a rank file."""
    cache = worker_cache("byte_bpe")
    if (path, pattern) not in cache:
        cache[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return cache[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every whole text, in one pass without a shuffle.

    Null and empty texts have no ids. Rows are encoded each by itself: repeated rows and null ids give rows.
    """

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = byte_bpe(ranks_path, pattern)
        for b in batches:
            for part in slices(b, 1):
                packed = coder.packed(part.column(1).to_pylist())
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded bytes' digest of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = byte_bpe(ranks_path, pattern)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            lists = b.column(1)
            for i in range(b.num_rows):
                ids = lists[i].values
                packed = b"" if ids is None else np.asarray(ids.to_numpy(zero_copy_only=False)).astype("<u4").tobytes()
                out[0].append(len(packed) // 4)
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(hashlib.sha256(coder.decoded(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
