"""Alignment of two tokenizers on the same bytes, and how often their tokens stand for each other corpus-wide.

Texts are encoded by a byte-level BPE (A) and a piece vocabulary (B). Byte offsets at which a token of both ends
cut the tokens into groups; every A and B occurrence of a group is a link. A pair of ids counts the documents
that hold it linked.

Counting is external. Documents are taken in chunks of bounded size; a chunk's pair-document records become one
sorted run of (pair, documents of the chunk that hold it), cut by radix of the A id and compressed with zstd. A
task takes one radix: a heap merges its runs by A id, so all records of a side come together, are counted, and
give the side's highest count; the answers stream back along the runs, one number and one mark per record, to
the chunks that asked. Chunks then add up what their documents' links are worth. A pair in every document is
one record a chunk, so a hot pair or a hot id is small work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import id_and_text, partitions, worker_cache, written

#: Characters of a chunk (a longer text is a chunk alone) and segments that a worker remembers: some 100 MB.
CHUNK_CHARS, REMEMBERED, REMEMBERED_CHARS = 2 << 20, 250_000, 16 << 20
#: Characters of the corpus for each radix of a run: a task then merges some millions of records.
RADIX_CHARS = 128 << 20
WIDE = 4096  # links of a group beyond which its distinct ids are paired with their multiplicities instead

#: Letters of Latin scripts and ASCII punctuation, as parts of a character class.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"

PART = "chunk long, part int, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n long, body binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*arrays) -> bytes:
    """Unsigned integer arrays in one zstd frame, each with its length in front."""
    import numpy as np
    import zstandard

    raw = b"".join(np.array([len(a)], "<u8").tobytes() + np.ascontiguousarray(a, "<u8").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(body: bytes) -> list:
    import numpy as np
    import zstandard

    flat, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<u8"), [], 0
    while at < len(flat):
        n = int(flat[at])
        out.append(flat[at + 1 : at + 1 + n].astype(np.int64))
        at += 1 + n
    return out


class Aligner:
    """Encodes segments with both tokenizers and remembers their groups, links and digest texts.

    A text is cut where neither tokenizer joins: before a space or line feed that follows a sign that is no white
    space, and before ASCII punctuation that follows a Latin letter. A's pattern always ends a match there, and B
    has no piece across such a place (both are checked), so a text's tokens are its segments' tokens in order.
    """

    def __init__(self, bytes_path: str, pieces_path: str):
        import json
        import os
        import re

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces_path)
        shown = {c: bytes([i]) for i, c in enumerate(_byte_signs())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = b"".join(shown.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        joined = any(re.search(rf"[^▁]▁|\n|[{LATIN}][{MARKS}]", p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        if joined or not json.loads(self.a.to_str())["pre_tokenizer"].get("use_regex") or max(len(self.a_bytes), len(pieces)) >= 1 << 20:
            raise ValueError("vocabularies that segments cannot serve")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_texts, self.b_texts = ([[f"{i}{end}" for i in range(len(t))] for end in ends] for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", ""))))
        self.line = self.b.encode("\n")
        self.cut = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{LATIN}])(?=[{MARKS}])").split
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.index: dict[str, int] = {}
        self.texts: list[str] = []  # groups in digest form
        self.broken: set[int] = set()  # segments whose tokens do not give back their bytes
        self.chars = 0
        self.sums = [np.empty((0, 4), np.int64)]  # A tokens, B tokens, groups, links of each segment
        self.links = [np.empty((0, 2), np.int64)]  # distinct links, A id << 20 | B id, and how often each occurs
        self.link_sizes = [np.empty(0, np.int64)]  # distinct links of each segment

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text, none for an empty text."""
        return self.cut(" " + text) if text else []

    def tables(self):
        """sums, links and link_sizes as one array each."""
        import numpy as np

        for name in ("sums", "links", "link_sizes"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.sums[0], self.links[0], self.link_sizes[0]

    def learn(self, segments: list[str]) -> None:
        """Encode segments and keep what they hold."""
        self.chars += sum(map(len, segments))
        for low in range(0, len(segments), 10_000):
            some = segments[low : low + 10_000]
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # B puts a space before what it is given; after a line feed, which it joins with nothing, nothing changes
            skip = len(self.line)
            b = [ids[skip:] for ids in self.b.encode(["\n" + s for s in some], num_threads=1)]
            for s in some:
                self.index[s] = len(self.index)
            raw = [s.encode() for s in some]
            whole = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw)]
            self.broken.update(len(self.texts) + i for i, w in enumerate(whole) if not w)
            self._keep([x if w else [] for x, w in zip(a, whole)], [y if w else [] for y, w in zip(b, whole)])

    def _keep(self, a: list[list[int]], b: list[list[int]]) -> None:
        """Groups and links of some segments, given as the ids of both tokenizers over the same bytes."""
        from itertools import chain

        import numpy as np

        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        x, y = (np.fromiter(chain.from_iterable(t), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b)))
        end_x, end_y = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        last_x, last_y = np.isin(end_x, end_y), np.isin(end_y, end_x)  # tokens that end a group
        group_x, group_y = (np.cumsum(last) - last for last in (last_x, last_y))
        m, n = (np.bincount(g, minlength=int(last_x.sum())) for g in (group_x, group_y))
        first_x, first_y = np.cumsum(m) - m, np.cumsum(n) - n
        segment = np.repeat(np.arange(len(a)), n_a)[last_x]  # of each group
        ends = np.cumsum(np.bincount(segment, minlength=len(a)))
        # digest texts: a group's A ids, then its B ids
        words = np.empty(len(x) + len(y), object)
        closing = np.zeros(len(y), np.int64)
        closing[last_y] = np.where(np.isin(np.arange(len(m)), ends - 1), 2, 1)
        words[np.arange(len(x)) + first_y[group_x]] = [self.a_texts[e][i] for e, i in zip(last_x.tolist(), x.tolist())]
        words[np.arange(len(y)) + (first_x + m)[group_y]] = [self.b_texts[e][i] for e, i in zip(closing.tolist(), y.tolist())]
        words, cut = words.tolist(), np.cumsum(n_a + n_b).tolist()
        self.texts += ["".join(words[p:q]) for p, q in zip([0, *cut], cut)]
        links = np.bincount(segment, weights=m * n, minlength=len(a)).astype(np.int64)
        self.sums.append(np.stack([n_a, n_b, np.bincount(segment, minlength=len(a)), links], axis=1))
        # distinct links; a group of very many is paired by its distinct ids
        wide = m * n > WIDE
        own = np.flatnonzero(~wide[group_x])
        times = n[group_x[own]]
        at = np.repeat(first_y[group_x[own]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        keys, often = [np.repeat(segment[group_x[own]] << 40 | x[own] << 20, times) | y[at]], [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            (u, s), (v, t) = np.unique(x[first_x[g] : first_x[g] + m[g]], return_counts=True), np.unique(y[first_y[g] : first_y[g] + n[g]], return_counts=True)
            keys.append((segment[g] << 40 | u[:, None] << 20 | v[None, :]).ravel())
            often.append((s[:, None] * t[None, :]).ravel())
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(often))
        self.links.append(np.stack([key & ((1 << 40) - 1), total], axis=1))
        self.link_sizes.append(np.bincount(key >> 40, minlength=len(a)))


def _byte_signs() -> list[str]:
    """How byte-level vocabularies show the bytes 0 to 255: printable Latin-1 signs as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The worker's aligner of two vocabulary files."""
    cache = worker_cache("token_pairs")
    if (bytes_path, pieces_path) not in cache:
        cache[bytes_path, pieces_path] = Aligner(bytes_path, pieces_path)
    return cache[bytes_path, pieces_path]


class Chunk:
    """The documents of a chunk: their links as a table of distinct segments, and the chunk's distinct pairs."""

    def __init__(self, own: Aligner, ids: list, texts: list[str]):
        import numpy as np

        parts = [own.segments(t) for t in texts]
        own.learn(list(set().union(*parts).difference(own.index)))
        sums, links, link_sizes = own.tables()
        self.ids, self.digests, rows = ids, [""] * len(ids), []
        for d, segments in enumerate(parts):
            at = list(map(own.index.__getitem__, segments))
            if segments and own.broken.isdisjoint(at):
                self.digests[d] = sha256(";".join(map(own.texts.__getitem__, at)).encode()).hexdigest()
                rows.append((d, at))
        held = [np.array(at, np.int64) | d << 32 for d, at in rows]
        code, self.times = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
        self.doc = code >> 32
        kept, self.segment = np.unique(code & 0xFFFFFFFF, return_inverse=True)
        self.stats = np.zeros((len(ids), 4), np.int64)
        np.add.at(self.stats, self.doc, sums[kept][self.segment] * self.times[:, None])
        n = link_sizes[kept]
        self.link_ends = np.cumsum(n)
        own_links = links[np.repeat(np.cumsum(link_sizes)[kept] - self.link_ends, n) + np.arange(int(n.sum()))]
        self.link_times = own_links[:, 1]
        self.pairs, self.link = np.unique(own_links[:, 0], return_inverse=True)
        if len(own.index) > REMEMBERED or own.chars > REMEMBERED_CHARS:
            own.forget()

    def documents(self):
        """Per distinct pair how many of the chunk's documents hold it linked."""
        import numpy as np

        out = np.zeros(len(self.pairs), np.int64)
        size = np.diff(self.link_ends, prepend=0)[self.segment]
        rows = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        before = np.concatenate([[0], np.cumsum(size)])[rows]  # links of the documents before
        low = 0
        while low < len(self.ids):  # some documents at a time
            high = max(low + 1, int(np.searchsorted(before, before[low] + 2_000_000, "right")) - 1)
            own, n = slice(rows[low], rows[high]), size[rows[low] : rows[high]]
            at = np.repeat(self.link_ends[self.segment[own]] - np.cumsum(n), n) + np.arange(int(n.sum()))
            held = np.unique(np.repeat(self.doc[own], n) * len(self.pairs) + self.link[at])
            out += np.bincount(held % max(len(self.pairs), 1), minlength=len(self.pairs))
            low = high
        return out


def chunk_parts(docs: DataFrame, bytes_path: str, pieces_path: str, radix: int) -> DataFrame:
    """One row per chunk (part -1) with its documents, and one per chunk and radix with a sorted run of its pairs."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, number = aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 32
        types = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.int64(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in PART.split(", ")]

        def rows(ids, texts):
            nonlocal number
            c = Chunk(own, ids, texts)
            counts = c.documents()
            side = c.pairs >> 20
            order = np.lexsort((c.pairs, side % radix))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs, counts, part = c.pairs[order], counts[order], side[order] % radix
            body = pack(c.doc, c.segment, c.times, c.link_ends, place[c.link], c.link_times)
            out = [[number, -1, ids, *c.stats.T.tolist(), c.digests, len(pairs), body]]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for low, high in zip(starts, [*starts[1:], len(part)]):
                run = pack(np.diff(pairs[low:high], prepend=0), counts[low:high])
                out.append([number, int(part[low]), None, None, None, None, None, None, int(high - low), run])
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

        ids, texts, chars = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars and chars + len(t) > CHUNK_CHARS:
                    yield rows(ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(d)
                texts.append(t)
                chars += len(t) + 1
        if ids:
            yield rows(ids, texts)

    return id_and_text(docs).mapInArrow(run, PART)


def merged(runs: list) -> list:
    """Answers to sorted runs ``(pairs, documents)``: per record the pair's total and whether it is its side's highest.

    A heap holds the next A id of every run; the runs that have the smallest give their records of it.
    """
    import numpy as np

    out = [(np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)) for p, _ in runs]
    cuts = []
    for pairs, _ in runs:
        side = pairs >> 20
        starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        cuts.append((side[starts].tolist(), [*starts.tolist(), len(pairs)]))
    heap = [(sides[0], r, 0) for r, (sides, _) in enumerate(cuts)]
    heapq.heapify(heap)
    while heap:
        side, own = heap[0][0], []
        while heap and heap[0][0] == side:
            _, r, k = heap[0]
            sides, ends = cuts[r]
            own.append((r, ends[k], ends[k + 1]))
            if k + 1 < len(sides):
                heapq.heapreplace(heap, (sides[k + 1], r, k + 1))
            else:
                heapq.heappop(heap)
        _, at = np.unique(np.concatenate([runs[r][0][x:y] for r, x, y in own]), return_inverse=True)
        total = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(total, at, np.concatenate([runs[r][1][x:y] for r, x, y in own]))
        best, low = total == total.max(), 0
        for r, x, y in own:
            k = at[low : low + y - x]
            out[r][0][x:y], out[r][1][x:y] = total[k], best[k]
            low += y - x
    return out


def answers(parts: DataFrame) -> DataFrame:
    """(chunk, part, body): the runs' records with their totals and marks, in the order of the runs."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(part, chunks, bodies):
            runs = []
            for body in bodies:
                steps, counts = unpack(body)
                runs.append((np.cumsum(steps), counts))
            out = merged(runs)
            for low in range(0, len(chunks), 256):
                own = slice(low, low + 256)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunks[own], pa.int64()), pa.array([part] * len(chunks[own]), pa.int32()), pa.array([pack(*o) for o in out[own]], pa.binary())], ["chunk", "part", "body"]
                )

        now, chunks, bodies = None, [], []
        for batch in batches:
            for part, chunk, body in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if part != now:
                    if chunks:
                        yield from done(now, chunks, bodies)
                    now, chunks, bodies = part, [], []
                chunks.append(chunk)
                bodies.append(body)
        if chunks:
            yield from done(now, chunks, bodies)

    runs = parts.where("part >= 0").select("part", "chunk", "body")
    dealt = runs.repartition(partitions(parts.sparkSession), "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, part int, body binary")


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space itself; neither takes strings in a
    text for special tokens. n_best are the links whose count is the highest of their A id, ties included;
    count_sum adds the counts of all links. The digest is of ``a1,a2|b1;a3|b2,b3``, ids in order.

    A null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros and an empty
    digest. Repeated rows and rows under one id are documents of their own; a null id stays null. Other columns
    are not read. No rows give no rows. A task holds one chunk, or the runs of one radix.
    """
    rows = id_and_text(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = written(chunk_parts(docs, bytes_path, pieces_path, max(32, -(-chars // RADIX_CHARS))))
    back = answers(parts)
    empty = [F.lit(None).cast(c.dataType).alias(c.name) for c in parts.schema if c.name not in ("chunk", "part", "n", "body")]
    both = parts.where("part < 0").unionByName(back.select("chunk", "part", *empty, F.lit(0).cast("long").alias("n"), "body"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(row, total, best):
            """Per document the counts of its links and how many are the best, from per-segment sums."""
            doc, segment, times, ends, link, link_times = unpack(row["body"])
            counts, marks = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (total, best))
            sums = []
            for value in (marks, counts):
                own = np.concatenate([[0], np.cumsum(value[link] * link_times)]) if len(link) else np.zeros(1, np.int64)
                per_segment = np.diff(own[ends], prepend=0) if len(ends) else np.empty(0, np.int64)
                held = np.zeros(len(row["ids"]), np.int64)
                np.add.at(held, doc, per_segment[segment] * times)
                sums.append(held)
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            lists = [row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"]]
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in lists], *map(pa.array, sums), pa.array(row["groups_sha256"], pa.string())], names)

        now, total, best = None, [], []
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(1)[r].as_py() < 0:
                    if now is not None:
                        yield done(now, total, best)
                    now, total, best = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}, [], []
                else:  # parts come in order, as the chunk's pairs are ordered
                    t, b = unpack(batch.column(9)[r].as_py())
                    total.append(t)
                    best.append(b)
        if now is not None:
            yield done(now, total, best)

    dealt = both.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "part")
    return dealt.mapInArrow(run, OUT)
