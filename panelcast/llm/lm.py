"""Language-model scores by deleted interpolation of word bigrams with the unigram base.

Counts cover all training documents. Documents are held in chunks; each chunk asks for the totals of its distinct
unigrams and bigrams once, so that a word in every document costs one request per chunk, and gets them back in the
order it asked.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import partitions, slices, written
from panelcast.llm.words import hash_words

CHUNK = 1_500_000  # tokens of a chunk, about 200 MB in a task; one longer document is a chunk of its own
BUCKETS = 40  # context-frequency buckets: the bit length of the context's count
BINS, FINE = 3200, 32  # ratio classes: 1/32 of an octave from 2**-40 to 2**60, class 0 for a ratio of 0
TOTAL = 8  # bytes of a total over all chunks; those of a chunk fit in 4
KEY = "chunk long, kind int, q int, keys binary, counts binary"
CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, vocab binary, tokens binary"


def _planes(x, width: int = 4) -> bytes:
    """Unsigned integers of ``width`` bytes by byte planes, which compress."""
    import numpy as np

    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _packed(*parts: bytes) -> bytes:
    import pyarrow as pa

    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(blob: bytes) -> bytes:
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def pack_ints(x, width: int = 4) -> bytes:
    return _packed(_planes(x, width))


def unpack_ints(blob: bytes, width: int = 4):
    import numpy as np

    raw = np.frombuffer(_unpacked(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_floats(x) -> bytes:
    """Ratios in single precision, by byte planes: a token's log10 probability is off by 3e-8 at most."""
    import numpy as np

    return _packed(_planes(x.astype("<f4").view("<u4")))


def unpack_floats(blob: bytes):
    import numpy as np

    return unpack_ints(blob).astype("<u4").view("<f4").astype(np.float64)


def pack_keys(keys) -> bytes:
    """Ascending unsigned 64-bit integers: differences of the upper halves, then the lower halves."""
    import numpy as np

    high = (keys >> np.uint64(32)).astype(np.int64)
    return _packed(_planes(np.diff(high, prepend=0)), (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())


def unpack_keys(blob: bytes):
    import numpy as np

    raw = np.frombuffer(_unpacked(blob), np.uint8)
    n = len(raw) // 8
    high = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.uint64))
    return high << np.uint64(32) | raw[4 * n :].view("<u4").astype(np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held) as rows of many documents: ids, sizes, the sorted hashes of their distinct
    tokens, and all tokens as places in that list. A document's tokens are its words and one end."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from panelcast.llm.words import _mix

        end = _mix(np.array([0xE0D], np.uint64))
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, words, total = [], [], [], [], 0

        def close():
            nonlocal number, ids, held, sizes, words, total
            vocab, place = np.unique(np.concatenate(words), return_inverse=True)
            row = {"chunk": [number], "ids": [ids], "held": [held], "sizes": [sizes], "vocab": [pack_keys(vocab)], "tokens": [pack_ints(place)]}
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            number, ids, held, sizes, words, total = number + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                found, cut = hash_words(part.column(1))
                n = np.diff(cut)
                ids += part.column(0).to_pylist()
                held += part.column(2).to_pylist()
                sizes += (n + 1).tolist()
                words.append(np.insert(found, cut[1:], end))
                total += len(words[-1])
                if total >= CHUNK:
                    yield close()
        if ids:
            yield close()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's tokens with the order in which it asks for unigrams (kind 0) and bigrams (kind 1)."""

    def __init__(self, held, sizes, vocab: bytes, tokens: bytes, slices_: int):
        import numpy as np

        from panelcast.llm.words import _mix

        self.held, self.sizes = np.asarray(held, bool), np.asarray(sizes, np.int64)
        known, self.tokens = unpack_keys(vocab), unpack_ints(tokens)
        self.begin = len(known)  # place of the begin mark, which is asked for as a unigram of its own
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.before = np.roll(self.tokens, 1)
        self.before[self.starts] = self.begin
        self.training = np.repeat(~self.held, self.sizes)
        hashes = np.append(known, _mix(np.array([0xB0E], np.uint64)))
        order0 = np.argsort(hashes, kind="stable")
        pairs, of = np.unique(self.before * (self.begin + 1) + self.tokens, return_inverse=True)
        both = _mix(hashes[pairs // (self.begin + 1)] * np.uint64(0x9E3779B97F4A7C15) + _mix(hashes[pairs % (self.begin + 1)]))
        order1 = np.argsort(both, kind="stable")
        self.keys = [hashes[order0], both[order1]]
        self.order = [order0, order1]
        self.pair = of
        # monotone in the key, so every slice is a run of the sorted keys
        self.cuts = [np.searchsorted(((k >> np.uint64(32)) * np.uint64(slices_)) >> np.uint64(32), np.arange(slices_ + 1)) for k in self.keys]

    def own_counts(self):
        """Training counts by key order of either kind; the begin mark counts training documents."""
        import numpy as np

        one = np.bincount(self.tokens[self.training], minlength=self.begin + 1)
        one[self.begin] = int((~self.held).sum())
        two = np.bincount(self.pair[self.training], minlength=len(self.order[1]))
        return [one[self.order[0]], two[self.order[1]]]

    def by_token(self, totals):
        """Per token the totals of itself, of its context, and of both together, given totals in key order."""
        import numpy as np

        plain = [np.empty(len(o), np.int64) for o in self.order]
        for p, o, t in zip(plain, self.order, totals):
            p[o] = t
        return plain[0][self.tokens], plain[0][self.before], plain[1][self.pair]


def requests(held: DataFrame, slices_: int) -> DataFrame:
    """Rows (chunk, kind, q, keys, counts): a chunk's distinct keys in slice q with its own training counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, types = ["chunk", "kind", "q", "keys", "counts"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            for r in range(b.num_rows):
                number, _, held_, sizes, vocab, tokens = (b.column(i)[r].as_py() for i in range(6))
                own = Chunk(held_, sizes, vocab, tokens, slices_)
                for kind, counts in enumerate(own.own_counts()):
                    out = []
                    for q, (lo, hi) in enumerate(zip(own.cuts[kind][:-1].tolist(), own.cuts[kind][1:].tolist())):
                        if hi > lo:
                            out.append((number, kind, q, pack_keys(own.keys[kind][lo:hi]), pack_ints(counts[lo:hi])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return held.mapInArrow(run, KEY)


def totals(asked: DataFrame) -> DataFrame:
    """Rows (chunk, kind, q, counts): for each request the totals over all chunks, in the order of its keys.

    A slice also reports, as chunk -1, how many of its unigrams occur in training.
    """

    def add(pdf):
        import numpy as np
        import pandas as pd

        keys = [unpack_keys(k) for k in pdf["keys"]]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([unpack_ints(c) for c in pdf["counts"]]), len(every)).astype(np.int64)
        answer, at = [], 0
        for k in keys:
            answer.append(pack_ints(total[of[at : at + len(k)]], TOTAL))
            at += len(k)
        kind, q = int(pdf["kind"].iloc[0]), int(pdf["q"].iloc[0])
        out = pd.DataFrame({"chunk": pdf["chunk"], "kind": kind, "q": q, "counts": answer})
        seen = pd.DataFrame({"chunk": [-1], "kind": [kind], "q": [q], "counts": [pack_ints(np.array([int((total > 0).sum())]), TOTAL)]})
        return pd.concat([out, seen], ignore_index=True)

    return asked.groupBy("kind", "q").applyInPandas(add, "chunk long, kind int, q int, counts binary")


def _bucket(context):
    import numpy as np

    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _class(ratio):
    """Class of a ratio, for learning the weights only; its lower end stands for it."""
    import numpy as np

    with np.errstate(divide="ignore"):
        at = np.floor((np.log2(ratio) + 40) * FINE) + 1
    return np.clip(np.where(ratio > 0, at, 0), 0, BINS - 1).astype(np.int64)


def class_ratio():
    import numpy as np

    out = 2.0 ** ((np.arange(BINS) - 1) / FINE - 40)
    out[0] = 0.0
    return out


def evidence(held: DataFrame, answers: DataFrame, slices_: int, n_tokens: int, distinct: int) -> DataFrame:
    """Per chunk: ids and base sums of its documents, every token's bucket and ratio, and (bucket, ratio
    class) counted over training tokens with the token itself taken out of all counts (chunk's ``seen``)."""
    data = held.withColumns({"kind": F.lit(-1), "q": F.lit(-1), "counts": F.lit(None).cast("binary")})
    blank = {c: F.lit(None).cast(t) for c, t in (("ids", "array<long>"), ("held", "array<boolean>"), ("sizes", "array<int>"), ("vocab", "binary"), ("tokens", "binary"))}
    rows = data.unionByName(answers.where("chunk >= 0").withColumns(blank))
    width = max(partitions(held.sparkSession), held.count())
    rows = rows.repartition(width, "chunk").sortWithinPartitions("chunk", "kind", "q")
    schema = "ids array<long>, held array<boolean>, sizes array<int>, known array<int>, base array<double>, buckets binary, ratios binary, seen binary"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        now, got = None, ([], [])

        def done():
            own = Chunk(now["held"], now["sizes"], now["vocab"], now["tokens"], slices_)
            word, context, both = own.by_token([np.concatenate(g) for g in got])
            space = n_tokens + 0.1 * (distinct + 1)
            base = (word + 0.1) / space
            ratio = both / np.maximum(context, 1) / base
            t = own.training
            left = np.maximum(context[t] - 1, 0)
            out = (both[t] - 1) / np.maximum(left, 1) / ((word[t] - 1 + 0.1) / (space - 1))
            seen = np.bincount(_bucket(left) * BINS + _class(np.where(left > 0, out, 0.0)), minlength=BUCKETS * BINS)
            sums = np.add.reduceat(np.log10(base), own.starts)
            known = np.add.reduceat((word > 0).astype(np.int64), own.starts)
            row = [[now["ids"]], [now["held"]], [now["sizes"]], [known.tolist()], [sums.tolist()], [pack_ints(_bucket(context), 1)], [pack_floats(ratio)], [pack_ints(seen)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, types)], names)

        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r].as_py() for i, c in enumerate(b.schema.names)}
                if row["kind"] < 0:
                    if now is not None:
                        yield done()
                    now, got = row, ([], [])
                else:
                    got[row["kind"]].append(unpack_ints(row["counts"], TOTAL))
        if now is not None:
            yield done()

    return rows.select("chunk", "kind", "q", "counts", "ids", "held", "sizes", "vocab", "tokens").mapInArrow(run, schema)


def learn_weights(counted, rounds: int = 500):
    """Weight of the bigram estimate per bucket by expectation-maximisation on counts [bucket, ratio class].

    A token's likelihood is, up to the base, 1 - w + w * ratio; the expected share of tokens that the bigram
    explains is the next w. A bucket without held-out tokens takes the weight of the next lower one.
    """
    import numpy as np

    ratio, out = class_ratio(), np.zeros(BUCKETS)
    for b in range(1, BUCKETS):
        n = counted[b]
        if not n.sum():
            out[b] = out[b - 1]
            continue
        w = 0.5
        for _ in range(rounds):
            new = float((n * (w * ratio / (1 - w + w * ratio))).sum() / n.sum())
            new = min(max(new, 1e-6), 1 - 1e-3)
            if abs(new - w) < 1e-9:
                break
            w = new
        out[b] = w
    return out  # bucket 0, a context never seen in training, has the base alone


def score(docs: DataFrame, held: str = "held") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``held`` is a boolean column: rows without it are the training texts. Tokens are words between ASCII white
    space, A-Z in lower case, and one end per text. The base is the unigram estimate with 0.1 added; the model
    mixes it with the bigram's maximum-likelihood estimate, weighted by how often the context occurs. Weights
    come from the training tokens, each held out of the counts in turn, counted by ratio classes; a score is the
    sum of each token's own log10 probability.

    A null text counts as empty: one end. A null mark counts as training. Repeated rows count and are scored
    each; other columns are not read. With no training rows every count is 0. No rows give no rows.
    """
    import numpy as np

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(held), F.lit(False)).alias("held"))
    spark = docs.sparkSession
    table = written(chunks(own))
    slices_ = 4 * partitions(spark)
    answers = written(totals(requests(table, slices_)))
    seen = answers.where("chunk = -1 AND kind = 0").select("counts").collect()  # one number per slice
    per_row = F.aggregate(F.filter(F.arrays_zip("sizes", "held"), lambda d: ~d["held"]), F.lit(0).cast("long"), lambda a, d: a + d["sizes"])
    kept = F.size(F.filter("held", lambda h: ~h))
    n_tokens, trained = (int(v or 0) for v in table.agg(F.sum(per_row), F.sum(kept)).first())
    distinct = sum(int(unpack_ints(r.counts, TOTAL)[0]) for r in seen) - (trained > 0)  # without the begin mark
    found = written(evidence(table, answers, slices_, n_tokens, distinct))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(BUCKETS * BINS, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += unpack_ints(blob)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    held_out = np.zeros(BUCKETS * BINS, np.int64)
    for r in found.select("seen").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        held_out[r.code] = r.n  # at most BUCKETS * BINS rows
    weight = learn_weights(held_out.reshape(BUCKETS, BINS))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                ids, held_, sizes, known, base, buckets, ratios = (b.column(i)[r].as_py() for i in range(7))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                w = weight[unpack_ints(buckets, 1)]
                more = np.add.reduceat(np.log10(1 - w + w * unpack_floats(ratios)), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held_, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array([n_tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(np.array(base) + more)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.select("ids", "held", "sizes", "known", "base", "buckets", "ratios").mapInArrow(run, out)
