"""Token alignment against plain Python: random texts, whole small tables, edge cases, very large groups."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import token_pairs
from panelcast.llm.queries import QUERIES, tokenizer

PATHS = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """What the contract says, for (doc_id, text) rows: both libraries on whole texts, every link in a list."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in plain)}
    a_bytes = {i: bytes(signs[c] for c in k) for k, i in a.get_vocab().items() if k != "<|endoftext|>"}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx, by = [a_bytes[i] for i in x], [b_bytes(i) for i in y]
        if not b"".join(bx) == b"".join(by) == (" " + text).encode():
            return []
        out = defaultdict(lambda: ([], []))
        both = sorted({*ends(bx)} & {*ends(by)})
        for side, ids, at in ((0, x, ends(bx)), (1, y, ends(by))):
            for i, e in zip(ids, at):
                out[next(z for z in both if z >= e) if len(both) < 50 else both[np.searchsorted(both, e)]][side].append(i)
        return [out[e] for e in both]

    def run(rows):
        docs = [(d, groups(t)) for d, t in rows]
        count, top = defaultdict(int), defaultdict(int)
        for _, g in docs:
            for pair in {(i, j) for x, y in g for i in x for j in y}:
                count[pair] += 1
        for (i, _), c in count.items():
            top[i] = max(top[i], c)
        out = []
        for d, g in docs:
            links = [(i, j) for x, y in g for i in x for j in y]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
            out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
        return sorted(out, key=str)

    return run


def test_random_texts_nulls_and_repeats(spark, brute):
    rnd = random.Random(5)
    signs = list(" \n\t  abcXYZ.,'s 　éß中字한😀\u0085\x00\x1cİक़ \r​́")
    words = ["</s>", "<|endoftext|>", "the", ".", "it's", "y,", ")", "ẞ.", "é,", "-x", "\r\n", "\n", "ok\n", "<0x41>", "  ", "中文", "a" * 300, "▁x", "  \n\n  x"]
    rows = [(i, "".join(rnd.choice(signs if rnd.random() < 0.8 else words) for _ in range(rnd.randint(0, 60)))) for i in range(1500)]
    rows += [(None, None), (None, "x y"), (5, "x y"), (5, "x y"), (7, None), (8, ""), (9, " "), (10, "a "), (11, "  "), (12, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("own") for c in ("chunk", "part", "n_a", "body", "ids")})
    assert sorted([tuple(r) for r in token_pairs.aligned(docs, *PATHS).collect()], key=str) == brute(rows)
    assert token_pairs.aligned(docs.limit(0), *PATHS).count() == 0


def test_whole_table(spark, brute):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert sorted([tuple(r) for r in QUERIES["op11_token_pairs"](spark, sf).collect()], key=str) == brute(rows)


def test_many_chunks_share_a_hot_pair(spark, brute, monkeypatch):
    rows = [(i, "the same. " * (i % 3 + 1) + f"w{i % 7}") for i in range(300)]
    monkeypatch.setattr(token_pairs, "CHUNK_CHARS", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    parts = token_pairs.chunk_parts(docs, *PATHS, 4)
    assert parts.where("part < 0").count() > 10
    assert sorted([tuple(r) for r in token_pairs.aligned(docs, *PATHS).collect()], key=str) == brute(rows)


def test_a_group_without_common_ends_is_paired_by_distinct_ids(monkeypatch):
    own = token_pairs.Aligner(*PATHS)
    a, b = own.a_bytes.index(b"ab"), own.b_bytes.index(b"a")
    c = own.b_bytes.index(b"b")
    x, y = [own.a_bytes.index(b"a")] + [own.a_bytes.index(b"ba")] * 200 + [own.a_bytes.index(b"b")], [own.b_bytes.index(b"ab")] * 201
    own._keep([[a], x], [[b, c], y])
    sums, links, sizes = own.tables()
    assert sums.tolist() == [[1, 2, 1, 2], [202, 201, 1, 202 * 201]]
    assert sizes.tolist() == [2, 3]
    assert {(k >> 20, k & 0xFFFFF): t for k, t in links[2:].tolist()} == {(i, y[0]): 201 * x.count(i) for i in set(x)}


def test_merged_runs_count_and_mark():
    runs = [(np.array([1 << 20 | 5, 1 << 20 | 6, 9 << 20 | 1]), np.array([2, 3, 1])), (np.array([1 << 20 | 5, 4 << 20 | 2]), np.array([1, 7]))]
    assert [[x.tolist() for x in o] for o in token_pairs.merged(runs)] == [[[3, 3, 1], [1, 1, 1]], [[3, 7], [1, 1]]]
