"""Whole queries on the small tables against brute force in plain Python."""

import hashlib
import struct
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest

from panelcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def ids_of(docs, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: t.encode(x, add_special_tokens=False).ids + [end] for d, x in docs}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_token_files(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, SF).collect()}
    at = 0
    for d, ids in sorted(ids_of(docs, 2).items()):
        r = got.pop(d)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(packed(ids)))
        at += len(ids)
    assert not got


def test_byte_bpe(spark, docs):
    import public_tokenizers as p
    import tiktoken

    from panelcast.llm.byte_bpe import load_ranks

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=load_ranks(p.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, SF).collect()}
    for d, x in docs:
        ids = enc.encode_ordinary(x)
        r = got.pop(d)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()
    assert not got


def test_packing(spark, docs):
    want, places, total = ids_of(docs, 1), defaultdict(list), 0
    got = defaultdict(list)
    for r in QUERIES["op10_swap_packing"](spark, SF).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        parts = sorted(got.pop(d), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 4096)))
        for r in parts:
            own = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and r.length == min(4096, len(ids) - r.start) and r.ids_crc32 == crc32(packed(own))
        total += len(ids)
    assert not got
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-total // 4096) * 1.01 + 1


def test_chat(spark):
    turns = defaultdict(list)
    for c, t, role, text in duckdb.sql(f"SELECT conv_id, turn, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall():
        turns[c].append((role, text))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in QUERIES["op5_chat_examples"](spark, SF).collect()}
    for c, ts in turns.items():
        r = got.pop(c)
        replies = "".join(x for role, x in ts if role == "assistant")
        assert r.n_turns == len(ts)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(x) for _, x in ts)
    assert not got
