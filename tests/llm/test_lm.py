"""Every column of the language-model query against plain Python on a whole table."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from panelcast.llm import lm
from panelcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BEGIN, END = object(), object()


def test_all_columns_by_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    tokens = {d: [*t.encode().lower().split(), END] for d, t in docs}
    held = {d: crc32(str(d).encode()) % 10 == 0 for d in tokens}
    one, two = Counter(), Counter()
    for d, own in tokens.items():
        if not held[d]:
            one.update(own)
            one[BEGIN] += 1
            two.update(zip([BEGIN, *own], own))
    n = sum(one.values()) - one[BEGIN]
    space = n + 0.1 * len(one)  # V + 1: the begin mark stands in the counter for the one more

    def bucket(context):
        return min(math.frexp(context)[1], lm.BUCKETS - 1)

    seen = np.zeros((lm.BUCKETS, lm.BINS), np.int64)
    for d, own in tokens.items():
        if not held[d]:
            for a, b in zip([BEGIN, *own], own):
                left = one[a] - 1
                ratio = (two[a, b] - 1) / max(left, 1) / ((one[b] - 1 + 0.1) / (space - 1)) if left > 0 else 0.0
                seen[bucket(left), lm._class(np.array([ratio]))[0]] += 1
    weight = lm.learn_weights(seen)
    got = {r.doc_id: r for r in QUERIES["op7_interpolated_lm"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, own in tokens.items():
        base, score = 0.0, 0.0
        for a, b in zip([BEGIN, *own], own):
            p = (one[b] + 0.1) / space
            w = weight[bucket(one[a])] if one[a] else 0.0
            base += math.log10(p)
            score += math.log10((1 - w) * p + w * two[a, b] / max(one[a], 1))
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(one[b] > 0 for b in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-11) and r.score == pytest.approx(score, rel=1e-7)


def test_floats_survive_packing():
    x = np.concatenate([[0.0], np.exp(np.random.default_rng(3).normal(0, 9, 4000))])
    assert np.allclose(lm.unpack_floats(lm.pack_floats(x)), x, rtol=6e-8, atol=0) and len(lm.unpack_floats(lm.pack_floats(x[:0]))) == 0
