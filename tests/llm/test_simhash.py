"""SimHash fingerprints and their exact groups against plain Python."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelcast.llm import simhash
from panelcast.llm.queries import QUERIES


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").translate({c: " " for c in range(10, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(d, p) for (d, _), p in zip(rows, prints) if d is not None]
    for i, (a, p) in enumerate(known):
        for b, q in known[:i]:
            if (p ^ q).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted([(d, f"{p:016x}", None if d is None else find(d)) for (d, _), p in zip(rows, prints)], key=str)


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert sorted([tuple(r) for r in QUERIES["op13_simhash"](spark, sf).collect()], key=str) == brute(rows)


def test_edges(spark):
    long = " ".join(random.Random(3).choice(["Alpha", "beta,", "ÀB", "x" * 200]) for _ in range(120_000))
    near = [f"{' '.join(f'w{k}' for k in range(300))} tail {i % 11}" for i in range(60)]  # near copies of one text
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two three"), (7, long), (8, long + " end"), (9, None), (None, "one"), (None, None), (4, "another text under one id here"), (5, "one")]
    rows += [(100 + i, t) for i, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("fp", "rep", "strip", "_fp", "component_id", "fingerprint")})
    assert sorted([tuple(r) for r in simhash.near_groups(docs).collect()], key=str) == brute(rows)
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_tiles_lose_no_pair(same):
    """Planted neighbours among random fingerprints: the forest joins what all pairs join."""
    rnd = np.random.default_rng(4)
    seeds = rnd.integers(0, 1 << 63, 700, np.uint64) * np.uint64(2) + rnd.integers(0, 2, 700, np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rnd.choice(64, k, False).astype(np.uint64)) for k in rnd.integers(1, 7, 700)])
    x = np.unique(np.concatenate([seeds, seeds ^ flips, np.arange(300, dtype=np.uint64)]))
    y = x if same else np.unique(seeds[:500] ^ flips[200:])
    every = np.concatenate([x, y]) if not same else x
    a, b = simhash.close_in_strips(x, y, 4, same)
    own = np.arange(len(every))
    own[a] = b  # a star: every linked position names its group's smallest
    want = np.arange(len(every))
    cross = np.bitwise_count(x[:, None] ^ y[None, :]) <= 4
    links = [(i, j if same else j + len(x)) for i, j in zip(*np.nonzero(cross))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(want[i], want[j])
            if want[i] != low or want[j] != low:
                want[i] = want[j] = low
                changed = True
    assert (own == want).all() and len(a)


def test_strips_meet_each_other(spark, monkeypatch):
    """The same groups whether one strip holds all or many do."""
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "STRIP", 40)
    rnd = random.Random(8)
    base = [rnd.getrandbits(63) for _ in range(150)]
    prints = sorted({b ^ (1 << rnd.randrange(63) if k else 0) ^ (1 << rnd.randrange(63) if k else 0) for b in base for k in range(3)})
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    got = {frozenset(r) for r in simhash.links(reps, 4).collect()}
    root = list(range(len(prints)))

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = sorted((find(root, i), find(root, j)))
                root[y] = x
    mine = list(range(len(prints)))
    for link in got:
        x, y = sorted(find(mine, n) for n in link)
        mine[y] = x
    assert [find(mine, i) for i in mine] == [find(root, i) for i in root] and len({find(mine, i) for i in mine}) < len(prints)
