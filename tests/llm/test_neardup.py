"""Near duplicates against all pairs in plain Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelcast.llm import neardup
from panelcast.llm.queries import QUERIES


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(docs, k, percent=80):
    sets = [shingles(t, k) for _, t in docs]
    postings = defaultdict(list)
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in postings[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(docs[i][0]), find(docs[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            postings[x].append(i)
    return {d: (len(s), find(d)) for (d, _), s in zip(docs, sets)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet' ORDER BY 1").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_minhash"](spark, f"/root/testdata/{sf}").collect()}
    assert got == brute(docs, 4)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w17 ", "x17 ")
    docs = [(5, long), (4, near), (9, long.upper()), (1, None), (2, ""), (3, " \n\t"), (7, "one two"), (8, "One  two"), (10, "one two three"), (11, "other " * 3000), (12, "other " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"sig": F.lit("x"), "rep": F.lit(1)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(df, words=4).collect()}
    assert got == brute(docs, 4)
    kept = neardup.drop_near_copies(df, words=4)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in got.items() if d == c}
    assert neardup.near_groups(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_groups(odd).collect()) == [(0, 0, True)] * 2 + [(3, 3, True)] * 2


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_large_groups(spark, monkeypatch, pivots):
    """Buckets beyond their limit and groups of several blocks give the same components, whatever pivots leave."""
    monkeypatch.setattr(neardup, "BUCKET", 5)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "BLOCK_SETS", 7)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base)
        for j in range(i % 5):
            w[(7 * i + 11 * j) % 60] = f"x{i}.{j}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), words=3).collect()}
    assert got == brute(docs, 3)


def visits(spark, monkeypatch, docs):
    """Components, and the number of rows that each confirming step sends to its tasks."""
    sent, plain = [], neardup.confirmed_links
    monkeypatch.setattr(neardup, "confirmed_links", lambda d, member, *more: sent.append(member.agg(F.sum(F.size("tasks"))).first()[0]) or plain(d, member, *more))
    rows = neardup.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, sent


def test_near_copies_meet_pivots_only(spark, monkeypatch):
    """In a large group of near copies every text goes to one task and a pivot's to every block: no pairs of blocks."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 20)
    docs = [(i, " ".join(f"own{i}" if j == i % 400 else f"w{j}" for j in range(400))) for i in range(300)]
    got, sent = visits(spark, monkeypatch, docs)
    assert got == brute(docs, 4) and {c for _, c in got.values()} == {0}
    assert sent == [300 + neardup.PIVOTS * (15 - 1)]


def test_rest_meets_every_block(spark, monkeypatch):
    """A chain, in which a pivot knows its neighbours alone, is one component all the same."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 10)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    docs = [(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 60))) for i in range(80)]
    got, sent = visits(spark, monkeypatch, docs)
    assert got == brute(docs, 4) and {c for _, c in got.values()} == {0}
    assert len(sent) == 2
