"""Clusters by heap-ordered bounds against Lloyd's rounds in numpy."""

import hashlib

import numpy as np
import pytest

from panelcast.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(x, np.float64)).astype(np.int64)) for i, x, *_ in rows if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    if not kept:
        return []
    ids, m = [i for i, _ in kept], np.array([v for _, v in kept])
    first = sorted(range(len(ids)), key=lambda r: (hashlib.sha256(f"3:{'' if ids[r] is None else ids[r]}".encode()).hexdigest(), m[r].tolist()))[:k]
    c = m[first]

    def near():
        return np.argmin([((m - x) ** 2).sum(axis=1) for x in c], axis=0)

    for _ in range(rounds):
        own = near()
        c = np.array([m[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    own = near()
    d = ((m - c[own]) ** 2).sum(axis=1)
    return sorted([(i, int(o), int(x), int(d[own == o].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, x in zip(ids, own, d)], key=str)


def got(spark, rows):
    return sorted([tuple(r) for r in centroids.clusters(spark.createDataFrame(rows, SCHEMA)).collect()], key=str)


def test_groups_copies_and_broken_rows(spark):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] + 0.3 * rnd.normal(size=64)).tolist(), "own", None) for i in range(400)]
    rows += [(1000 + i, middle[0].tolist(), None, "own") for i in range(200)]  # a third are copies
    rows += [(None, middle[1].tolist(), None, None), (7, rows[7][1], None, None), (2000, None, None, None), (2001, [1.0] * 63, None, None)]
    rows += [(2002, [None, *[1.0] * 63], None, None), (2003, [float("nan"), *[1.0] * 63], None, None), (2004, [float("-inf"), *[1.0] * 63], None, None), (2005, [], None, None)]
    assert got(spark, rows) == brute(rows)


def test_few_vectors_and_none(spark):
    few = [(i, [float(i % 2)] * 64, None, None) for i in range(5)]  # equal first centroids: ties go to the smaller number
    assert got(spark, few) == brute(few)
    assert got(spark, [(1, None, None, None)]) == []
    with pytest.raises(Exception, match="scaled component"):
        got(spark, [(1, [1e9] * 64, None, None)])


def test_only_expired_rows_are_scanned_again(spark, monkeypatch):
    """Far apart groups settle at once: later runs of the heap hold few rows, and none that is still certain."""
    pushed = []
    real = centroids.push
    monkeypatch.setattr(centroids, "push", lambda rows: pushed.append(real(rows)) or pushed[-1])
    rnd = np.random.default_rng(2)
    rows = [(i, (10.0 * (i % 8) + 0.5 * rnd.normal(size=64)).tolist(), None, None) for i in range(800)]
    assert got(spark, rows) == brute(rows)
    sizes = [spark.read.parquet(p).count() for p in pushed]
    assert sizes[0] == 800 and sum(sizes[1:]) < 10 * 800


def test_range_reads_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    run = spark.createDataFrame([(1, [1], -1, 0, 0.5)], centroids.SCHEMA)
    path = centroids.push(run)
    plan = centroids.head(spark.read.schema(centroids.SCHEMA).parquet(path), [0.0], [1.0])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(key,0.0)" in plan and "LessThanOrEqual(key,1.0)" in plan
