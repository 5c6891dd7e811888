"""Candidates and neighbours against plain Python, an exact dictionary, planted secrets of formats without labels."""

import random
import re
import string

from pyspark.sql import functions as F

from panelcast.llm import secret_scan

PROBES = [
    ('aws_secret_access_key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzKEY"', "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzKEY"),
    ("DATABASE_PASSWORD=9f8e7d6c5b4a39281706f5e4", "9f8e7d6c5b4a39281706f5e4"),
    ('TOKEN = "9233A8EC00B7C1D2E3F4A5B6C7D8E9F0"', "9233A8EC00B7C1D2E3F4A5B6C7D8E9F0"),
    ("password: 4f5a6b7c8d9e0", "4f5a6b7c8d9e0"),
    ('api_key="c2VjcmV0LXZhbHVlLWluLWJhc2U2NA=="', "c2VjcmV0LXZhbHVlLWluLWJhc2U2NA=="),
]


def test_probe_texts_are_candidates_with_their_key_word(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROBES)], "doc_id long, text string")
    found = {(r.doc_id, r.value): r for r in secret_scan.format_labels(secret_scan.candidates(df)).collect()}
    for i, (text, value) in enumerate(PROBES):
        r = found[i, value]
        assert text[r.start :].startswith(value)
        assert re.search(secret_scan.KEY_WORDS, r.before), text
        assert r.label != 0
    assert [found[i, PROBES[i][1]].label for i in (1, 2, 3)] == [1, 1, 1]


def test_neighbours_are_the_text_beside_the_value(spark):
    rng = random.Random(5)
    words = ["a", "of", "=", "é", "😀", "x1y2z3a4b5c6", "longer_than_sixteen_signs", "padded0123456789ab==", "key=", '"', "\n"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [" ".join(rng.choice(words[5:8]) for _ in range(60)), "", None, "é" * 70 + " x1y2z3a4b5c6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start): (r.value, r.before, r.after) for r in secret_scan.candidates(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        for m in re.finditer(secret_scan.VALUE, t or ""):
            want[i, m.start()] = (m[0], t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 24])
    assert got == want and len(want) > 200


def secrets(n, seed):
    """Texts of which a third give a key a value: hexadecimal, a published format, or one that no label knows."""
    rng = random.Random(seed)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    out = []
    for i in range(n):
        plain = " ".join(rng.choice(["reading", "configuration", "international", "the", "of", "docs.example.com/reference/index", "under_scored_name_of_it", "2024-01-02/03-04-2024", "v1.2.3-alpha.build"]) for _ in range(30))
        kind, value = i % 12, None
        if kind in (0, 1):
            value = pick("0123456789abcdef", 32)
        elif kind == 2:
            value = "ghp_" + pick(string.ascii_letters + string.digits, 36)
        elif kind == 3:
            value = pick(string.ascii_letters + string.digits + "/+", 40)
        out.append((i, plain + (f' token = "{value}" ' if value else " ") + plain, value, kind == 3))
    return out


def test_planted_secrets_of_a_format_without_labels(spark):
    """Base64 values are never labelled; the forest finds them by shape and neighbours."""
    rows = secrets(600, 3)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = secret_scan.scan(df).collect()
    told = {(r.doc_id, r.value) for r in found if r.is_secret}
    new = {(i, v) for i, _, v, unknown in rows if unknown}
    known = {(i, v) for i, _, v, unknown in rows if v and not unknown}
    assert known <= told
    print("recall of unlabelled formats", len(new & told) / len(new), "false", len(told - new - known), "of", len(found))
    assert len(new & told) >= 0.9 * len(new)
    assert len(told - new - known) <= 0.01 * len(found)


def test_unrelated_text_changes_no_score(spark):
    rows = [r[:2] for r in secrets(240, 4)]
    other = [(1000 + i, " ".join("ñandú çéleri".split()[k % 2] + chr(0x561 + (i * k) % 30) * 5 for k in range(40))) for i in range(240)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    both = spark.createDataFrame(rows + other, "doc_id long, text string")
    scores = lambda df: sorted((r.doc_id, r.start, round(r.score, 12), r.pairs, r.dictionary) for r in secret_scan.scan(df).collect())
    a, b = scores(few), scores(both)
    assert a == b and len(a) > 240


def test_neighbours_need_no_labels(spark):
    df = spark.createDataFrame([(1, "nothing here but words"), (2, None)], "doc_id long, text string").withColumn("source", F.lit("x"))
    assert secret_scan.scan(df).count() == 0
