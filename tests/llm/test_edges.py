"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every text operator."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import byte_bpe, chat, common, exact, imatch, lm, packing, secret_scan, token_files, toxicity
from panelcast.llm.queries import piece_pattern, tokenizer

WORDS = tokenizer("word_bpe_49k.json")
RANKS = tokenizer("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(random.Random(4).choice(["alpha", "beta,", "Gamma.", "x" * 300, "\n", "é"]) for _ in range(30_000))
ROWS = [(1, "One two"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG), (1, "One two"), (None, "no id"), (None, None), (7, "onetwo")]
#: Columns that the operators use inside, put on the input by others.
CLASH = ["_text", "_key", "_b", "_w", "_len", "_norm", "length", "kind", "score", "next", "_row", "band", "a", "path", "label", "toxic"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in CLASH}).withColumns({"source": F.lit("config.yml"), "lang": F.lit(None).cast("string"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(v):
    return (v is None, v)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_groups(docs, empty):
    for all_ in (True, False):
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs, digests=all_).collect()]
        groups = defaultdict(list)
        for d, t in ROWS:
            groups[norm(t)].append((d, t))
        want = []
        for d, t in ROWS:
            g = groups[norm(t)]
            top = max(len(x or "") for _, x in g)
            keep = min((x for x, y in g if len(y or "") == top), key=key)
            want.append((d, keep, len(g), d == keep))
        assert sorted(got, key=lambda r: (key(r[0]), str(r))) == sorted(want, key=lambda r: (key(r[0]), str(r)))
    assert exact.exact_groups(empty).count() == 0
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (key(r[0]), r[1])) == [(1, "One two"), (4, " \n\t"), (5, LONG), (7, "onetwo"), (None, "no id")]
    assert exact.drop_copies(empty).count() == 0


def test_exact_drops_by_own_text(spark):
    """Rows under one id are told apart by their texts."""
    rows = [(1, "a b c"), (1, "other"), (2, "a  b  c"), (3, "other")]
    kept = exact.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "other"), (2, "a  b  c")]


def test_token_files(spark, docs, empty, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, WORDS, 2)
    index = token_files.token_index(spark, path).collect()
    assert len(index) == len(ROWS)
    by_place = sorted(index, key=lambda r: r.start)
    assert [r.start for r in by_place] == [sum(x.n_tokens for x in by_place[:i]) for i in range(len(ROWS))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_place]
    assert ids == sorted(ids)
    assert {r.n_tokens for r in index if r.doc_id in (2, 3, 4)} == {1}
    plan = token_files.read_tokens(spark, path).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in plan
    token_files.write_tokens(empty, path + "0", WORDS, 2)
    assert token_files.token_index(spark, path + "0").count() == 0


def test_byte_bpe(docs, empty):
    encoded = byte_bpe.encode(docs, RANKS, piece_pattern())
    got = sorted((str(r.doc_id), r.decoded_sha256) for r in byte_bpe.decode(encoded, RANKS, piece_pattern()).collect())
    assert got == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    assert byte_bpe.encode(empty, RANKS, piece_pattern()).count() == 0


def test_byte_bpe_trees_agree():
    coder = byte_bpe.ByteBPE(byte_bpe.load_ranks(RANKS), piece_pattern())
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"aehist \xc3\xa9n") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    assert coder.merge_short(pieces) == [b"".join(i.to_bytes(4, "little") for i in coder.merge_long(p)) for p in pieces]


def test_packing(docs, empty):
    packed = packing.pack(packing.pieces(docs, WORDS, 1, capacity=128, with_ids=True), capacity=128, group=50).collect()
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 128
    assert sum(r.piece == 0 for r in packed) == len(ROWS)
    assert packing.pack(packing.pieces(empty, WORDS, 1)).count() == 0
    again = packing.pack(packing.pack(packing.pieces(docs, WORDS, 1).withColumn("offset", F.lit("own"))))
    assert again.columns.count("offset") == again.columns.count("sequence_id") == 1 and again.where("offset = 0").count() >= 1


def equal_pieces(spark, n, length):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(length).cast("int").alias("length"))


def test_packing_of_equal_fills_ends(spark):
    """Pieces of which no two share a bin, and pieces of which a group fills less than one bin."""
    packed = packing.pack(equal_pieces(spark, 20_000, 3000), group=500)
    assert packed.select("doc_id").distinct().count() == packed.select("sequence_id").distinct().count() == packed.where("offset = 0").count() == 20_000
    packed = packing.pack(equal_pieces(spark, 300, 3), group=10)
    assert packed.select("doc_id").distinct().count() == packed.count() == 300 and packed.select("sequence_id").distinct().count() == 1


def test_deals_again_at_most_half_of_the_bins():
    import pandas as pd

    out = packing._place(4096, False)(pd.DataFrame({"_row": range(101), "length": 3000}))
    assert out["_again"].sum() == 50 and packing._place(4096, True)(out[["_row", "length"]])["_again"].sum() == 0


def test_local_search_empties_bins():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 120))]
        bins = packing.search(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_local_search_beats_best_fit():
    rng = random.Random(2)
    saved = 0
    for _ in range(60):
        lengths = [rng.randint(26, 40) for _ in range(90)]
        saved += best_fit(lengths, 100) - len(packing.search(lengths, 100))
        assert len(packing.search(lengths, 100)) <= best_fit(lengths, 100)
    assert saved > 0


def test_sequences(docs):
    packed = packing.pack(packing.pieces(docs, WORDS, 1, capacity=64, with_ids=True), capacity=64)
    rows = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == packed.agg(F.sum("length")).first()[0] and max(len(r.ids) for r in rows) <= 64


TURNS = [
    (1, 0, "user", "a <| b \\ </s>[INST]"), (1, 1, "assistant", None), (1, 2, "as|si\\st", "x"), (1, 3, "assistant", "<|end|>\n<|user|>\n"), (1, 4, "user", "after"),
    (2, 0, "user", "no reply"), (None, 0, "assistant", "\\"), (3, None, None, None), (3, 1, "assistant", "r"), (3, 1, "assistant", "r"), (4, 0, "assistant", LONG),
]


def test_chat(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"lead": F.lit(1), "segment": F.lit("x")})
    got = {r.conv_id: r for r in chat.formatted(turns).collect()}
    by_conv = defaultdict(list)
    for c, t, role, text in sorted(TURNS, key=lambda r: (-1 if r[1] is None else r[1])):
        by_conv[c].append((role or "", text or ""))
    for c, ts in by_conv.items():
        replies = "".join(x for role, x in ts if role == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.loss_chars) == (len(ts), len(replies))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    assert not got
    assert chat.formatted(turns.limit(0)).count() == 0


def test_whole_examples(spark):
    turns = spark.createDataFrame(TURNS[:5], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.whole_examples(chat.prefix_examples(turns)).collect(), key=lambda r: r.example)
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in rows] == ["", "<|end|>\n<|user|>\n"]
    assert [len(chat.parse(r.text)) for r in rows] == [2, 4] and rows[1].text.startswith(rows[0].text)


def test_imatch(docs, empty):
    rows = imatch.against_edits(docs.where("doc_id IS NOT NULL")).collect()
    assert len(rows) == 8
    same = defaultdict(set)
    for (_, t), r in zip(sorted((d, t or "") for d, t in ROWS if d is not None), sorted(rows, key=lambda r: (r.doc_id, r.n_chars))):
        same[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in same.values())
    assert imatch.against_edits(docs).count() == len(ROWS)
    assert imatch.against_edits(empty).count() == 0 and imatch.fingerprints(docs).count() == len(ROWS)


def test_imatch_edits(spark):
    """The edited text takes from the next document in id order, across ranges and round the end."""
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))) for i in range(0, 90, 3)}
    got = {r.doc_id: r for r in imatch.against_edits(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    ids = sorted(texts)
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        n = len(t) // 4
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert got[d].fingerprint == got[d].edited_fingerprint or got[d].near_edited < 1


@pytest.mark.parametrize("edits", [0, 2])
def test_imatch_copies(spark, edits):
    """A third of all rows are copies, or copies with 2 of 100 words changed: their words stay in the band."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(100)]
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(120)]
    for k in range(60):
        own = list(base)
        for i in rng.sample(range(100), edits):
            own[i] = f"own{k}x{i}"
        texts.append(" ".join(own))
    got = {r.doc_id: r for r in imatch.against_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    inner = [got[i] for i in range(120, 179)]
    assert all(r.near_next == 1 for r in inner) if not edits else sum(r.near_next for r in inner) / 59 > 0.8
    assert not got[179].fingerprint.startswith("-1:") and got[179].near_edited > 0.3  # followed by an unrelated text
    assert sum(got[i].near_next for i in range(119)) / 119 < 0.05


def test_lm(spark, docs, empty):
    rows = lm.score(docs.withColumn("held", F.expr("CASE WHEN doc_id IN (5, 7) THEN true WHEN doc_id = 3 THEN null ELSE false END"))).collect()
    assert len(rows) == len(ROWS)
    assert {(r.train_tokens) for r in rows} == {3 + 1 + 1 + 1 + (len(LONG.split()) + 1) + 3 + 3 + 1}
    assert all(r.score <= 0 and r.n_known <= r.n_tokens for r in rows)
    assert lm.score(empty.withColumn("held", F.lit(False))).count() == 0
    none = lm.score(docs.withColumn("held", F.lit(True))).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)}


def test_lm_adds_up():
    """The mixture of base and bigram is a distribution over the seen words and one unseen."""
    import numpy as np

    w = lm.learn_weights(np.eye(lm.BUCKETS, lm.BINS, dtype=np.int64))
    assert w[0] == 0 and (w < 1).all()
    ratio = lm.class_ratio()
    assert ratio[0] == 0 and abs(np.log2(ratio[lm._class(np.array([3.0]))[0]] / 3)) < 1 / lm.FINE
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and len(lm.unpack_keys(lm.pack_keys(keys[:0]))) == 0


def test_segments_against_brute_force():
    def rule(s, lo, hi, out):
        """The segment of greatest sum, then the same left and right of it."""
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return
        _, _, _, i, j = best
        out.append((i, j, best[0]))
        rule(s, lo, i, out)
        rule(s, j, hi, out)

    rng = random.Random(5)
    for _ in range(400):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        want = []
        rule(s, 0, len(s), want)
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want)]
        assert [x for *_, x in got] == pytest.approx([x for *_, x in sorted(want)])


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of and to in it is was".split()) for _ in range(60)) + (" vile vilest rotten" if i % 5 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("found", F.lit(1)), model, spans=True).collect()}
    assert all((got[i].toxicity >= 0.7) == (i % 5 == 0) for i in range(300))
    assert all((60, 63) == (p.first, p.after) for i in range(0, 300, 5) for p in got[i].toxicity_passages)
    twice = toxicity.score(toxicity.score(df, model, "text_score", spans=True), model, "text_score", spans=True)
    assert twice.columns == ["doc_id", "text", "text_score", "text_score_passages"] and {r.doc_id: r.text_score for r in twice.collect()} == {d: r.toxicity for d, r in got.items()}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.drop_toxic(empty, model).count() == 0
    for few in (labels.where("toxic = 0"), labels.where("toxic = 1"), labels.limit(0)):
        one = toxicity.fit(df, few)
        assert not one.weights and toxicity.score(docs, one, "s").count() == len(ROWS)


def test_secrets(spark, docs, empty):
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = [hexa(40) for _ in range(40)]
    rows = [(i, f'set token = "{k}" here, {k}') for i, k in enumerate(keys)]
    rows += [(100 + i, "seen " + "".join(rng.choice(["ing", "ation", "the"]) for _ in range(8)) + " words") for i in range(60)]
    rows += [(200, None), (201, ""), (0, rows[0][1]), (None, 'token = "' + keys[3] + '"')]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text"), "score": F.lit(9), "value": F.lit("own")})
    found = secret_scan.scan(df)
    for r in found.collect():
        text = next(t for d, t in rows if d == r.doc_id)
        assert text[r.start : r.start + len(r.value)] == r.value
        assert r.is_secret == (r.value in keys)
    out = secret_scan.redact(df, found)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.text is None or not any(k in r.text for k in keys) and r.n_chars == len(r.text)
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redact(docs, secret_scan.scan(docs)).count() == len(ROWS)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in alone}


def test_pipeline(spark, tmp_path):
    """Stages keep the columns of documents; what each takes away is what its operator decides."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, now, sf))
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        changed = [d for d, r in after.items() if r != before[d]]
        assert name == "secrets" or not changed
        if name == "secrets":
            assert len(after) == len(before) and all("[SECRET]" in after[d].text for d in changed)
        if name == "exact_dedup":
            assert len({norm(r.text) for r in after.values()}) == len(after) == len({norm(r.text) for r in before.values()})
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in now.collect()}
    assert json.dumps(sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())) == json.dumps(sorted(r.doc_id for r in last))
