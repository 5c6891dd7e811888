"""Whole examples and the digests taken from them, against plain Python."""

from collections import defaultdict

import duckdb

from panelcast.llm import chat

SF = "/root/testdata/sf0.001"


def test_every_reply_has_all_turns_before_it(spark):
    turns = defaultdict(list)
    for c, _, role, text in duckdb.sql(f"SELECT conv_id, turn, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall():
        turns[c].append((role, text))
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    examples = chat.prefix_examples(table)
    got = defaultdict(list)
    for r in chat.whole_examples(examples).collect():
        got[r.conv_id].append(r)
    chars = {r.conv_id: r.formatted_chars for r in chat.formatted(table).collect()}
    for c, said in turns.items():
        rows = sorted(got.get(c, []), key=lambda r: r.example)
        ends = [i for i, (role, _) in enumerate(said) if role == "assistant"]
        assert len(rows) == len(ends)
        for r, i in zip(rows, ends):
            assert chat.parse(r.text) == said[: i + 1]
            assert chat.unescape(r.text[r.loss_start : r.loss_end]) == said[i][1]
        rest = not ends or ends[-1] < len(said) - 1
        assert (chars[c] > sum(len(r.text) for r in rows)) if rest else (chars[c] == sum(len(r.text) for r in rows))


def test_long_conversations_come_in_several_batches(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t} " + "x" * 20_000) for c in range(3) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.whole_examples(chat.prefix_examples(turns)).collect()
    assert len(out) == 90
    for r in out:
        assert [t for _, t in chat.parse(r.text)] == [x[3] for x in rows if x[0] == r.conv_id][: 2 * r.example + 2]
    lengths = defaultdict(int)
    for r in out:
        lengths[r.conv_id] += len(r.text)
    assert {r.conv_id: r.formatted_chars for r in chat.formatted(turns).collect()} == lengths
