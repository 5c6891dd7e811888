"""Chat formatting by prefix-target expansion: one example per assistant turn, only that reply trainable."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh_folder, partitions

#: Control strings of the template and of other common ones, escaped inside texts. Fixed values.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
EXAMPLES = "conv_id long, example long, first_turn long, role array<string>, segment string, prefix_chars long, loss_start long, loss_end long"

_ESCAPE = r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)


def escape(text: Column) -> Column:
    """Put a backslash before every backslash and after the first sign of every control string."""
    java = _ESCAPE
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "(" + java.removeprefix(r"\\|") + ")", r"$1\\")


def unescape(text: str) -> str:
    """A backslash stands before a sign taken as it is."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


TAIL = "<|end|>\n"
_TURN = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>\n((?:[^<\\]|\\.|<(?!\|))*)<\|end\|>\n", re.S)


def parse(segment: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted segment."""
    out, at = [], 0
    while at < len(segment):
        m = _TURN.match(segment, at)
        if m is None:
            raise ValueError("not a formatted segment")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn in the template: conv_id, turn, role, formatted, lead (signs before its text), body (signs of it).

    ``<|role|>`` newline text ``<|end|>`` newline. A map over the rows. A null text or role counts as empty; a
    null turn sorts first; other columns are not read.
    """
    # a role is free text too: its bars are escaped, so that the mark ends where it should
    role, text = F.coalesce(F.col("role"), F.lit("")), escape(F.coalesce(F.col("text"), F.lit("")))
    marked = head(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), r"\|", r"\\|"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.concat(marked, text, F.lit(TAIL)).alias("formatted"), F.length(marked).alias("lead"), F.length(text).alias("body"),
    )


def prefix_examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """One row per turn of the ``target`` role: the example whose context is every turn before it.

    All examples of a conversation are prefixes of its formatted text, so a row stores only the ``segment`` that
    its predecessor lacks, ``prefix_chars`` that come before it, and the loss span ``loss_start`` to
    ``loss_end`` within the whole example; :func:`whole_examples` gives the full texts. Turns after the last
    target are a last row with an empty loss span, so nothing is lost.

    Turns are ordered by turn, then role and text, so ties and repeated rows have an order; they all count. A
    conversation is streamed through one task turn by turn, whatever its length. A null conv_id is a
    conversation. No rows give no rows.
    """
    spark = turns.sparkSession
    ordered = format_turns(turns).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.strip().split(" ")[0] for c in EXAMPLES.split(", ")]
        conv, started, number, before = None, False, 0, 0
        roles: list[str] = []
        parts: list[str] = []
        first, size, out, held = None, 0, [], 0

        def close(start: int, end: int) -> None:
            nonlocal number, before, roles, parts, size, held
            out.append((conv, number, first, roles, "".join(parts), before, start, end))
            number, before, held = number + 1, before + size, held + size
            roles, parts, size = [], [], 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for b in batches:
            for c, turn, role, text, lead, body in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if not started or c != conv:
                    if parts:
                        close(before + size, before + size)
                    conv, started, number, before = c, True, 0, 0
                if not parts:
                    first = turn
                start = before + size + lead
                roles.append(role)
                parts.append(text)
                size += len(text)
                if role == target:
                    close(start, start + body)
            if out and held > 1 << 20:
                yield flush()
                held = 0
        if parts:
            close(before + size, before + size)
        if out:
            yield flush()

    return ordered.mapInArrow(run, EXAMPLES)


def write_examples(turns: DataFrame, path: str) -> None:
    """Write the examples as Parquet."""
    prefix_examples(turns).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def _whole(batches: Iterator) -> Iterator[tuple[int | None, int, str, int, int]]:
    """(conv_id, example, text, loss_start, loss_end) with the whole text, from rows sorted by conversation and example."""
    conv, text = None, ""
    for b in batches:
        for c, n, segment, start, end in zip(*[b.column(i).to_pylist() for i in range(5)]):
            text = segment if n == 0 or c != conv else text + segment
            conv = c
            yield c, n, text, start, end


def _parts(examples: DataFrame) -> DataFrame:
    """The columns that :func:`_whole` reads, in its order."""
    ordered = examples.repartition(partitions(examples.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.select("conv_id", "example", "segment", "loss_start", "loss_end")


def whole_examples(examples: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end with the full text of every example that trains a reply.

    An empty reply trains nothing but is an example; only the row of turns after the last reply is none. An
    example is one value, so the text of one conversation must fit a task.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "example", "text", "loss_start", "loss_end"]
        out, held = [], 0
        for row in _whole(batches):
            if row[3] == len(row[2]):
                continue  # a reply is followed by its end mark, the rest after the last reply by nothing
            out.append(row)
            held += len(row[2])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return _parts(examples).mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, taken from its whole example texts: turns and their digest, parsed from the longest one,
    what is under the loss mask of each, and the characters of all together."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, last, out = None, "", []

        def done() -> None:
            turns, said = parse(last), hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode())
            out.append((now[0], len(turns), said.hexdigest(), now[1], now[2].hexdigest(), now[3]))

        for c, n, text, start, end in _whole(batches):
            if now is None or c != now[0] or n == 0:
                if now is not None:
                    done()
                now = [c, 0, hashlib.sha256(), 0]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out.clear()
            reply = unescape(text[start:end])
            now[1] += len(reply)
            now[2].update(reply.encode())
            now[3] += len(text)
            last = text
        if now is not None:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return _parts(examples).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Write the examples of ``turns`` and return the digests of what is read back."""
    spark = turns.sparkSession
    path = path or fresh_folder(spark)
    write_examples(turns, path)
    return digests(spark.read.parquet(path))
