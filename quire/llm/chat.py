r"""Chat formatting by prefix-target expansion: every assistant turn is an example, all turns before it its context.

A conversation is formatted once, turn by turn::

    <s>[SYS] text [/SYS]      <s>[INST] text [/INST]      text</s>

and an example is a prefix of that string: its context ends where its target begins, and only the target is
trainable. Examples hold offsets into the formatted turns instead of copies of them, so that the size of the output
grows with the turns and not with their square; ``render`` puts an example's text together.

Control strings inside texts are escaped reversibly: a backslash becomes ``\\``, and ``\`` is put after the ``<`` or ``[``
that begins a control string, so that none is left in a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import scratch_path

CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARKS = {"system": ("<s>[SYS] ", " [/SYS]"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """(before, body, after) of a turn: template marks around the escaped text. A role of its own is kept in a marked header."""
    if role in _MARKS:
        before, after = _MARKS[role]
    else:
        before, after = f"<s>[ROLE] {escape(role)} [/ROLE] ", "</s>"
    return before, escape(text), after


_TURNS = ("conv_id long, turn_no long, role string, formatted string, start long, body_start long, body_end long, end long, "
          "example long")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to formatted turns with running offsets; of a conversation only two counters are held."""
    conv, n, at, example = object(), 0, 0, 0
    for batch in batches:
        rows = []
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != conv:
                conv, n, at, example = c, 0, 0, 0
            before, body, after = format_turn(role or "", text or "")
            b = at + len(before)
            end = b + len(body) + len(after)
            rows.append((c, n, role or "", before + body + after, at, b, b + len(body), end, example if role == "assistant" else None))
            n, at, example = n + 1, end, example + (role == "assistant")
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=[x.split()[0] for x in _TURNS.split(", ")])


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def write_examples(conversations: DataFrame, path: str) -> None:
    """Format ``conversations`` (conv_id, turn, role, text) into the folder ``path``.

    ``path/turns``: the formatted turns of a conversation, in order, with their offsets (code points) in its formatted
    text. ``path/examples``: one row per assistant turn, (conv_id, example, context_end, target_start, target_end):
    context is [0, context_end), the target and only trainable part [target_start, target_end).
    Rows are taken by turn, ties by role, then text; a null text or role is empty, a null turn comes first, null
    conversation ids are one conversation; repeated rows are turns of their own; other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    rows = _ordered(rows, "turn", "role", "text").select("conv_id", "role", "text")
    rows.mapInArrow(_format, _TURNS).write.parquet(f"{path}/turns")
    turns = conversations.sparkSession.read.parquet(f"{path}/turns")
    (turns.where("example is not null")
     .select("conv_id", "example", F.col("start").alias("context_end"), F.col("body_start").alias("target_start"), F.col("body_end").alias("target_end"))
     .write.parquet(f"{path}/examples"))


def render(spark: SparkSession, path: str, conv_id: int, example: int) -> tuple[str, str]:
    """(context, target) texts of one example, put together from the turns before it."""
    e = spark.read.parquet(f"{path}/examples").where((F.col("conv_id") == conv_id) & (F.col("example") == example)).first()
    turns = (spark.read.parquet(f"{path}/turns").where((F.col("conv_id") == conv_id) & (F.col("start") <= e["context_end"]))
             .orderBy("turn_no").collect())
    text = "".join(t["formatted"] for t in turns)
    return text[:e["context_end"]], text[e["target_start"]:e["target_end"]]


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    for role, (before, after) in _MARKS.items():
        if formatted.startswith(before) and role != "assistant":
            return role, unescape(formatted[len(before):len(formatted) - len(after)])
    if formatted.startswith("<s>[ROLE] "):
        head, body = formatted[len("<s>[ROLE] "):].split(" [/ROLE] ", 1)
        return unescape(head), unescape(body[:-len("</s>")])
    before, after = _MARKS["assistant"]
    return "assistant", unescape(formatted[len(before):len(formatted) - len(after)])


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests per conversation over its formatted turns, in order, with the target of the example that ends each."""
    state = None

    def row(s):
        return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["examples"]

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _READ.split(", ")])

    for part in batches:
        done = []
        for conv, formatted, start, target_start, target_end in zip(*(part.column(i).to_pylist() for i in range(5))):
            if state is None or state["conv"] != conv:
                if state:
                    done.append(row(state))
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "examples": 0}
            role, text = parse_turn(formatted)
            state["turns"].update(f"{role}\n{text}\n".encode())
            state["n"] += 1
            state["formatted"] += len(formatted)
            if target_start is not None:
                target = unescape(formatted[target_start - start:target_end - start])
                state["loss"].update(target.encode())
                state["chars"] += len(target)
                state["examples"] += 1
        if done:
            yield batch(done)
    if state:
        yield batch([row(state)])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples) read back from ``write_examples``.

    ``formatted_chars`` are those of the formatted conversation, ``n_examples`` its assistant turns. Every example's
    target is taken from the formatted turns by its offsets. Turns stream through a task in order; a task holds a
    batch of them and the digests of one conversation.
    """
    turns, examples = spark.read.parquet(f"{path}/turns"), spark.read.parquet(f"{path}/examples")
    # an example begins its target in the turn that starts at its context's end
    both = turns.alias("t").join(examples.alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.start") == F.col("e.context_end")), "left") \
        .select("t.conv_id", "t.turn_no", "t.formatted", "t.start", "e.target_start", "e.target_end")
    ordered = _ordered(both, "turn_no").select("conv_id", "formatted", "start", "target_start", "target_end")
    return ordered.mapInArrow(_digest, _READ)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format ``conversations`` into the shared folder and describe what its files hold."""
    path = scratch_path(conversations.sparkSession, "chat")
    write_examples(conversations, path)
    return read_digests(conversations.sparkSession, path)
