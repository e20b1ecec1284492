"""Chat formatting with a grammar round trip.

Grammar:  conversation = turn*
          turn         = "<s>" role "\\n" body "</s>"
          body         = "[INST] " text " [/INST]" for the role user, else text
Control strings are <s>, </s>, [INST] and [/INST].  One inside a text or role is escaped by a backslash after its first
character (one more where there are some already), and "\\n" in a role is written \\n.  A turn is first rendered as it is,
parsed again and compared; where the parser doesn't recover it, its content is escaped, again and again until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import table
from quarry.workers import ship

OPEN, CLOSE, INST, END_INST = "<s>", "</s>", "[INST]", "[/INST]"
USER, ASSISTANT = "user", "assistant"
_PLAIN = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")


class Turn(NamedTuple):
    role: str
    text: str


def escape(x: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", x)


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", x)


def escape_role(x: str) -> str:
    return escape(x.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(x))


def written(role: str, text: str) -> tuple[str, int]:
    """A turn whose role and text are escaped already, and where its text begins."""
    head = f"{OPEN}{role}\n" + (f"{INST} " if role == USER else "")
    return head + text + (f" {END_INST}" if role == USER else "") + CLOSE, len(head)


def parse(rendered: str) -> list[tuple[Turn, int, int]]:
    """Turns, and the span of each text in the rendered string.  Raises ValueError for what isn't of the grammar."""
    out, at = [], 0
    while at < len(rendered):
        line, close = rendered.find("\n", at), rendered.find(CLOSE, at)
        if not rendered.startswith(OPEN, at) or line < 0 or close < line:
            raise ValueError(f"no turn at {at}")
        role, lo, hi = rendered[at + len(OPEN) : line], line + 1, close
        if role == USER:
            if not (rendered.startswith(f"{INST} ", lo) and rendered.endswith(f" {END_INST}", lo + len(INST) + 1, hi)):
                raise ValueError(f"no instruction at {lo}")
            lo, hi = lo + len(INST) + 1, hi - len(END_INST) - 1
        body = rendered[lo:hi]
        if any(c in body for c in (OPEN, INST, END_INST)) or any(c in role for c in (OPEN, CLOSE, INST, END_INST)):
            raise ValueError(f"control string inside a turn at {at}")
        out.append((Turn(unescape_role(role), unescape(body)), lo, hi))
        at = close + len(CLOSE)
    return out


def render(turn: Turn) -> tuple[str, int, int]:
    """The turn as the grammar has it, and the span of its text."""
    role, text = escape_role(turn.role), turn.text
    while True:
        out, lo = written(role, text)
        try:
            if [p[0] for p in parse(out)] == [turn]:
                return out, lo, lo + len(text)
        except ValueError:
            pass
        text = escape(text)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (array of [begin, end) of assistant texts in formatted, code points), n_turns.

    Turns go by turn, then role and text; nulls come first.  Null texts and roles are empty.  Repeated rows are turns of their own.
    Rows of a null conv_id are one conversation.  Other columns are not read.  Rows are sorted by conversation and turn and
    streamed: a task holds one formatted conversation at a time."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # conv_id, parts, spans, length
        done: list = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array(["".join(d[1]) for d in done], pa.string()), pa.array([d[2] for d in done], pa.list_(pa.list_(pa.int64()))), pa.array([len(d[1]) for d in done], pa.int64())], ["conv_id", "formatted", "loss_spans", "n_turns"])
            done.clear()
            return out

        for b in batches:
            for conv, role, text in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if not held or held[0] != conv:
                    if held:
                        done.append(held)
                    held = [conv, [], [], 0]
                out, lo, hi = render(Turn(role, text))
                if role == ASSISTANT:
                    held[2].append([held[3] + lo, held[3] + hi])
                held[1].append(out)
                held[3] += len(out)
            if done:
                yield flush()
        if held:
            done.append(held)
            yield flush()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<array<bigint>>, n_turns bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings finds: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, whole, spans in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                found = parse(whole)
                for turn, _, _ in found:
                    turns.update(f"{turn.role}\n{turn.text}\n".encode())
                chars = 0
                for lo, hi in spans:
                    text = unescape(whole[lo:hi])
                    chars += len(text)
                    loss.update(text.encode())
                out.append((conv, len(found), turns.hexdigest(), chars, loss.hexdigest(), len(whole)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, USER, own), (-7, 1, ASSISTANT, own)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
_ROLE = _ESC.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     c AS (SELECT *, regexp_matches(text, '[<\[]\\*(s>|/s>|INST\]|/INST\])') AS conflict FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length({_ROLE}) + length(CASE WHEN conflict THEN {_ESC.format("text")} ELSE text END) + CASE WHEN role = 'user' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
