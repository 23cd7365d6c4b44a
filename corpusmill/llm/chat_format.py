r"""Chat formatting by a grammar round trip.

A conversation is its turns one after another; a turn is ``### <Role>: <content></turn>`` and a
line end. The parser reads content up to the first ``</turn>``; a backslash before a backslash,
``###`` or ``</turn>`` makes that string plain, and an unescaped ``###`` is a syntax error.
Rendered turns are parsed again; content that doesn't come back as it was is escaped until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt

_NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_ROLES = {v: k for k, v in _NAMES.items()}
_HEAD = re.compile(r"### ([^:\n]*): ")
_CONTROL = re.compile(r"\\(\\|###|</turn>)|</turn>|###")
_END = "</turn>\n"


def label(role: str | None) -> str:
    """A role's name in headers: known roles by name, others quoted after ``=``, null as ``-``."""
    return "-" if role is None else _NAMES.get(role) or "=" + quote(role, safe="")


def parse(rendered: str) -> list[tuple[str | None, str]] | None:
    """The turns of a rendered text, or None if it isn't in the language."""
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            return None
        name, at, parts = head[1], head.end(), []
        for m in _CONTROL.finditer(rendered, at):
            if m[0] == "###":
                return None
            parts.append(rendered[at : m.start()])
            at = m.end()
            if m[0] == "</turn>":
                break
            parts.append(m[1])
        else:
            return None
        if rendered[at : at + 1] != "\n":
            return None
        at += 1
        turns.append((None if name == "-" else _ROLES.get(name) or unquote(name[1:]), "".join(parts)))
    return turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(content: str) -> str:
    return _CONTROL.sub(lambda m: m[1] or m[0], content)


def render(role: str | None, text: str) -> tuple[str, int, bool]:
    """A turn's rendering, where its content starts, and whether it is escaped."""
    head = f"### {label(role)}: "
    for escaped, content in ((False, text), (True, escape(text))):
        if parse(out := head + content + _END) == [(role, text)]:
            return out, len(head), escaped
    raise ValueError(f"a turn of role {role!r} doesn't come back")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: (conv_id, pos, rendered, loss_start, loss_end, escaped).

    Rows of a conversation come together in one partition, in order of (turn, role, text); the
    formatted conversation is its ``rendered`` strings in order of ``pos``. Loss spans are code
    points of ``rendered`` and cover the contents of assistant turns; other turns have null spans.
    Null texts are empty; a null role stays null; rows with a null conversation form one; repeated
    rows are turns of their own; an empty table gives no rows. Memory holds one batch of rows
    however long a conversation is.
    """
    conv = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = object(), 0
        for batch in batches:
            rows = []
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                pos = pos + 1 if key == last else 0
                last = key
                out, start, escaped = render(role, text)
                spans = (start, len(out) - len(_END)) if role == "assistant" else (None, None)
                rows.append((pos, out, *spans, escaped))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["conv_id", "pos", "rendered", "loss_start", "loss_end", "escaped"])

    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = dealt(rows, "c").sortWithinPartitions("c", "_turn", "r", "t").select("c", "r", "t")
    return rows.mapInArrow(run, f"conv_id {conv}, pos long, rendered string, loss_start long, loss_end long, escaped boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped).

    Turns are parsed from the text; the loss is what the spans cut out of it, unescaped. Rows of
    format_turns may lie in any order. Memory holds one batch of rows; a conversation's digests are
    made by one task, as a digest needs its text in order.
    """
    conv = formatted.schema["conv_id"].dataType.simpleString()
    kinds = ("long", "string", "long", "string", "long", "long")
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def table(done: list[list]) -> pa.RecordBatch:
            done = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in done]
            types = [pa.int64() if kind == "long" else pa.string() for kind in kinds]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], id_type), *(pa.array([r[k + 1] for r in done], kind) for k, kind in enumerate(types))], names=["conv_id", *names])

        id_type = None
        for batch in batches:
            done, id_type = [], batch.schema.field(0).type
            for key, pos, out, start, end, escaped in zip(*(c.to_pylist() for c in batch.columns)):
                if pos == 0:
                    done += [state] if state else []
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(out):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(out[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(out)
                state[6] += escaped
            yield table(done)
        if state:
            yield table([state])

    rows = dealt(formatted, "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "pos", "rendered", "loss_start", "loss_end", "escaped")
    return rows.mapInArrow(run, f"conv_id {conv}, {', '.join(f'{n} {k}' for n, k in zip(names, kinds))}")


#: The conversation whose texts hold the template's own strings.
CONFLICT = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return read_back(cut(format_turns(turns.unionByName(planted)), "formatted"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\') OR suffix(text, '\') AS odd,
    length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS long_,
    CASE WHEN role IS NULL THEN 1 WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role) ELSE 1 + length(url_encode(role)) END AS label_
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + label_ + CASE WHEN odd THEN long_ ELSE length(text) END)::BIGINT AS formatted_chars,
  sum(odd::INT)::BIGINT AS n_escaped
FROM e GROUP BY conv_id"""
