"""Chat formatting with a grammar that is read back.

A turn is rendered as ``<s>role[INST]text[/INST]</s>``; a conversation is its turns in order, nothing between. The
grammar is deterministic: from ``<s>`` the role runs to the next control string, which must be ``[INST]``, the text
to the one after it, which must be ``[/INST]``, and ``</s>`` follows. Every rendered turn is parsed again; if what
comes back isn't the source, the conflicting content is escaped and it is parsed once more. An escape puts one more
backslash after the first character of a control string, or of one that already has backslashes there, so undoing it
takes exactly one away: ``</s>`` -> ``<\\/s>`` -> ``<\\\\/s>``.

The loss mask covers the texts of assistant turns.

Rows of a conversation are sorted within its partition and read as a stream, so memory does not grow with its turns.

Cases: null text and null role are empty; a null ``conv_id`` is a conversation of its own; turns with one number, or
repeated rows, are ordered by role and text and all kept, a null turn comes first; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store

LOSS_ROLE = "assistant"
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
_CONFLICT = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(/?(?:s>|INST\]))")
_GRAMMAR = ("<s>", "[INST]", "[/INST]", "</s>")

TURNS = "conv_id long, turn long, role string, rendered string, loss_from long, loss_to long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])')) + length(role) + 20 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def escape(text: str) -> str:
    return _CONFLICT.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns; ValueError where the text isn't in the grammar."""
    turns, parts, at = [], [], 0
    for m in CONTROL.finditer(rendered):
        step = len(parts)
        if m[0] != _GRAMMAR[step] or (step in (0, 3) and m.start() != at):
            raise ValueError(f"{m[0]} at {m.start()}, {_GRAMMAR[step]} expected")
        parts.append(rendered[at : m.start()])
        at = m.end()
        if step == 3:
            turns.append((unescape(parts[1]), unescape(parts[2])))
            parts = []
    if parts or at != len(rendered):
        raise ValueError("unfinished turn")
    return turns


def _written(role: str, text: str) -> str:
    return f"<s>{role}[INST]{text}[/INST]</s>"


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and from where to where the loss mask lies in it."""
    own_role, own_text = role, text
    while True:
        out = _written(own_role, own_text)
        try:
            if parse(out) == [(role, text)]:
                break
        except ValueError:
            pass
        own_role, own_text = escape(own_role), escape(own_text)
    begin = out.index("[INST]") + len("[INST]")
    return out, begin, begin + (len(own_text) if role == LOSS_ROLE else 0)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [render_turn(r or "", t or "") for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
        cells = [b["conv_id"], b["turn"], b["role"], *(pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))]
        yield pa.RecordBatch.from_arrays(cells, names=["conv_id", "turn", "role", "rendered", "loss_from", "loss_to"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rendered turns by conversation, in order within their partition; ``loss_from``/``loss_to`` mark the loss text."""
    store.small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_render, TURNS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    now, open_ = None, False
    turns = loss = None
    n = loss_chars = chars = 0

    def closed() -> tuple:
        return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for b in batches:
        for conv, text, begin, end in zip(*(b[c].to_pylist() for c in ("conv_id", "rendered", "loss_from", "loss_to")), strict=True):
            if not open_ or conv != now:
                if open_:
                    done.append(closed())
                now, open_, n, loss_chars, chars = conv, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, said in parse(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            under = unescape(text[begin:end])
            loss.update(under.encode())
            loss_chars += len(under)
            chars += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done = []
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as parsed from its rendered turns, which come in order within a partition."""
    return formatted.mapInArrow(_read_back, DIGESTS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(rows))


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {"op5_chat_format": ORACLE}
