"""One nested JSON record per case, made as a stream.

Items of all tables of a report meet in one sorted stream per partition of cases, and a generator writes brackets and
commas between them. It holds one item at a time, so a case with a third of all items takes no more memory than any other:
its record leaves the task in pieces. Sorting such a case is left to the engine, which spills.

A record is its pieces joined by single spaces: pieces end between two tokens, or after a comma inside a recommendation
where a space belongs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.operators.report import ADVICE, ReportTables
from casequarry.sources.sinks import CONDITION_FIELDS

DOCUMENT_FIELDS = (
    "doc_id", "file_name", "doc_type", "category", "status", "upload_timestamp", "classified_as", "classification_confidence",
    "manually_overridden",
)
ISSUE_FIELDS = ("condition_name", "severity", "status", "analyst_message", "sources_used", "details")
#: Characters of a piece, about.
PIECE_CHARS = 65_536

# Members of a record in their order; the four lists have a row per item.
HEAD, DOCUMENTS, CONDITIONS, ISSUES, NARRATIVE, RECOMMENDATIONS, ATTENTION = range(7)
LISTS = {
    DOCUMENTS: "document_inventory", CONDITIONS: "condition_results", ISSUES: "flagged_issues", RECOMMENDATIONS: "recommendations",
}
# Texts around the names of a recommendation, by its place in ADVICE; the others are whole sentences.
_AROUND = {
    ADVICE.index(kind): message.split("%s")
    for kind, message in (("blocking", fv.MSG_BLOCKING), ("review", fv.MSG_REVIEW), ("unclassified", fv.MSG_UNCLASSIFIED))
}
_ORDER = ("a", "b", "c", "d")

#: (case, text, what belongs after it: a space, nothing, or None where no piece may end; is it the record's last)
Unit = tuple[str, str, str | None, bool]


def _json(names: Iterable[str]):
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def _items(df: DataFrame, section: int, order: list, text, kind=None, n=None) -> DataFrame:
    places = [*order, *[F.lit(None)] * (len(_ORDER) - len(order))]
    return df.select(
        "case_id",
        F.lit(section).alias("section"),
        *[(F.col(o) if isinstance(o, str) else o).cast("bigint").alias(name) for o, name in zip(places, _ORDER, strict=True)],
        (F.lit(None).cast("int") if kind is None else kind).alias("kind"),
        (F.lit(None).cast("bigint") if n is None else n).alias("n"),
        text.alias("text"),
    )


def record_items(tables: ReportTables, issue_fields: Iterable[str] = ISSUE_FIELDS) -> DataFrame:
    """All parts of all records, a row each, with what orders them in a case."""
    kind = F.lit(len(ADVICE))
    for k, name in enumerate(ADVICE):
        kind = F.when(F.col("kind") == name, k).otherwise(kind)
    advice = tables.recommendations.withColumn("_kind", kind)
    unread = advice.where(F.col("kind") == "unclassified").groupBy("case_id").agg(F.count(F.lit(1)).alias("_unread"))
    reports = tables.reports.join(unread, "case_id", "left")
    # A text as it stands inside quotes.
    quoted = F.to_json(F.array(F.coalesce("name", "message")))
    inside = F.expr("substring(_quoted, 3, length(_quoted) - 4)")
    order = ["condition_seq", "type_pos", "doc_seq"]
    parts = [
        _items(reports, HEAD, [], _json(["case_id", "generated_at"]), n=F.coalesce("_unread", F.lit(0))),
        _items(tables.document_inventory, DOCUMENTS, ["doc_seq"], _json(DOCUMENT_FIELDS)),
        _items(tables.condition_results, CONDITIONS, order, _json(CONDITION_FIELDS)),
        _items(tables.flagged_issues, ISSUES, ["severity_rank", *order], _json(issue_fields)),
        _items(reports, NARRATIVE, [], _json(["narrative_summary"])),
        _items(advice.withColumn("_quoted", quoted), RECOMMENDATIONS, ["_kind", "place"], inside, kind=F.col("_kind")),
        _items(reports, ATTENTION, [], _json(["requires_analyst_attention"])),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lined_up(items: DataFrame) -> DataFrame:
    nulls_first = [F.col(c).asc_nulls_first() for c in _ORDER]
    return items.repartition("case_id").sortWithinPartitions("case_id", "section", *nulls_first, "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("case_id", "section", "kind", "n", "text")), strict=True)


def _escaped(text: str) -> str:
    return json.dumps(text)[1:-1]


def units(rows: Iterable[tuple]) -> Iterator[Unit]:
    """Texts whose concatenation (each with its gap) is the record of every case; cases without a report are passed over."""
    case, at, filled, kind, held, unread = None, None, False, None, None, 0

    def end_of_names() -> Iterator[Unit]:
        if kind is not None:
            after = _AROUND[kind][1] if kind in _AROUND else ""
            yield case, held + _escaped(after) + '"', "", False

    for row_case, section, row_kind, n, text in rows:
        if section == HEAD:
            case, at, unread = row_case, HEAD, n
            yield case, text[:-1], "", False
            continue
        if at is None or row_case != case:
            at = None
            continue
        if section != at:
            if at in LISTS:
                yield from end_of_names()
                kind = None
                yield case, "]", "", False
            for between in range(at + 1, section):
                if between in LISTS:
                    yield case, f',"{LISTS[between]}":[]', "", False
            at, filled = section, False
            if at in LISTS:
                yield case, f',"{LISTS[at]}":[', "", False
        if at == RECOMMENDATIONS:
            if kind == row_kind and kind in _AROUND:
                yield case, held + ",", " ", False
                held = text
            else:
                yield from end_of_names()
                before = _AROUND[row_kind][0] if row_kind in _AROUND else ""
                before = before.replace("%d", str(unread))
                yield case, ("," if filled else "") + '"' + _escaped(before), None, False
                kind, held = row_kind, text
        elif at in LISTS:
            yield case, ("," if filled else "") + text, "", False
        else:  # the one member of a small object
            yield case, "," + text[1:-1] + ("}" if at == ATTENTION else ""), "", at == ATTENTION
            if at == ATTENTION:
                case = at = None
        filled = True


def _pieces(found: Iterator[Unit], chars: int) -> Iterator[tuple[str, int, bool, str]]:
    """(case, number of the piece, is it the last, text)."""
    number, size, held = 0, 0, []
    for case, text, gap, last in found:
        held.append(text)
        size += len(text)
        if last or (size >= chars and gap is not None):
            yield case, number, last, "".join(held)
            number, size, held = (0 if last else number + 1), 0, []
        else:
            held.append(gap or "")
            size += len(held[-1])


_PIECE = pa.schema([("case_id", pa.string()), ("piece", pa.int64()), ("is_last", pa.bool_()), ("text", pa.string())])
_DIGEST = pa.schema([("case_id", pa.string()), ("chars", pa.int64()), ("record_hash", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)


def record_pieces(items: DataFrame, chars: int = PIECE_CHARS) -> DataFrame:
    """(case_id, piece, is_last, text) of ``record_items``; pieces of a case leave their task in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_pieces(units(_rows(batches)), chars), _PIECE, 64)

    return _lined_up(items).mapInArrow(cut, "case_id string, piece long, is_last boolean, text string")


def record_digests(items: DataFrame) -> DataFrame:
    """(case_id, chars, record_hash): length and SHA-256 of every record without spaces between tokens."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            state, chars = hashlib.sha256(), 0
            for case, text, gap, last in units(_rows(batches)):
                whole = text + (gap or "")
                state.update(whole.encode())
                chars += len(whole)
                if last:
                    yield case, chars, state.hexdigest()
                    state, chars = hashlib.sha256(), 0

        yield from _batches(digests(), _DIGEST, 1000)

    return _lined_up(items).mapInArrow(digest, "case_id string, chars long, record_hash string")


def write_records(tables: ReportTables, path: str, chars: int = PIECE_CHARS) -> None:
    """Write a line of JSON per case to text files under ``path``."""
    pieces = record_pieces(record_items(tables), chars)
    # The line separator is the space between pieces; what ends a line is part of the text.
    lines = pieces.select(F.concat("text", F.when(F.col("is_last"), "\n").otherwise("")).alias("value"))
    lines.write.mode("errorifexists").option("lineSep", " ").text(path)
