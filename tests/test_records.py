"""Nested records of cases against their tables."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casequarry.operators import report as rp
from casequarry.sources import records as rc

RESULTS = (
    "case_id string, condition_seq int, type_pos int, doc_seq long, doc_id string, condition_name string, status string, severity string, "
    "analyst_message string, check_type string, sources_used array<string>, details map<string,string>"
)
DOCS = (
    "case_id string, doc_id string, doc_seq long, file_name string, doc_type string, category string, status string, upload_timestamp string, "
    "extracted_data map<string,struct<text:string,kind:string>>"
)
CLASSES = "case_id string, doc_id string, doc_seq long, detected_type string, confidence double, manually_overridden boolean"


def tables_of(spark, many):
    """Case ``hot`` holds most rows; ``empty`` has none; ``gone`` has rows and no report."""
    cases = spark.createDataFrame([(c, "x", "p") for c in ("hot", "empty", "few", 'q"\\uote')], "case_id string, country string, process_type string")
    size = {"hot": many, "few": 2, 'q"\\uote': 3, "gone": 4}
    docs, classes, results = [], [], []
    for c, n in size.items():
        for k in range(n):
            docs.append((c, f"{c}-{k}", k, f"datei ä\n{k}.txt", "", None, "failed" if k % 5 == 1 else "extracted", None, {}))
            classes.append((c, f"{c}-{k}", k, "needs_manual_classification" if k % 3 == 0 else "salary_slip", k / 7, False))
            status = ("pass", "fail", "needs_review")[k % 3]
            results.append((c, k % 4, 0, k, f"{c}-{k}", f"cond, \"{k % 4}\"", status, "error", f"msg {k} [x]", "deterministic", [f"{k}"], {"a": None}))
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(classes, CLASSES), spark.createDataFrame(results, RESULTS)
    return rp.report_tables(cases, *frames, generated_at=dt.datetime(2024, 5, 31, 12)), results


def wanted(tables):
    """Records from the collected tables."""
    plain = lambda df, cols: [{k: r[k] for k in cols} for r in df.collect()]
    out = {}
    for r in tables.reports.collect():
        c = r.case_id
        mine = lambda df: df.where(F.col("case_id") == c)  # noqa: E731, B023
        order = ["condition_seq", "type_pos", "doc_seq"]
        lines = {}
        for a in sorted(mine(tables.recommendations).collect(), key=lambda a: a.place or 0):
            lines.setdefault(a.kind, []).append(a.name if a.name is not None else a.message)
        said = []
        for kind in rp.ADVICE:
            if kind in lines:
                names = ", ".join(lines[kind])
                said.append({
                    "blocking": f"Blocking issues found in: {names}. Analyst must resolve before proceeding.",
                    "review": f"Items requiring analyst review: {names}.",
                    "unclassified": f"{len(lines[kind])} document(s) could not be auto-classified: {names}",
                }.get(kind, names))
        out[c] = {
            "case_id": c,
            "generated_at": "2024-05-31T12:00:00.000Z",
            "document_inventory": plain(mine(tables.document_inventory).orderBy("doc_seq"), rc.DOCUMENT_FIELDS),
            "condition_results": plain(mine(tables.condition_results).orderBy(*order), rc.CONDITION_FIELDS),
            "flagged_issues": plain(mine(tables.flagged_issues).orderBy("severity_rank", *order), rc.ISSUE_FIELDS),
            "narrative_summary": r.narrative_summary,
            "recommendations": said,
            "requires_analyst_attention": r.requires_analyst_attention,
        }
    return out


@pytest.mark.parametrize(("many", "chars"), [(40, 50), (400, 3000), (7, 10_000_000)])
def test_pieces_make_the_records(spark, many, chars):
    tables, _ = tables_of(spark, many)
    items = rc.record_items(tables)
    texts = {}
    for r in rc.record_pieces(items, chars).orderBy("case_id", "piece").collect():
        texts.setdefault(r.case_id, []).append(r.text)
        # A piece is as long as it should be and one item more.
        assert len(r.text) < chars + 600
    want = wanted(tables)
    assert {c: json.loads(" ".join(t)) for c, t in texts.items()} == want
    if chars == 50:
        assert len(texts["hot"]) > 40 and len(texts["empty"]) > 1
    digests = {r.case_id: (r.chars, r.record_hash) for r in rc.record_digests(items).collect()}
    whole = {c: json.dumps(w, ensure_ascii=False, separators=(",", ":")) for c, w in want.items()}
    assert digests == {c: (len(t), hashlib.sha256(t.encode()).hexdigest()) for c, t in whole.items()}


def test_written_lines_are_read_back(spark, tmp_path):
    tables, _ = tables_of(spark, 60)
    rc.write_records(tables, f"{tmp_path}/out", chars=200)
    lines = [x for f in tmp_path.glob("out/part-*") for x in f.read_text().splitlines() if x.strip()]
    assert {r["case_id"]: r for r in map(json.loads, lines)} == wanted(tables)
    back = spark.read.json(f"{tmp_path}/out")
    assert back.where("case_id IS NOT NULL").count() == 4
    row = back.where("case_id = 'hot'").select(F.size("document_inventory"), F.size("flagged_issues")).first()
    assert tuple(row) == (60, 40)


def test_one_case_does_not_fill_the_memory():
    """A case of many items passes through the generator with one unit held at a time."""

    def rows():
        yield "c", rc.HEAD, None, 0, '{"case_id":"c"}'
        for k in range(200_000):
            yield "c", rc.DOCUMENTS, None, None, f'{{"doc_id":"{k}"}}'
        yield "c", rc.NARRATIVE, None, None, '{"narrative_summary":null}'
        for k in range(100_000):
            yield "c", rc.RECOMMENDATIONS, 0, None, f"name {k}"
        yield "c", rc.ATTENTION, None, None, '{"requires_analyst_attention":true}'

    sizes = [len(text) for _, _, _, text in rc._pieces(rc.units(rows()), 10_000)]
    assert max(sizes) < 10_100 and len(sizes) > 300
