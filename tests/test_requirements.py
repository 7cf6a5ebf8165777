"""Requirements by process: from the configuration folder to the issues of a review."""

import dataclasses
import datetime as dt
from functools import partial

from casequarry.functions.values import RECORD
from casequarry.operators import completeness as co
from casequarry.operators import prompts as pr
from casequarry.operators.model import call_model
from casequarry.plans.review import ModelSteps, review_cases
from casequarry.sources.config import default_config, load_config

PROCESS = """
country: X
document_requirements:
  identity: {doc_types: [passport, id_card], min_required: 1, max_accepted: 1, role: person}
  income:
    doc_types: [slip]
    min_required: 1
    max_accepted: 2
    role: income
    condition: "request.amount > 100 AND person.country = 'X'"
    temporal_constraints: {slip: {min_count: 2}}
  request: {doc_types: [form], min_required: 1, max_accepted: 1, role: request}
cross_validation_rules:
  - {name: names, description: names agree, sources: [a, b], fields: [name], on_fail: error}
  - {name: dates, description: dates agree, sources: [a, b]}
"""
OTHER = """
document_requirements:
  income: {doc_types: [slip], min_required: 5, max_accepted: 9, role: income, condition: "request.amount > 100 AND person.country = 'X'"}
"""


def configured(tmp_path):
    land = tmp_path / "countries" / "x" / "process"
    land.mkdir(parents=True)
    (land / "loan.yaml").write_text(PROCESS)
    (land / "card.yaml").write_text(OTHER)
    (land / "none.yaml").write_text("business_unit: u\n")
    return load_config(tmp_path)


def documents(spark, rows):
    """rows: case, seq, type, category, fields."""
    cells = [(c, f"{c}{k}", k, t, g, "extracted", {n: dict(text=v, kind=kind) for n, (v, kind) in f.items()}) for c, k, t, g, f in rows]
    return spark.createDataFrame(cells, f"case_id string, doc_id string, doc_seq long, doc_type string, category string, status string, extracted_data {RECORD}")


def test_folder_fills_the_requirements(tmp_path):
    cfg = configured(tmp_path)
    got = [(r["country"], r["process_type"], r["pos"], r["category"], r["role"]) for r in cfg.requirements]
    assert got == [("x", "card", 0, "income", "income"), ("x", "loan", 0, "identity", "person"), ("x", "loan", 1, "income", "income"), ("x", "loan", 2, "request", "request")]
    assert cfg.requirements[2]["temporal_constraints"] == {"slip": 2}
    assert [(v["process_type"], v["name"], v["fields"], v["severity"]) for v in cfg.validations] == [
        ("loan", "names", ["name"], "error"), ("loan", "dates", ["a", "b"], "flag_for_review"),
    ]


def test_conditions_look_at_the_first_record_of_each_role(spark, tmp_path):
    cfg = configured(tmp_path)
    cfg.fields.extend(
        dict(country="x", doc_type=t, pos=0, name=n, type=k, required=False, pattern=None, alias=[], reasoning=None)
        for t, n, k in (("form", "amount", "float"), ("passport", "country", "string"), ("id_card", "country", "string"))
    )
    pairs = [("large", "loan"), ("small", "loan"), ("later", "loan"), ("bare", "loan"), ("card", "card"), ("odd", "none"), ("text", "loan")]
    cases = spark.createDataFrame([(c, "x", p) for c, p in pairs], "case_id string, country string, process_type string")
    amount, country = (lambda v: {"amount": (v, "float")}), (lambda v: {"country": (v, "string")})
    docs = documents(spark, [
        ("large", 1, "form", "request", amount("500.0")), ("large", 2, "passport", "identity", country("X")),
        ("small", 1, "form", "request", amount("50.0")), ("small", 2, "passport", "identity", country("X")),
        ("later", 1, "form", "request", amount("50.0")), ("later", 2, "form", "request", amount("500.0")), ("later", 3, "id_card", "identity", country("X")),
        ("card", 1, "form", "request", amount("50.0")),
        ("text", 1, "form", "request", {"amount": ("50", "string")}), ("text", 2, "passport", "identity", country("X")),
    ])
    waived = co.waived_by_anchors(co.anchor_records(cases, docs, cfg), cfg)
    # A card has no role "request" of its own; a text is no amount, so nothing is known and the requirement stands.
    assert {tuple(r) for r in waived.collect()} == {("small", "income"), ("later", "income")}
    got = {}
    for r in co.process_requirement_issues(cases, docs, cfg).orderBy("case_id", "pos", "issue_seq").collect():
        got.setdefault(r.case_id, []).append(r.issue)
    need = "Category 'income': need at least 1 of ['slip'], found 0"
    two = "Category 'income', type 'slip': need 2, found 0"
    assert got == {
        "large": [need, two],
        "later": ["Category 'request': max 1 accepted, found 2"],
        "bare": ["Category 'identity': need at least 1 of ['passport', 'id_card'], found 0", need, two, "Category 'request': need at least 1 of ['form'], found 0"],
        "card": ["Category 'income': need at least 5 of ['slip'], found 0"],
        "text": [need, two],
    }


def test_rules_of_the_process_are_asked_about(spark, tmp_path):
    cfg = configured(tmp_path)
    cases = spark.createDataFrame([("a", "x", "loan"), ("b", "x", "card")], "case_id string, country string, process_type string")
    docs = documents(spark, [(c, 1, "form", "request", {"amount": ("1.0", "float")}) for c in "ab"])
    (row,) = pr.cross_validation_prompts(cases, docs, cfg.validations, 1000).collect()
    assert row.case_id == "a" and "- names: names agree [fields: name; severity: error]\n- dates: dates agree" in row.prompt


def test_a_review_says_what_is_required(spark):
    base = default_config()
    rule = dict(country="germany", role=None, condition=None, temporal_constraints={}, pos=0, min_required=2, max_accepted=3)
    cfg = dataclasses.replace(base, requirements=[
        dict(rule, process_type="consumer_credit", category="income_proof", doc_types=["salary_slip"]),
        dict(rule, process_type="mortgage", category="identity", doc_types=["identity_document"]),
    ])
    cases = spark.createDataFrame([("a", "germany", "consumer_credit"), ("b", "germany", "mortgage")], "case_id string, country string, process_type string")
    rows = [(c, f"{c}{k}", k, "", "income_proof", f"{c}{k}.txt", "some text", "pending", "2024-01-01") for c in "ab" for k in range(2)]
    docs = spark.createDataFrame(rows, "case_id string, doc_id string, doc_seq long, doc_type string, category string, file_name string, text_content string, status string, upload_timestamp string")

    def says(reply):
        return partial(call_model, model_fn=lambda frame: [reply] * len(frame), keys=["case_id"])

    model = ModelSteps(
        classify=says('{"detected_type": "salary_slip", "confidence": 0.9, "alternative_types": [], "reasoning": "r"}'),
        extract=says('{"net_salary": 10.5, "pay_period": "2024-01"}'),
        conditions=says('{"status": "pass", "analyst_message": "ok", "details": {}}'),
        narrative=says("fine"),
    )
    review = review_cases(cases, docs, cfg, model, dt.date(2024, 5, 31))
    got = {(r.case_id, r.issue) for r in review.requirement_issues.collect()}
    assert got == {("b", "Category 'identity': need at least 2 of ['identity_document'], found 0")}


def test_a_case_without_a_process_takes_the_one_of_the_file(spark, tmp_path):
    cfg = configured(tmp_path)
    cases = spark.createDataFrame([("a", None, ""), ("b", "x", None), ("c", "y", "card")], "case_id string, country string, process_type string")
    assert cfg.default_process() is None  # three processes, none of them the package's own
    assert cfg.filled(cases).collect() == cases.collect()
    assert [tuple(r) for r in cfg.filled(cases, ("x", "loan")).collect()] == [("a", "x", "loan"), ("b", "x", "loan"), ("c", "y", "card")]
    one = dataclasses.replace(cfg, processes=cfg.processes[:1])
    assert [tuple(r) for r in one.filled(cases).collect()] == [("a", "x", "card"), ("b", "x", "card"), ("c", "y", "card")]
    assert default_config().default_process() == ("germany", "consumer_credit")
