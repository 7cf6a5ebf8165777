"""Faults a review must live with: models, rules, messages and records that misbehave."""

import dataclasses
import datetime as dt
from functools import partial

import pytest
from pyspark.sql import functions as F

from casequarry import scale
from casequarry.functions.text import unicode_space
from casequarry.functions.values import RECORD
from casequarry.operators import conditions as cond
from casequarry.operators import crossdoc as cd
from casequarry.operators import model as mo
from casequarry.operators import narrative
from casequarry.operators.completeness import requirement_applies
from casequarry.operators.guards import redact
from casequarry.operators.stepdata import extraction_status
from casequarry.operators.validate import triggered_rules
from casequarry.sources.config import condition_row, default_config, load_config

CFG = default_config()
STEP = dict(CFG.steps[0], max_retries=2, use_reflection=False, output_schema=None)


def guarded(action):
    """The default configuration with replies searched for personal data."""
    return dataclasses.replace(CFG, guards=dict(CFG.guards, pii={"scan_input": False, "scan_output": True, "action": action}))


def test_an_error_without_a_text_is_no_success(spark):
    def model(batch):
        raise TimeoutError

    prompts = spark.createDataFrame([("a", "fine")], "doc_id string, prompt string")
    results, traces = mo.run_step(prompts, STEP, partial(mo.call_model, model_fn=model, keys=["doc_id"]), CFG, ["doc_id"])
    assert [(r.outcome, r.attempts, r.record) for r in results.collect()] == [("model_error", 2, None)]
    assert [r.trace_status for r in traces.orderBy("attempt").collect()] == ["failed_retrying", "failed_terminal"]


def test_a_batch_is_halved_and_wrong_numbers_of_replies_are_errors(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(batch):
        asked.add(1)
        if (batch["prompt"] == "bad").any():
            raise RuntimeError("no")
        return ["ok"] * (len(batch) - (batch["prompt"] == "short").any())

    prompts = spark.createDataFrame([(k, {3: "bad", 40: "short"}.get(k, "good")) for k in range(64)], "doc_id int, prompt string").coalesce(1)
    got = {r.doc_id: (r.raw_response, r.error) for r in mo.call_model(prompts, model, ["doc_id"]).collect()}
    assert got.pop(3) == (None, "no") and got.pop(40) == (None, "0 replies to 1 prompts")
    assert set(got.values()) == {("ok", None)} and asked.value <= 1 + 4 * 6


def test_temperature_and_backend_of_a_step_reach_the_model(spark):
    def model(batch):
        return [f'{{"t": {t}, "b": "{b}"}}' for t, b in zip(batch["temperature"], batch["backend_key"], strict=True)]

    ask = partial(mo.call_model, model_fn=model, keys=["doc_id"])
    prompts = spark.createDataFrame([("a", "fine")], "doc_id string, prompt string")
    results, _ = mo.run_step(prompts, dict(STEP, temperature=0.7, backend_key="other"), ask, CFG, ["doc_id"])
    record = results.first().record
    assert (record["t"].text, record["b"].text) == ("0.7", "other")


def test_narratives_are_asked_at_their_own_temperature(spark):
    cases = spark.createDataFrame([("c", "germany", "consumer_credit")], "case_id string, country string, process_type string")
    docs = spark.createDataFrame([], f"case_id string, doc_id string, doc_seq long, file_name string, classified_as string, classification_confidence double, extracted_data {RECORD}")
    results = cond.deterministic_results(_documents(spark, []), CFG, dt.date(2024, 5, 31))
    ask = partial(mo.call_model, model_fn=lambda b: [str(t) for t in b["temperature"]], keys=["case_id"])
    assert narrative.narratives(cases, docs, results, CFG, ask).first().narrative_summary == "0.2"


def test_a_pipeline_that_does_not_exist_skips_extraction(spark):
    docs = spark.createDataFrame([("a", "germany", "salary_slip", "text", "classified")], "doc_id string, country string, doc_type string, text_content string, status string")
    done, results, traces = mo.run_steps(docs, CFG.steps_of("no such pipeline"), lambda p: p, CFG)
    assert [(r.doc_id, r.status, r.extracted_data) for r in done.collect()] == [("a", "classified", {})]
    assert results.count() == traces.count() == 0


@pytest.mark.parametrize("action", ["redact", "block"])
def test_patterns_of_a_country_inside_the_steps(spark, action):
    reply = '{"iban": "DE12ABCDEFGH0123456789", "mail": "a@b.de"}'
    ask = partial(mo.call_model, model_fn=lambda b: [reply] * len(b), keys=["doc_id"])
    columns = "doc_id string, country string, country_code string, doc_type string, text_content string"
    docs = spark.createDataFrame([("d", "germany", "DE", "salary_slip", "t"), ("a", "germany", "AT", "salary_slip", "t")], columns)
    cfg = guarded(action)
    step = dict(CFG.steps[0], output_schema=None, max_retries=1)
    _, results, traces = mo.run_steps(docs, [step], ask, cfg)
    flags = {r.doc_id: set(r.guardrail_flags) for r in traces.collect()}
    records = {r.doc_id: r.record for r in results.collect()}
    if action == "redact":
        assert "DE12" not in records["d"]["iban"].text and "DE12" in records["a"]["iban"].text
    assert "PII_IBAN_DE_DETECTED" in flags["d"] and "PII_IBAN_DE_DETECTED" not in flags["a"]


def test_patterns_of_a_country_need_its_code(spark):
    with pytest.raises(ValueError, match="country_code"):
        redact(spark.createDataFrame([("x",)], "t string"), "t", CFG.pii_patterns())


def test_configured_patterns_know_umlauts_and_groups(spark):
    df = spark.createDataFrame([("Müller", "DE")], "t string, country_code string")
    assert df.select(F.col("t").rlike(unicode_space(r"^\w+$"))).first()[0]
    pattern = dict(scope="global", pos=0, name="n", pattern=r"(\w)\w+(\w)", replacement=r"\2$-\g<1>", sensitivity="low")
    assert redact(df, "t", [pattern]).first().pii_text == "r$-M"


def _documents(spark, rows):
    cells = [(d, t, {k: v for k, v in fields.items()}) for d, t, fields in rows]
    df = spark.createDataFrame(cells, f"doc_id string, doc_type string, extracted_data {RECORD}")
    return df.withColumns({"case_id": F.lit("c"), "doc_seq": F.monotonically_increasing_id(), "country": F.lit("germany"), "process_type": F.lit("consumer_credit")})


def test_rules_that_cannot_be_evaluated_are_skipped(spark):
    doc_type = "bank_statement"
    names = ["opening_balance", "closing_balance", "iban"]
    fields = [dict(CFG.fields[0], country="germany", doc_type=doc_type, pos=k, name=n, type="string" if n == "iban" else "float", pattern=None) for k, n in enumerate(names)]
    conditions = ["closing_balance / opening_balance > 2", "iban > 5", "closing_balance > 1"]
    rules = [dict(CFG.rules[0], country="germany", doc_type=doc_type, pos=k, condition=c, action=f"r{k}", severity="info") for k, c in enumerate(conditions)]
    cfg = dataclasses.replace(CFG, fields=fields, rules=rules)
    number = lambda x: (x, "float")
    docs = _documents(spark, [
        ("zero", doc_type, {"opening_balance": number("0.0"), "closing_balance": number("9.0"), "iban": ("7", "string")}),
        ("fine", doc_type, {"opening_balance": number("2.0"), "closing_balance": number("9.0"), "iban": ("DE", "string")}),
    ])
    got = {r.doc_id: r.triggered for r in triggered_rules(docs, cfg).collect()}
    assert got == {"zero": ["r2 (severity: info)"], "fine": ["r0 (severity: info)", "r2 (severity: info)"]}


def test_requirement_conditions_that_cannot_be_evaluated_are_true(spark):
    anchors = spark.createDataFrame([("z", 0, 6, "a"), ("n", 2, 2, "b")], "case_id string, x int, y int, word string")
    wanted = [{"category": c, "condition": e} for c, e in (("div", "y / x > 2"), ("mixed", "word > 5"), ("none", "nowhere > 1"), ("plain", "y > 3"))]
    got = {(r.case_id, r.category) for r in requirement_applies(anchors, wanted).collect()}
    assert got == {("n", "div"), ("n", "plain")}


def test_messages_with_a_number_format(spark):
    row = dict(
        country="germany", process_type="consumer_credit", condition_seq=0, condition_name="c", description="", applies_to=[], check_type="deterministic",
        field="f", operator="greater_than", sources=None, llm_logic=None, on_fail="fail", severity="error",
    )
    docs = _documents(spark, [("a", "x", {"f": ("1234.567", "float")}), ("b", "x", {"f": ("abc", "string")}), ("c", "x", {})])
    said = lambda template: {
        r.doc_id: r.analyst_message
        for r in cond.deterministic_results(docs, dataclasses.replace(CFG, conditions=[condition_row(**row, value=9999, analyst_message=template)]), dt.date(2024, 5, 31)).collect()
    }
    assert said("is {f:.2f} now") == {"a": "is 1234.57 now", "b": "is {f:.2f} now", "c": "Field 'f' not found in c"}
    assert said("is {f:,.1f}")["a"] == "is 1,234.6" and said("is {f}, {f.x}")["a"] == "is {f}, {f.x}"
    assert said("is {f}") == {"a": "is 1234.567", "b": "is abc", "c": "is MISSING"}


def test_a_skipped_source_document_is_still_shown(spark):
    eligible = spark.createDataFrame([("s", "c", "unclassified")], "doc_id string, case_id string, skip_reason string")
    extracted = spark.createDataFrame([], f"doc_id string, status string, extracted_data {RECORD}")
    row = extraction_status(eligible, extracted).first()
    assert (row.status, row.extracted_data) == ("skipped", {})


@pytest.mark.parametrize("limit", [10, 37, 100_000])
def test_long_lists_of_lines_come_in_parts(spark, limit):
    rows = [("a" if k % 3 else "b", k, "x" * (k * 7 % 23) + str(k)) for k in range(90)] + [("c", 1, "y" * 60), ("c", 2, "z")]
    df = spark.createDataFrame(rows, "k string, seq long, line string").repartition(5)
    parts = scale.text_parts(df, ["k"], ["seq"], "line", limit).orderBy("part").collect()
    for key in "abc":
        own = [r.text for r in parts if r.k == key]
        want = [line for k, _, line in sorted(rows, key=lambda r: r[1]) if k == key]
        assert sorted(line for text in own for line in text.split("\n")) == sorted(want)
        assert all(len(text) <= limit or "\n" not in text for text in own)
        if limit == 100_000:
            assert own == ["\n".join(want)]


def test_any_two_lines_meet_in_a_text(spark):
    """Cases of 1 to 40 blocks; key k has about k half texts."""
    rows = [(str(k), n, f"{k}/{n} " + "x" * (n * 13 % 40)) for k in range(1, 41) for n in range(k * 3)]
    rows += [("long", n, f"long/{n} " + "y" * (400 if n % 5 == 2 else 10)) for n in range(12)] + [("one", 0, "z" * 900)]
    df = spark.createDataFrame(rows, "k string, seq long, line string").repartition(7)
    texts = {}
    for r in scale.paired_parts(df, ["k"], ["seq"], "line", 300).collect():
        texts.setdefault(r.k, {})[r.part] = r.text.split("\n")
    lines, place = {}, {line: n for _, n, line in rows}
    for k, _, line in rows:
        lines.setdefault(k, []).append(line)
    assert set(texts) == set(lines)
    most = 0
    for k, own in lines.items():
        parts = texts[k]
        assert sorted(parts) == list(range(len(parts)))
        assert {x for text in parts.values() for x in text} == set(own)
        met = {(a, b) for text in parts.values() for a in text for b in text}
        assert met == {(a, b) for a in own for b in own}, k
        assert all(text == sorted(text, key=place.get) for text in parts.values())
        if k not in ("long", "one"):
            assert all(len("\n".join(text)) <= 300 for text in parts.values())
            most = max(most, len(parts))
        if len("\n".join(own)) <= 300:
            assert parts == {0: own}
    assert most >= 40 * 39 / 2 / 4


def test_merged_replies_of_several_prompts(spark):
    ok = '{"validations": [{"rule_name": "salary", "passed": true, "details": "fine", "severity": "info"}, {"passed": false}]}'
    bad = '{"validations": [{"passed": true}, {"rule_name": "salary", "passed": false, "details": "differs", "severity": "error"}]}'
    rows = [("a", 0, ok), ("a", 1, bad), ("a", 2, "no JSON"), ("b", 0, ok), ("c", 0, '{"validations": [{"rule_name": "salary"}]}')]
    df = spark.createDataFrame(rows, "case_id string, part long, raw_response string")
    got = {(r.case_id, r.rule_name, r.passed, r.details, r.severity) for r in cd.parse_cross_validation(df).where("rule_name = 'salary'").collect()}
    assert got == {("a", "salary", False, "differs", "error"), ("b", "salary", True, "fine", "info"), ("c", "salary", None, None, None)}
    assert cd.parse_cross_validation(df).where("rule_name IS NULL").count() == 3
    single = cd.parse_cross_validation(df.drop("part").where("case_id = 'b'")).orderBy("pos").collect()
    assert [(r.pos, r.rule_name) for r in single] == [(0, "salary"), (1, None)]


def test_a_case_of_several_prompts_is_asked_in_full(spark):
    docs = _documents(spark, [(f"d{k}", "salary_slip", {"employee_name": ("x" * 50 + str(k), "string")}) for k in range(12)])
    docs = docs.withColumn("status", F.lit("extracted"))

    def model(batch):
        replies = []
        for p in batch["prompt"]:
            risk = "high" if "x11" in p else "low"
            found = "true" if "x5\"" in p else "false"
            replies.append(f'{{"contradictions_found": {found}, "contradictions": [{{"type": "t{p.count("salary_slip.")}"}}], "overall_risk_assessment": "{risk}", "recommendation": "r_{risk}"}}')
        return replies

    ask = partial(mo.call_model, model_fn=model, keys=["case_id"])
    per_case, items = cd.contradictions(docs, ask, max_chars=300)
    row = per_case.first()
    assert (row.contradictions_found, row.overall_risk_assessment, row.recommendation, row.error) == (True, "high", "r_high", None)
    # Any two of the 12 documents are together in a prompt, so each is in several.
    seen = [int(r.type[1:]) for r in items.collect()]
    assert sum(n * (n - 1) // 2 for n in seen) >= 12 * 11 // 2 and len(seen) > 2
    bad = partial(mo.call_model, model_fn=lambda b: [None if "x11" in p else model(b[b["prompt"] == p])[0] for p in b["prompt"]], keys=["case_id"])
    assert cd.contradictions(docs, bad, max_chars=300)[0].first().recommendation == "flag_for_review"
    values = docs.select("case_id", F.lit("f").alias("field"), "doc_seq", F.col("doc_id").alias("source"), F.lit("v" * 40).alias("value"))
    same = partial(mo.call_model, model_fn=lambda b: ['{"is_consistent": true, "canonical_value": "v", "confidence": 0.5}'] * len(b), keys=["case_id"])
    got = cd.semantic_consistency(values, same, max_chars=100).first()
    assert (got.is_consistent, got.canonical_value, got.confidence) == (True, "v", 0.5)


def test_each_process_has_its_own_pipeline(spark, tmp_path):
    land = tmp_path / "countries" / "x" / "process"
    land.mkdir(parents=True)
    (tmp_path / "pipelines").mkdir()
    for name in ("one", "two"):
        (tmp_path / "pipelines" / f"{name}.yaml").write_text(f"name: p_{name}\nsteps:\n  - {{name: step_{name}, temperature: 0.{len(name)}}}\n")
        (land / f"{name}.yaml").write_text(f"pipeline_config: configs/pipelines/{name}.yaml\nbusiness_unit: u\n")
    (land / "three.yaml").write_text("pipeline_config: configs/pipelines/gone.yaml\n")
    cfg = load_config(tmp_path)
    assert {p["process_type"]: p["pipeline"] for p in cfg.processes} == {"one": "p_one", "two": "p_two", "three": "gone"}
    cases = spark.createDataFrame([("x", p) for p in ("one", "two", "three", "four")], "c string, p string")
    got = {r.p: r.name for r in cases.select("p", cfg.pipeline_of(F.col("c"), F.col("p")).alias("name")).collect()}
    assert got == {"one": "p_one", "two": "p_two", "three": "gone", "four": "single_doc_extraction"}
    (land.parent / "conditions").mkdir()
    (land.parent / "conditions" / "c.yaml").write_text("conditions:\n  - {name: n, description: d, logic: {field: f, operator: equals, value: 1}}\n")
    wide = load_config(tmp_path).covering(cases.withColumnsRenamed({"c": "country", "p": "process_type"}))
    assert [(c["process_type"], c["condition_name"]) for c in wide.conditions] == [("four", "n")]
    assert cfg.steps_of("gone") == [] and [s["name"] for s in cfg.steps_of("p_two")] == ["step_two"]
