"""Operators on hand-worked rows: boundaries, order, hot keys, retries."""

import dataclasses
import datetime as dt
import os
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry import scale
from casequarry.functions.values import RECORD
from casequarry.operators import conditions as cond
from casequarry.operators import crossdoc as cd
from casequarry.operators import model as mo
from casequarry.operators import report as rp
from casequarry.operators.classify import parse_classification
from casequarry.operators.guards import input_verdict, redact
from casequarry.operators.stepdata import merge_step_overrides
from casequarry.plans import inputs
from casequarry.sources.config import condition_row, default_config, load_config, load_requirements
from casequarry.sources.intake import attach_case, intake, read_uploads

CFG = default_config()
SF_DIR = "/root/testdata/sf0.001"


# Joins and lists under skew -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, some without a key."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 3000)
    return spark.range(30_000).select(k.alias("key"), F.col("id").alias("doc_seq"))


def test_lookup_equals_join(spark, skewed):
    table = spark.range(2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    assert [r.key for r in scale.hot_keys(skewed, ["key"]).collect()] == [7]
    for how in ("left", "inner"):
        got = scale.lookup(skewed, table, ["key"], how)
        want = skewed.join(table, "key", how).select("key", "doc_seq", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lookup_spreads_the_hot_key(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.range(2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        parts = scale.lookup(skewed, table, ["key"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in parts) < 30_000 / 8 * 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_keys_are_bounded(spark):
    rows = spark.range(100_000).select((F.col("id") % 5000).alias("key"))
    assert scale.hot_keys(rows, ["key"]).count() <= scale.HOT_SHARE


@pytest.mark.parametrize("limit", [10, 60, 10_000])
def test_bounded_text(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("aab"), i, "x" * rng.randint(1, 9)) for i in range(60)] + [("c", 5, "only")]
    df = spark.createDataFrame(rows, "k string, seq bigint, line string").repartition(5)
    got = {r.k: r for r in scale.bounded_text(df, ["k"], ["seq"], "line", limit).collect()}
    for key in "abc":
        text = "\n".join(line for k, _, line in sorted(rows, key=lambda r: r[1]) if k == key)
        assert got[key].chars == len(text)
        assert got[key].text == (text if len(text) <= limit else None)
        assert got[key].line_count == sum(k == key for k, _, _ in rows)


def test_settle_keeps_filters_above(spark):
    df = scale.settle(spark.range(10), x=F.upper(F.col("id").cast("string"))).where(F.col("x") > "5")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper") == 1


def test_cut_lineage_reads_a_written_table(spark):
    df = scale.cut_lineage(spark.range(5).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    assert scale.work_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_large_config_tables_are_not_broadcast(spark, monkeypatch):
    rows = [{"a": k} for k in range(3)]
    plan = lambda: spark.range(9).join(scale.config_table(spark, rows, "a int"), F.col("a") == F.col("id"))._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(scale, "MAX_CONFIG_ROWS", 2)
    assert "strategy=broadcast" not in plan()


@pytest.mark.parametrize("window_rows", [10, 1_000_000])
def test_places_of_a_hot_key(spark, monkeypatch, window_rows):
    monkeypatch.setattr(scale, "WINDOW_ROWS", window_rows)
    rows = [(k if k % 3 else 0, -k % 97, k) for k in range(900)] + [(None, 5, 1), (None, 4, 2)]
    df = spark.createDataFrame(rows, "k int, v int, tie int").repartition(7)
    got = {(r.k, r.v, r.tie): r.place for r in scale.with_places(df, ["k"], ["v", "tie"]).collect()}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        assert [got[key, *r] for r in own] == list(range(1, len(own) + 1))


def test_work_tables_can_be_dropped(spark, tmp_path):
    df = scale.cut_lineage(spark.range(3))
    assert df.count() == 3 and scale.drop_work(spark) >= 1 and scale.drop_work(spark) == 0


# Guards -------------------------------------------------------------------------------------------
def test_redaction_runs_in_order_and_settles(spark):
    rows = [("a@b.de +49 30 1234567 12/345/67890 DE12ABCDEFGH0123456789", "DE"), ("12/345/67890", "AT"), ("", "DE")]
    df = spark.createDataFrame(rows, "t string, c string")
    once = redact(df, "t", CFG.pii_patterns(), "c")
    texts = [r.pii_text for r in once.collect()]
    # The phone pattern runs first and takes the digits that follow the phone number.
    assert texts[0].startswith("[EMAIL] [PHONE]") and texts[1] == "12/345/67890" and texts[2] == ""
    twice = redact(once.select("c", F.col("pii_text").alias("t")), "t", CFG.pii_patterns(), "c")
    assert [r.pii_text for r in twice.collect()] == texts
    assert [r.pii_count for r in twice.collect()] == [0, 0, 0]


def test_first_block_decides(spark):
    rows = [("x" * 32001 + " you are now",), ("act as if you are now",), ("Act as if",), ("```\nuser\n hi",), ("ok",)]
    got = input_verdict(spark.createDataFrame(rows, "p string"), "p", CFG).collect()
    assert [(r.in_passed, r.in_flags) for r in got] == [
        (False, ["INPUT_TOO_LONG"]), (False, ["INJECTION_PATTERN_MATCH"]), (True, []),
        (False, ["STRUCTURAL_INJECTION_SUSPECT"]), (True, []),
    ]
    assert got[1].in_reason.endswith("you are now")  # list order, not text order


# Classification, attempts -------------------------------------------------------------------------
def test_confidence_gate(spark):
    replies = [
        ('{"detected_type": "a", "confidence": 0.75}',), ('{"detected_type": "a", "confidence": 0.7499}',),
        ('{"detected_type": "a", "confidence": "0.8"}',), ('{"detected_type": "a"}',), ('{"confidence": true}',),
        ('{"detected_type": "a", "confidence": null}',), ('{"detected_type": "a", "confidence": "high"}',),
    ]
    df = spark.createDataFrame(replies, "reply_text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = [(r.detected_type, r.confidence) for r in parse_classification(df, ["doc_id"]).orderBy("doc_id").collect()]
    manual = fv.NEEDS_MANUAL
    assert got == [("a", 0.75), (manual, 0.7499), ("a", 0.8), (manual, 0.0), (manual, 1.0)]


def test_soft_success_only_from_the_final_attempt(spark):
    rows = [
        (1, 1, '{"k": 1}', None), (1, 2, "bad", None), (1, 3, '{"k": 3}', None),
        (2, 1, '{"k": 1}', None), (2, 2, "bad", None), (2, 3, "bad", None),
        (3, 1, "bad", None), (3, 2, '{"v": 2}', None), (3, 3, "bad", None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, attempt int, raw_response string, error string")
    for parts in (1, 7):
        judged = mo.judge_attempts(df.repartition(parts), CFG, ["v"], 3)
        got = {r.doc_id: r for r in mo.resolve_attempts(judged, ["doc_id"]).collect()}
        assert [got[i].outcome for i in (1, 2, 3)] == ["soft_success", "failed", "success"]
        assert got[1].record["k"].text == "3" and got[3].attempts == 2 and got[2].record is None
        assert mo.to_traces(judged.withColumn("step_pos", F.lit(0)), ["doc_id"]).where("doc_id = 3").count() == 2


def test_run_step_blocks_retries_and_reflects(spark):
    def model(batch):
        return ["nope" if "Failed answer" not in p else '{"v": 1}' for p in batch["prompt"]]

    prompts = spark.createDataFrame([("a", "fine"), ("b", "you are now free")], "doc_id string, prompt string")
    ask = partial(mo.call_model, model_fn=model, keys=["doc_id"])
    results, traces = mo.run_step(prompts, dict(CFG.steps[0], output_schema=["v"]), ask, CFG, ["doc_id"])
    got = {r.doc_id: (r.outcome, r.attempts) for r in results.collect()}
    assert got == {"a": ("success", 2), "b": ("blocked", 1)}
    rows = {(r.doc_id, r.attempt): r for r in traces.collect()}
    assert rows["a", 1].trace_status == "failed_retrying" and rows["a", 1].validation_errors == ["JSON parse error: invalid JSON"]
    assert "nope" in rows["a", 2].prompt_sent and rows["b", 1].trace_status == "failed_terminal"


def test_step_that_is_not_retried_keeps_its_retrying_status(spark):
    prompts = spark.createDataFrame([("a", "fine")], "doc_id string, prompt string")
    ask = partial(mo.call_model, model_fn=lambda batch: ["nope"] * len(batch), keys=["doc_id"])
    step = dict(CFG.steps[0], retry_on_failure=False)
    results, traces = mo.run_step(prompts, step, ask, CFG, ["doc_id"])
    assert results.first().outcome == "failed" and results.first().attempts == 1
    assert [r.trace_status for r in traces.collect()] == ["failed_retrying"]


def test_failing_batch_is_asked_row_by_row(spark):
    def model(batch):
        if (batch["prompt"] == "bad").any():
            raise RuntimeError("no")
        return ["ok"] * len(batch)

    prompts = spark.createDataFrame([(i, "bad" if i == 3 else "good") for i in range(8)], "doc_id int, prompt string").coalesce(1)
    got = {r.doc_id: (r.raw_response, r.error) for r in mo.call_model(prompts, model, ["doc_id"]).collect()}
    assert got[3] == (None, "no") and all(got[i] == ("ok", None) for i in got if i != 3)


def test_repeated_override_keeps_its_place(spark):
    rows = [(1, 1, "a", "t", {"x": "1"}), (1, 2, "b", "t", {"x": "2", "y": "2"}), (1, 3, "a", "t", {"x": "3", "z": "3"}), (1, 4, "c", "u", {"x": "9"})]
    df = spark.createDataFrame(rows, "run int, seq int, from_step string, target_step string, settings map<string,string>")
    got = {r.setting: r.value for r in merge_step_overrides(df, ["run"], "t").collect()}
    assert got == {"x": "2", "y": "2", "z": "3"}


# Conditions ---------------------------------------------------------------------------------------
def _documents(spark, rows):
    """rows: (doc_id, doc_type, field, text, kind)."""
    cells = [(d, t, {f: (x, k)} if f else {}) for d, t, f, x, k in rows]
    df = spark.createDataFrame(cells, f"doc_id string, doc_type string, extracted_data {RECORD}")
    return df.withColumns(
        {"case_id": F.lit("c"), "doc_seq": F.monotonically_increasing_id(), "country": F.lit("germany"), "process_type": F.lit("consumer_credit")}
    )


def test_date_boundaries(spark):
    rows = [
        ("edge", "salary_slip", "pay_period", "2024-02-29", "string"), ("old", "salary_slip", "pay_period", "2024-02-28", "string"),
        ("future", "salary_slip", "pay_period", "2030-01", "string"), ("today", "identity_document", "expiry_date", "31.05.2024", "string"),
        ("yesterday", "identity_document", "expiry_date", "30.05.2024", "string"), ("empty", "identity_document", "expiry_date", "", "string"),
    ]
    got = {r.doc_id: (r.status, r.severity) for r in cond.deterministic_results(_documents(spark, rows), CFG, dt.date(2024, 5, 31)).collect()}
    assert got == {
        "edge": ("pass", "info"), "old": ("needs_review", "warning"), "future": ("pass", "info"), "today": ("pass", "info"),
        "yesterday": ("fail", "error"), "empty": ("needs_review", "error"),
    }


def test_text_comparison_uses_python_text(spark):
    row = dict(
        country="germany", process_type="consumer_credit", condition_seq=0, condition_name="c", description="", applies_to=[],
        check_type="deterministic", field="f", operator="equals", sources=None, llm_logic=None, on_fail="fail", severity="error", analyst_message="",
    )
    docs = _documents(spark, [("t", "x", "f", "True", "bool"), ("s", "x", "f", "true", "string"), ("n", "x", "f", "1.0", "float")])
    for value, passing in [(True, {"t"}), ("true", {"s"}), (1.0, {"n"}), (1, set()), (None, set())]:
        cfg = dataclasses.replace(CFG, conditions=[condition_row(**row, value=value)])
        got = cond.deterministic_results(docs, cfg, inputs.AS_OF).where("status = 'pass'").collect()
        assert {r.doc_id for r in got} == passing


def test_negative_mean_is_measured_against_one(spark):
    df = spark.createDataFrame([(1, -2.0), (1, -4.0), (2, 5.0), (3, 100.0), (3, 120.0), (3, None)], "k int, v double")
    summary, outliers = cd.numeric_consistency(df, ["k"], "v")
    got = {r.k: (r.is_consistent, r.average, r.outlier_count, r.value_count) for r in summary.collect()}
    assert got == {1: (False, -3.0, 2, 2), 2: (True, None, 0, 1), 3: (True, 110.0, 0, 2)}
    assert {r.deviation_percent for r in outliers.collect()} == {100.0}


# Reports ------------------------------------------------------------------------------------------
def test_lists_of_a_case_with_time_stamps_as_positions(spark):
    """Positions far apart, and one case with a third of all documents: one report each, lists whole and in order."""
    cases, docs = inputs.home_cases(spark, SF_DIR), inputs.home_documents(spark, SF_DIR)
    first = cases.orderBy("case_id").first().case_id
    moved = F.when(F.col("doc_seq") % 3 == 0, first).otherwise(F.col("case_id"))
    docs = docs.withColumn("case_id", moved).withColumn("doc_seq", 1_700_000_000_000_000 + F.col("doc_seq") * 1_000_000)
    docs = docs.join(cases.select("case_id"), "case_id", "left_semi")
    classes = docs.select("case_id", "doc_id", "doc_seq", F.lit(fv.NEEDS_MANUAL).alias("detected_type"), F.lit(0.1).alias("confidence"), F.lit(False).alias("manually_overridden"))
    results = cond.deterministic_results(docs, CFG, inputs.AS_OF).cache()
    tables = rp.report_tables(cases, docs, classes, results)
    reports = {r.case_id: r for r in tables.reports.collect()}
    assert len(reports) == tables.reports.count() == cases.count()
    own = [r for r in results.collect() if r.case_id == first and r.status != "pass"]
    assert reports[first].n_flagged == len(own) > 100 and reports[first].n_documents == docs.where(F.col("case_id") == first).count()
    rank = {"error": 0, "warning": 1, "info": 2}
    want = [r.doc_id for r in sorted(own, key=lambda r: (rank[r.severity], r.condition_seq, r.type_pos, r.doc_seq))]
    placed = rp.placed_issues(results).where(F.col("case_id") == first).orderBy("place").collect()
    assert [r.doc_id for r in placed] == want and [r.place for r in placed] == list(range(1, len(want) + 1))
    names = tables.recommendations.where((F.col("case_id") == first) & (F.col("kind") == "unclassified")).orderBy("place")
    assert [r.name for r in names.collect()] == [r.doc_id for r in docs.where(F.col("case_id") == first).orderBy("doc_seq").collect()]
    assert tables.document_inventory.count() == docs.count()


def test_case_without_anything_gets_a_clear_report(spark):
    cases = inputs.home_cases(spark, SF_DIR).limit(1)
    none = inputs.home_documents(spark, SF_DIR).where("false")
    results = cond.deterministic_results(none, CFG, inputs.AS_OF)
    classes = inputs.classifications(spark, SF_DIR).where("false")
    row = rp.build_reports(cases, none, classes, results).first()
    assert row.case_status == "ready_for_review" and row.n_documents == 0
    assert row.narrative_summary.startswith("Automated review complete. 0 conditions checked")
    advice = rp.recommendations(cases, none, classes, results)
    assert [(r.kind, r.message) for r in advice.collect()] == [("all_clear", fv.MSG_ALL_CLEAR)]
    assert [r.line for r in rp.advice_lines(advice, 100).collect()] == [fv.MSG_ALL_CLEAR]


def test_fail_with_warning_is_flagged_but_not_blocking(spark):
    cases = spark.createDataFrame([("c", "germany", "p")], "case_id string, country string, process_type string")
    row = spark.createDataFrame([("c", "fail", "warning")], "case_id string, status string, severity string")
    flags = rp.attention_flags(cases, row).first()
    assert (flags.blocking, flags.needs_review) == (False, False) and rp.flagged_issues(row).count() == 1


# Sources ------------------------------------------------------------------------------------------
def test_uploads_become_documents(spark, tmp_path):
    for case, name, content in [("c1", "a.txt", b"ok"), ("c1", "b.txt", b"bad \xff byte"), ("c2", "a.txt", "ü".encode())]:
        (tmp_path / case).mkdir(exist_ok=True)
        (tmp_path / case / name).write_bytes(content)
        os.utime(tmp_path / case / name, (1_700_000_000, 1_700_000_000))  # a bulk upload: one time for all
    rows = intake(read_uploads(spark, str(tmp_path))).collect()
    got = {(r.case_id, r.file_name): (r.text_content, r.doc_seq) for r in rows}
    assert got == {("c1", "a.txt"): ("ok", 1), ("c1", "b.txt"): ("bad � byte", 2), ("c2", "a.txt"): ("ü", 1)}


def test_configuration_folder(tmp_path):
    land = tmp_path / "countries" / "x"
    for part in ("doc_types", "conditions", "process"):
        (land / part).mkdir(parents=True)
    for part in ("guardrails", "pipelines"):
        (tmp_path / part).mkdir()
    (land / "classification.yaml").write_text("country: XX\ndocument_types:\n  - {name: a, description: A, key_indicators: [p, q]}\n")
    (land / "doc_types" / "a.yaml").write_text("country: XX\nfields:\n  - {name: f, type: float, required: true}\nrules:\n  - {condition: f > 1, action: look}\n")
    (land / "conditions" / "one.yaml").write_text(
        "conditions:\n  - {name: n, description: d, logic: {field: f, operator: within_months, value: x}, analyst_message: 'm {f} {g}'}\n"
    )
    (land / "process" / "p.yaml").write_text("condition_files: [one, missing]\nrequired_categories:\n  - {category: k, doc_types: [a]}\n")
    (tmp_path / "pipelines" / "s.yaml").write_text("name: s\nsteps:\n  - name: first\n")
    (tmp_path / "guardrails" / "pii_patterns.yaml").write_text("global:\n  - {name: e, pattern: 'x', replacement: 'y'}\n")
    cfg = load_config(tmp_path, extra_processes={"x": ["other"]})
    assert cfg.countries == {"x": "XX"} and cfg.fields[0]["required"] and cfg.rules[0]["severity"] == "info"
    first, second = cfg.conditions
    assert (first["process_type"], second["process_type"]) == ("p", "other")
    assert first["months"] is None and "invalid literal" in first["months_error"] and first["value_message"] is None
    assert cfg.categories[0]["max_accepted"] == 999 and cfg.steps[0]["max_retries"] == 3
    assert cfg.pii[0]["sensitivity"] == "medium" and cfg.guards["input_guards"]["max_prompt_length"] == 32000


def test_prompts_of_successes_can_be_left_out(spark):
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad")], "doc_id string, prompt string")
    ask = partial(mo.call_model, model_fn=lambda batch: ['{"v": 1}' if p == "good" else "no" for p in batch["prompt"]], keys=["doc_id"])
    step = dict(CFG.steps[0], max_retries=2, use_reflection=False)
    for keep, sent in [(True, {("a", 1, "good"), ("b", 1, "bad"), ("b", 2, "bad")}), (False, {("a", 1, None), ("b", 1, "bad"), ("b", 2, "bad")})]:
        _, traces = mo.run_step(prompts, step, ask, CFG, ["doc_id"], keep_prompts=keep)
        assert {(r.doc_id, r.attempt, r.prompt_sent) for r in traces.collect()} == sent


def test_documents_that_know_their_case_are_not_joined(spark):
    docs = inputs.home_documents(spark, SF_DIR).drop("country_code")
    plan = attach_case(docs, inputs.cases(spark, SF_DIR), CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer" not in plan and "c_custkey" not in plan


def test_requirements_file(tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text(
        "document_requirements:\n  k:\n    doc_types: [a, b]\n    min_required: 1\n    max_accepted: 2\n    role: main\n"
        "    temporal_constraints: {a: {min_count: 2}, b: {}}\n"
    )
    (row,) = load_requirements(path)
    assert row["category"] == "k" and row["temporal_constraints"] == {"a": 2, "b": 1} and row["condition"] is None
    assert load_requirements(tmp_path / "missing.yaml") == []


def test_too_long_sources_are_counted_not_collected(spark):
    fields = [(f"d{i}", "salary_slip", "employee_name", "x" * 500, "string") for i in range(100)]
    docs = _documents(spark, fields)
    cases = spark.createDataFrame([("c", "germany", "consumer_credit")], "case_id string, country string, process_type string")
    ask = partial(mo.call_model, model_fn=lambda batch: ["never asked"] * len(batch), keys=["case_id"])
    rows = {r.condition_name: r for r in cond.check_with_model(cases, docs, CFG, ask).collect()}
    blocked = rows["income_consistency"].analyst_message
    assert blocked.startswith("Prompt blocked by guardrails: Prompt exceeds max length (") and blocked.endswith(" > 32000)")
    gathered = cond.gather_sources(docs, CFG, 10**6).first()
    limited = cond.gather_sources(docs, CFG, 32000).first()
    assert limited.source_blocks is None and limited.source_chars == gathered.source_chars == len("\n".join(gathered.source_blocks))
    assert rows["applicant_name_consistency"].analyst_message == fv.MSG_NO_SOURCES
