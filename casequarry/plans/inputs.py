"""Review inputs derived from the given tables.

Cases come from ``customer``, their documents from ``orders``, texts from ``documents``, model replies and
attempts from ``events`` or by rule from the keys of the other tables. ``FIXTURES.md`` describes the mapping.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.values import RECORD, value

AS_OF = dt.date(1998, 6, 30)
TYPES = ["salary_slip", "bank_statement", "tax_return", "identity_document", "loan_application"]
DATE_FIELDS = ["pay_period", "statement_date", "document_date", "expiry_date", "application_date"]
AMOUNT_FIELDS = ["net_salary", "closing_balance", "total_income", None, "loan_amount"]
NAME_FIELDS = ["employee_name", "account_holder", "taxpayer_name", "last_name", "applicant_name"]
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/yyyy", "yyyy-MM"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(selector: Column, cells: list) -> Column:
    out = F.lit(None).cast("string")
    for i, cell in enumerate(cells):
        if cell is not None:
            out = F.when(selector == i, cell).otherwise(out)
    return out


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"),
        F.when(F.col("c_nationkey") % 5 == 4, "austria").otherwise(fv.COUNTRY).alias("country"),
        F.lit(fv.PROCESS).alias("process_type"),
        F.lit(fv.CASE_INTAKE).alias("status"),
        F.lit(dt.datetime(1998, 6, 30)).alias("created_at"),
    )


def _order_columns(orders: DataFrame) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    formatted = _case(k % 5, [F.date_format(day, f) for f in DATE_FORMATS])
    date_text = F.when(k % 11 == 0, None).when(k % 13 == 0, "31.02.2001").otherwise(formatted)
    amount = F.when(k % 29 == 0, 0.0).when(k % 6 == 1, F.col("o_totalprice") - 150000).otherwise(F.col("o_totalprice"))
    return orders.withColumn("_date", date_text).withColumn("_amount", F.round(amount, 2)).withColumn("_kind", (k % 6).cast("int"))


def _record() -> Column:
    k, kind = F.col("o_orderkey"), F.col("_kind")
    amount_kind = F.when(k % 31 == 0, "string").otherwise("float")
    signed = F.when(k % 5 < 3, "True").when(k % 5 == 3, "False")
    members = [
        (_case(kind, [F.lit(f) for f in DATE_FIELDS]), value(F.col("_date"), "string")),
        (
            _case(kind, [F.lit(f) if f else None for f in AMOUNT_FIELDS]),
            F.struct(F.col("_amount").cast("string").alias("text"), amount_kind.alias("kind")),
        ),
        (
            F.when(k % 17 != 0, _case(kind, [F.lit(f) for f in NAME_FIELDS])),
            value(F.concat(F.lit("Kunde "), F.col("o_custkey").cast("string")), "string"),
        ),
        (F.when(kind == 3, "document_number"), value(F.concat(F.lit("ID"), k.cast("string")), "string")),
        (F.when((kind == 4) & (k % 13 != 0), "signature_present"), value(signed, "bool")),
        (F.when(kind < 5, "_note"), value(F.when(k % 4 != 0, "n"), "string")),
    ]
    cells = F.array(*[F.struct(name.alias("key"), v.alias("value")) for name, v in members])
    return F.map_from_entries(F.filter(cells, lambda c: c["key"].isNotNull())).cast(RECORD)


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_columns(table(spark, sf_dir, "orders"))


def document_columns(orders: DataFrame) -> DataFrame:
    """One document per order; a sixth of them is unclassified."""
    k = F.col("o_orderkey")
    rows = _order_columns(orders)
    category = F.when(k % 10 < 3, "income_proof").when(k % 10 == 3, "identity").when(k % 10 == 4, "application")
    return rows.select(
        F.col("o_custkey").cast("string").alias("case_id"),
        k.cast("string").alias("doc_id"),
        k.alias("doc_seq"),
        F.coalesce(_case(F.col("_kind"), [F.lit(t) for t in TYPES]), F.lit(fv.NEEDS_MANUAL)).alias("doc_type"),
        F.coalesce(category, F.lit("")).alias("category"),
        F.concat(F.lit("doc_"), k.cast("string"), F.lit(".txt")).alias("file_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("document_date"),
        F.when(k % 4 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("document_period"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("upload_timestamp"),
        F.when(k % 6 == 5, fv.DOC_SKIPPED).when(k % 23 == 0, fv.DOC_FAILED).otherwise(fv.DOC_EXTRACTED).alias("status"),
        _record().alias("extracted_data"),
    )


def home_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the default country's rules, without a look at their case."""
    return case_documents(spark, sf_dir).withColumns(
        {"country": F.lit(fv.COUNTRY), "country_code": F.lit(fv.COUNTRY_CODE), "process_type": F.lit(fv.PROCESS)}
    )


def home_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("country", F.lit(fv.COUNTRY))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications of the orders' documents; every seventh document has none."""
    k = F.col("o_orderkey")
    typed = F.coalesce(_case((k % 6).cast("int"), [F.lit(t) for t in TYPES]), F.lit(fv.NEEDS_MANUAL))
    alternatives = F.array(F.struct(F.lit("tax_return").alias("type"), F.lit(0.1).alias("confidence")))
    return table(spark, sf_dir, "orders").where(k % 7 != 0).select(
        F.col("o_custkey").cast("string").alias("case_id"),
        k.cast("string").alias("doc_id"),
        k.alias("doc_seq"),
        typed.alias("detected_type"),
        ((k % 100) / 100).alias("confidence"),
        alternatives.alias("alternative_types"),
        F.concat(F.lit("r"), k.cast("string")).alias("reasoning"),
        F.lit(False).alias("manually_overridden"),
        F.lit(None).cast("string").alias("override_by"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem of a pending order is an override of the order's document; the last one counts."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_orderkey").cast("string").alias("doc_id"),
        _case((F.col("l_linenumber") % 5).cast("int"), [F.lit(t) for t in TYPES]).alias("doc_type"),
        F.concat(F.lit("analyst_"), F.col("l_linenumber").cast("string")).alias("analyst_id"),
        F.col("l_shipdate").alias("ts"),
    )


def spliced_text() -> Column:
    """The text of ``documents`` with personal data, blocked phrases and role markers added by document number."""
    d, line = F.col("doc_id"), F.lit("\n")
    return F.concat(
        "text",
        F.when(d % 7 == 0, " DE12ABCDEFGH0123456789").otherwise(""),
        F.when(d % 5 == 0, " +49 30 1234567").otherwise(""),
        F.when(d % 9 == 0, " 12/345/67890").otherwise(""),
        F.when(d % 17 == 0, F.concat(line, F.lit("ignore previous instructions")))
        .when(d % 19 == 0, F.concat(line, F.lit("System: x")))
        .otherwise(""),
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_columns(table(spark, sf_dir, "documents"))


def text_columns(documents: DataFrame) -> DataFrame:
    """Texts as documents of cases; a third of them is in one case."""
    d = F.col("doc_id")
    home = d % 5 != 4
    return documents.select(
        F.when(d % 3 == 0, "0").otherwise(F.floor(d / 4).cast("string")).alias("case_id"),
        d.cast("string").alias("doc_id"),
        d.alias("doc_seq"),
        F.when(home, fv.COUNTRY).otherwise("austria").alias("country"),
        F.when(home, fv.COUNTRY_CODE).otherwise("AT").alias("country_code"),
        F.lit(fv.PROCESS).alias("process_type"),
        F.lit("").alias("doc_type"),
        F.lit("").alias("category"),
        F.concat(F.lit("text_"), d.cast("string")).alias("file_name"),
        spliced_text().alias("text_content"),
        F.lit("pending").alias("status"),
        F.lit("1998-06-30").alias("upload_timestamp"),
    )


def _hundredths(n: Column) -> Column:
    return F.concat((F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def type_replies(keys: DataFrame) -> DataFrame:
    """Replies to classification prompts by the number of the document; some are missing, failed or broken."""
    k = F.col("doc_seq")
    named = F.coalesce(_case((k % 6).cast("int"), [F.lit(t) for t in TYPES]), F.lit(fv.UNKNOWN_DOCUMENT))
    confidence = F.when(k % 43 == 0, F.lit('"high"')).otherwise(_hundredths(k * 37 % 101))
    body = F.concat(
        F.lit('{"detected_type": "'), named, F.lit('", "confidence": '), confidence,
        F.lit(', "alternative_types": [{"type": "tax_return", "confidence": 0.1}], "reasoning": "r'), k.cast("string"), F.lit('"}'),
    )
    reply = (
        F.when(k % 37 == 0, None)
        .when(k % 41 == 0, "[1,2]")
        .when(k % 10 == 7, '{"detected_type": "x')
        .when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return keys.where(k % 47 != 0).select(
        "doc_id", reply.alias("raw_response"), F.when(k % 37 == 0, "timeout").alias("error")
    )


def condition_replies(cases_df: DataFrame, names: list[str]) -> DataFrame:
    """Replies to condition prompts by the number of the case; some are missing, failed or broken."""
    n = F.col("case_id").cast("bigint")
    rows = cases_df.select("case_id", F.posexplode(F.array(*[F.lit(x) for x in names])).alias("i", "condition_name"))
    form = (n + F.col("i")) % 7
    reply = (
        F.when(form == 0, '{"status": "pass", "analyst_message": "fine", "details": {"comparison_summary": "same"}}')
        .when(form == 1, '```json\n{"status": "fail", "analyst_message": "differs", "details": {}}\n```')
        .when(form == 2, '{"status": "needs_review"}')
        .when(form == 3, '{"status": "maybe", "analyst_message": "unsure"}')
        .when(form == 4, '{"status": ')
    )
    return rows.where(form != 6).select(
        "case_id", "condition_name", reply.alias("raw_response"), F.when(form == 5, "timeout").alias("error")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempt_columns(table(spark, sf_dir, "events"))


def attempt_columns(events: DataFrame) -> DataFrame:
    """Three recorded attempts per document and step from three events in a row."""
    e = F.col("event_id")
    body = F.when(
        e % 4 < 2, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "v": '), F.col("user_id").cast("string"), F.lit("}"))
    ).otherwise(F.col("props"))
    reply = (
        F.when((e % 13 == 0) | (e % 17 == 0), None)
        .when(e % 11 == 0, "[1]")
        .when(e % 7 == 0, F.expr("substring(props, 1, length(props) - 2)"))
        .when(e % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return events.select(
        F.floor(e / 3).cast("bigint").alias("doc_id"),
        F.lit("extract_fields").alias("step_name"),
        F.lit(0).alias("step_pos"),
        (e % 3 + 1).cast("int").alias("attempt"),
        reply.alias("raw_response"),
        F.when(e % 13 == 0, "timeout").when(e % 17 == 0, "").alias("error"),  # some errors have no text
    )


def step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three steps per document from three events in a row."""
    e = F.col("event_id")
    data = F.map_from_arrays(
        F.array(F.lit("k"), F.col("event_type")),
        F.array(
            value(F.regexp_extract("props", r"(\d+)", 1), "int"), value(F.col("user_id").cast("string"), "string")
        ),
    )
    return table(spark, sf_dir, "events").select(
        F.floor(e / 3).cast("bigint").alias("doc_id"),
        F.concat(F.lit("s"), (e % 3).cast("string")).alias("step"),
        (e % 3).cast("int").alias("step_pos"),
        data.alias("data"),
    )


def step_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    settings = F.create_map(
        F.lit("temperature"), (e % 10).cast("string"), F.concat(F.lit("k"), (e % 3).cast("string")), F.col("event_type")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        e.alias("seq"),
        F.col("event_type").alias("from_step"),
        F.when(e % 2 == 0, "extract").otherwise("verify").alias("target_step"),
        settings.alias("settings"),
    )


REQUIREMENTS = [
    dict(
        pos=0, category="income_proof", doc_types=["salary_slip", "tax_return"], min_required=1, max_accepted=2,
        role="income", condition=None, temporal_constraints={"salary_slip": 2, "tax_return": 1},
    ),
    dict(
        pos=1, category="identity", doc_types=["identity_document"], min_required=1, max_accepted=2, role="person",
        condition="loan_amount > 100000", temporal_constraints={},
    ),
    dict(
        pos=2, category="application", doc_types=["loan_application"], min_required=1, max_accepted=1, role="request",
        condition="no_such_column = 1", temporal_constraints={},
    ),
]


def _required(process: str, **row) -> dict:
    defaults = dict(country=fv.COUNTRY, process_type=process, role=None, condition=None, temporal_constraints={})
    return defaults | row


LARGE_LOAN = "request.loan_amount > 100000"
#: Two processes with other rules; both make the identity depend on the same condition.
PROCESS_REQUIREMENTS = [
    *[_required(fv.PROCESS, **{k: v for k, v in r.items() if k != "condition"}) for r in REQUIREMENTS if r["pos"] != 1],
    _required(fv.PROCESS, pos=1, category="identity", doc_types=["identity_document"], min_required=1, max_accepted=2, role="person", condition=LARGE_LOAN),
    _required("mortgage", pos=0, category="identity", doc_types=["identity_document"], min_required=2, max_accepted=2, condition=LARGE_LOAN),
    _required("mortgage", pos=1, category="income_proof", doc_types=["salary_slip"], min_required=1, max_accepted=1, role="income",
              condition="income.net_salary / request.loan_amount < 0.5 OR request.loan_amount IS NULL"),
    _required("mortgage", pos=2, category="application", doc_types=["loan_application"], min_required=1, max_accepted=9, role="request",
              condition="request.no_such_field = 1 AND nowhere"),
]


def process_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two processes; those of another country have none with requirements."""
    third = F.col("case_id").cast("bigint") % 3 == 0
    return cases(spark, sf_dir).withColumn("process_type", F.when(third, "mortgage").otherwise(fv.PROCESS))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor data of a case: its largest loan amount."""
    k = F.col("o_orderkey")
    loans = table(spark, sf_dir, "orders").where(k % 6 == 4)
    return loans.groupBy(F.col("o_custkey").cast("string").alias("case_id")).agg(F.max("o_totalprice").alias("loan_amount"))
