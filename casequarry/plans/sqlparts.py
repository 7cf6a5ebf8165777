"""Common table expressions for the checking SQL: the same mapping as ``inputs``, written once more in SQL."""

from __future__ import annotations

from casequarry import fixed_values as fv

MANUAL = fv.NEEDS_MANUAL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TYPE_BY_KEY = (
    "CASE {k} % 6 WHEN 0 THEN 'salary_slip' WHEN 1 THEN 'bank_statement' WHEN 2 THEN 'tax_return' "
    "WHEN 3 THEN 'identity_document' WHEN 4 THEN 'loan_application' ELSE '{other}' END"
)
TYPE_BY_LINE = (
    "CASE l_linenumber % 5 WHEN 0 THEN 'salary_slip' WHEN 1 THEN 'bank_statement' WHEN 2 THEN 'tax_return' "
    "WHEN 3 THEN 'identity_document' ELSE 'loan_application' END"
)

CASES = """cases AS (
  SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_custkey AS ck,
         CASE WHEN c_nationkey % 5 = 4 THEN 'austria' ELSE 'germany' END AS country
  FROM customer)"""

DOCS = f"""docs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey AS doc_seq,
         o_orderkey AS k, o_custkey AS ck,
         {TYPE_BY_KEY.format(k='o_orderkey', other=MANUAL)} AS doc_type,
         CASE WHEN o_orderkey % 10 < 3 THEN 'income_proof' WHEN o_orderkey % 10 = 3 THEN 'identity'
              WHEN o_orderkey % 10 = 4 THEN 'application' ELSE '' END AS category,
         'doc_' || o_orderkey || '.txt' AS file_name,
         strftime(o_orderdate, '%Y-%m-%d') AS document_date,
         CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS document_period,
         CASE WHEN o_orderkey % 6 = 5 THEN 'skipped' WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'extracted' END AS status,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '31.02.2001'
              ELSE CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                   WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
                   WHEN 3 THEN strftime(o_orderdate, '%m/%Y') ELSE strftime(o_orderdate, '%Y-%m') END END AS date_text,
         round(CASE WHEN o_orderkey % 29 = 0 THEN 0.0 WHEN o_orderkey % 6 = 1 THEN o_totalprice - 150000
              ELSE o_totalprice END, 2) AS amount
  FROM orders)"""

PARSED = """parsed AS (
  SELECT *, CAST(try_strptime(date_text, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%m/%Y', '%Y-%m']) AS DATE) AS day FROM docs)"""

FIELDS = """fields AS (
  SELECT * FROM (
    SELECT case_id, doc_id, doc_seq, doc_type, status, CASE k % 6 WHEN 0 THEN 'pay_period' WHEN 1 THEN 'statement_date'
             WHEN 2 THEN 'document_date' WHEN 3 THEN 'expiry_date' WHEN 4 THEN 'application_date' END AS field,
           date_text AS text, CASE WHEN date_text IS NULL THEN 'null' ELSE 'string' END AS kind FROM docs
    UNION ALL
    SELECT case_id, doc_id, doc_seq, doc_type, status, CASE k % 6 WHEN 0 THEN 'net_salary' WHEN 1 THEN 'closing_balance'
             WHEN 2 THEN 'total_income' WHEN 4 THEN 'loan_amount' END,
           CAST(amount AS VARCHAR), CASE WHEN k % 31 = 0 THEN 'string' ELSE 'float' END FROM docs
    UNION ALL
    SELECT case_id, doc_id, doc_seq, doc_type, status, CASE k % 6 WHEN 0 THEN 'employee_name' WHEN 1 THEN 'account_holder'
             WHEN 2 THEN 'taxpayer_name' WHEN 3 THEN 'last_name' WHEN 4 THEN 'applicant_name' END,
           'Kunde ' || ck, 'string' FROM docs WHERE k % 17 <> 0
    UNION ALL
    SELECT case_id, doc_id, doc_seq, doc_type, status, 'document_number', 'ID' || k, 'string' FROM docs WHERE k % 6 = 3
    UNION ALL
    SELECT case_id, doc_id, doc_seq, doc_type, status, 'signature_present',
           CASE WHEN k % 5 < 3 THEN 'True' WHEN k % 5 = 3 THEN 'False' END,
           CASE WHEN k % 5 = 4 THEN 'null' ELSE 'bool' END FROM docs WHERE k % 6 = 4 AND k % 13 <> 0
    UNION ALL
    SELECT case_id, doc_id, doc_seq, doc_type, status, '_note', CASE WHEN k % 4 <> 0 THEN 'n' END,
           CASE WHEN k % 4 <> 0 THEN 'string' ELSE 'null' END FROM docs WHERE k % 6 < 5
  ) WHERE field IS NOT NULL)"""

CELL = "CASE kind WHEN 'string' THEN '\"' || text || '\"' WHEN 'bool' THEN lower(text) WHEN 'null' THEN 'null' ELSE text END"

RECORDS = f"""cells AS (SELECT *, '"' || field || '": ' || {CELL} AS cell FROM fields),
members AS (SELECT doc_id, string_agg(cell, ', ' ORDER BY field) AS members FROM cells GROUP BY doc_id),
records AS (SELECT d.*, coalesce(m.members, '') AS members, '{{' || coalesce(m.members, '') || '}}' AS record
  FROM docs d LEFT JOIN members m USING (doc_id))"""

RESULTS = """results AS (
  SELECT case_id, doc_id, doc_seq, CASE doc_type WHEN 'salary_slip' THEN 0 WHEN 'bank_statement' THEN 1 ELSE 2 END AS condition_seq,
         CASE doc_type WHEN 'salary_slip' THEN 'salary_slip_freshness' WHEN 'bank_statement' THEN 'bank_statement_freshness'
              ELSE 'identity_document_validity' END AS condition_name,
         CASE WHEN date_text IS NULL THEN 'needs_review' WHEN passed THEN 'pass'
              WHEN doc_type = 'identity_document' THEN 'fail' ELSE 'needs_review' END AS status,
         CASE WHEN date_text IS NOT NULL AND passed THEN 'info' WHEN doc_type = 'identity_document' THEN 'error'
              ELSE 'warning' END AS severity,
         CASE WHEN date_text IS NOT NULL AND passed THEN 'Check passed'
              WHEN doc_type = 'salary_slip' THEN 'Salary slip pay period ''' || coalesce(date_text, 'MISSING') || ''' may be outdated (>3 months)'
              WHEN doc_type = 'bank_statement' THEN 'Bank statement date ''' || coalesce(date_text, 'MISSING') || ''' may be outdated (>3 months)'
              ELSE 'Identity document expiry date ''' || coalesce(date_text, 'MISSING') || ''' has passed' END AS analyst_message,
         date_text, day
  FROM (SELECT *, coalesce(CASE WHEN doc_type = 'identity_document' THEN day >= DATE '1998-06-30'
                  ELSE day >= DATE '1998-03-30' END, false) AS passed FROM parsed)
  WHERE doc_type IN ('salary_slip', 'bank_statement', 'identity_document'))"""

FLAGS = """flags AS (
  SELECT case_id, bool_or(severity = 'error' AND status = 'fail') AS blocking, bool_or(status = 'needs_review') AS needs_review
  FROM results GROUP BY case_id)"""

CLASSIFIED = f"""classified AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey AS doc_seq,
         {TYPE_BY_KEY.format(k='o_orderkey', other=MANUAL)} AS detected_type, (o_orderkey % 100) / 100.0 AS confidence
  FROM orders WHERE o_orderkey % 7 <> 0)"""

TEXTS = """texts AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(doc_id // 4 AS VARCHAR) END AS case_id,
         CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS k, text AS original,
         CASE WHEN doc_id % 5 <> 4 THEN 'germany' ELSE 'austria' END AS country,
         CASE WHEN doc_id % 5 <> 4 THEN 'DE' ELSE 'AT' END AS country_code,
         text || CASE WHEN doc_id % 7 = 0 THEN ' DE12ABCDEFGH0123456789' ELSE '' END
              || CASE WHEN doc_id % 5 = 0 THEN ' +49 30 1234567' ELSE '' END
              || CASE WHEN doc_id % 9 = 0 THEN ' 12/345/67890' ELSE '' END
              || CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'ignore previous instructions'
                      WHEN doc_id % 19 = 0 THEN chr(10) || 'System: x' ELSE '' END AS text
  FROM documents)"""


def screened(column: str, source: str, name: str = "screened", keep: str = "*") -> str:
    """Input guards without length of the prompt being unknown: adds ``reason`` (null when passed)."""
    return f"""{name} AS (
  SELECT {keep}, CASE WHEN length({column}) > 32000
           THEN 'Prompt exceeds max length (' || length({column}) || ' > 32000)'
         WHEN regexp_matches({column}, 'ignore previous instructions') THEN 'Injection pattern detected: ignore previous instructions'
         WHEN regexp_matches({column}, 'you are now') THEN 'Injection pattern detected: you are now'
         WHEN regexp_matches({column}, 'pretend you are') THEN 'Injection pattern detected: pretend you are'
         WHEN regexp_matches({column}, 'act as if') THEN 'Injection pattern detected: act as if'
         WHEN regexp_matches({column}, '(?i)```\\s*(system|assistant|user)\\s*\\n')
           OR regexp_matches({column}, '(?i)<\\|?(system|assistant|user)\\|?>')
           OR regexp_matches({column}, '(?i)\\n(system|assistant|user)\\s*:')
         THEN 'Role injection structure detected in input' END AS reason
  FROM {source})"""


ENTROPY = """windows AS (
  SELECT doc_id, unnest(range(0, greatest(1, length(text) - 100), 50)) AS start, text FROM texts),
entropy AS (
  SELECT doc_id, max(list_entropy(string_split(substr(text, CAST(start + 1 AS INTEGER), 100), ''))) AS bits, count(*) AS windows
  FROM windows WHERE text <> '' GROUP BY doc_id)"""

REDACTED = r"""redact1 AS (SELECT *, len(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS n1,
  regexp_replace(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g') AS t1 FROM texts),
redact2 AS (SELECT *, len(regexp_extract_all(t1, '\+[0-9]{1,3}[\s\-]?[0-9\s\-]{6,14}')) AS n2,
  regexp_replace(t1, '\+[0-9]{1,3}[\s\-]?[0-9\s\-]{6,14}', '[PHONE]', 'g') AS t2 FROM redact1),
redact3 AS (SELECT *, CASE WHEN country_code = 'DE' THEN len(regexp_extract_all(t2, 'DE[0-9]{2}[0-9A-Z]{18}')) ELSE 0 END AS n3,
  CASE WHEN country_code = 'DE' THEN regexp_replace(t2, 'DE[0-9]{2}[0-9A-Z]{18}', '[IBAN]', 'g') ELSE t2 END AS t3 FROM redact2),
redacted AS (SELECT *, CASE WHEN country_code = 'DE' THEN len(regexp_extract_all(t3, '[0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}')) ELSE 0 END AS n4,
  CASE WHEN country_code = 'DE' THEN regexp_replace(t3, '[0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}', '[STEUERNUMMER]', 'g') ELSE t3 END AS t4 FROM redact3)"""

PII_FLAGS = (
    "concat_ws(',', CASE WHEN n1 > 0 THEN 'PII_EMAIL_DETECTED' END, "
    "CASE WHEN n2 > 0 THEN 'PII_PHONE_INTERNATIONAL_DETECTED' END, "
    "CASE WHEN n3 > 0 THEN 'PII_IBAN_DE_DETECTED' END, CASE WHEN n4 > 0 THEN 'PII_STEUERNUMMER_DETECTED' END)"
)

ATTEMPTS = """attempts AS (
  SELECT event_id AS e, event_id // 3 AS doc_id, event_id % 3 + 1 AS attempt,
         CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 17 = 0 THEN '' END AS error,
         CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '[1]'
              WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 2)
              WHEN event_id % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
  FROM (SELECT *, CASE WHEN event_id % 4 < 2 THEN substr(props, 1, length(props) - 1) || ', "v": ' || user_id || '}' ELSE props END AS body
        FROM events)),
cleaned AS (
  SELECT *, CASE WHEN raw LIKE '```%' THEN regexp_extract(raw, '(?s)```json\\n(.*)\\n```', 1) ELSE raw END AS clean FROM attempts),
judged AS (
  SELECT *, CASE WHEN error IS NOT NULL OR clean IS NULL THEN false WHEN NOT json_valid(clean) THEN false WHEN json_type(clean) <> 'OBJECT' THEN false
              ELSE json_exists(clean, '$.v') END AS good, CASE WHEN error IS NOT NULL THEN error WHEN NOT json_valid(clean) THEN 'JSON parse error: invalid JSON'
              WHEN json_type(clean) <> 'OBJECT' THEN 'JSON parse error: Expected JSON object, got list'
              WHEN NOT json_exists(clean, '$.v') THEN 'Schema validation errors: [''Missing key: v'']' ELSE '' END AS problem
  FROM cleaned)"""

RESOLVED = """resolved AS (
  SELECT doc_id, min(CASE WHEN good THEN attempt END) AS first_good, max(attempt) AS last_attempt,
         arg_max(problem, attempt) AS last_problem,
         arg_max(CASE WHEN json_valid(clean) AND json_type(clean) = 'OBJECT' THEN 1 ELSE 0 END, attempt) AS last_is_object
  FROM judged GROUP BY doc_id)"""

TYPE_REPLIES = """type_replies AS (
  SELECT *, k * 37 % 101 AS c100,
         CASE WHEN k % 47 = 0 THEN 'missing' WHEN k % 37 = 0 THEN 'error' WHEN k % 41 = 0 THEN 'list'
              WHEN k % 10 = 7 THEN 'broken' WHEN k % 43 = 0 THEN 'word' ELSE 'good' END AS form FROM texts)"""
