"""Screening of prompts and replies.

Each operator adds flat columns, so that a column nobody reads (the entropy flag, the redacted text) is
pruned from the plan together with its cost.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions import text as tx
from casequarry.functions.jsonobj import is_json, unexpected_keys
from casequarry.scale import settle
from casequarry.sources.config import ReviewConfig

# The digest that intake keeps of a text, and the mark of a text that no longer has it.
HASH, TAMPERED = "original_input_hash", "tampered"
# Up to so many patterns are columns of their own; more are run through one expression.
UNROLLED = 16


def _flags(*cells: Column) -> Column:
    """The flags that are set, in order."""
    return F.filter(F.array(*cells).cast("array<string>"), lambda f: f.isNotNull())


def _java_replacement(text: str) -> str:
    """A replacement as the engine writes it: ``\\1`` and ``\\g<1>`` name groups, two backslashes are one, all else stands for itself."""
    plain = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")
    parts = re.split(r"\\(?:g<(\d+)>|(\d\d?)|(\\))", text)
    out = [plain(parts[0])]
    for k in range(1, len(parts), 4):
        named, short, backslash, rest = parts[k : k + 4]
        out.append((plain(backslash) if backslash else f"${named or short}") + plain(rest))
    return "".join(out)


def _country_column(df: DataFrame, given: str | None) -> str | None:
    """The column of country codes: the one named, else ``country_code`` where there is one."""
    return given or ("country_code" if "country_code" in df.columns else None)


def redact(
    df: DataFrame, text_col: str, patterns: list[dict], country_code_col: str | None = None, prefix: str = "pii"
) -> DataFrame:
    """Replace personal data, pattern by pattern, each on the text the earlier ones have left.

    Adds ``<prefix>_text``, ``<prefix>_count`` and ``<prefix>_flags``. Global patterns come first; a
    country's patterns apply where ``country_code_col`` holds its code. A pattern only runs where the text holds the
    letters that each of its matches has (``text.required_literals``), and only replaces where it was found.
    """
    current, counts, out = text_col, [], df
    country_code_col = _country_column(df, country_code_col)
    if country_code_col is None and any(p["scope"] != "global" for p in patterns):
        raise ValueError("patterns of a country need the documents' country_code")
    if len(patterns) > UNROLLED:
        return _redact_in_a_loop(df, text_col, patterns, country_code_col, prefix)
    for i, p in enumerate(patterns):
        regex = tx.unicode_space(p["pattern"])
        applies = F.lit(True) if p["scope"] == "global" else F.coalesce(F.col(country_code_col) == p["scope"], F.lit(False))
        n, nxt = f"_{prefix}_n{i}", f"_{prefix}_t{i}"
        due = applies & tx.may_match(F.col(current), p["pattern"])
        out = out.withColumn(n, F.when(due, F.coalesce(F.regexp_count(F.col(current), F.lit(regex)), F.lit(0))).otherwise(0))
        replaced = F.regexp_replace(F.col(current), regex, _java_replacement(p["replacement"]))
        out = out.withColumn(nxt, F.when(F.col(n) > 0, replaced).otherwise(F.col(current)))
        counts.append((n, f"PII_{p['name'].upper()}_DETECTED"))
        current = nxt
    total = sum((F.col(n) for n, _ in counts), F.lit(0))
    return out.select(
        *df.columns,
        F.col(current).alias(f"{prefix}_text"),
        total.cast("bigint").alias(f"{prefix}_count"),
        _flags(*[F.when(F.col(n) > 0, flag) for n, flag in counts]).alias(f"{prefix}_flags"),
    )


_PATTERN = "struct<scope:string,regex:string,replacement:string,flag:string,literals:array<string>,fold:boolean>"


def _redact_in_a_loop(df: DataFrame, text_col: str, patterns: list[dict], country_code_col: str | None, prefix: str) -> DataFrame:
    """The same for many patterns, as one expression over a list of them: the plan does not grow with their number."""
    rows = []
    for p in patterns:
        literals, fold = tx.required_literals(p["pattern"])
        rows.append(
            dict(
                scope=p["scope"], regex=tx.unicode_space(p["pattern"]), replacement=_java_replacement(p["replacement"]),
                flag=f"PII_{p['name'].upper()}_DETECTED", literals=literals, fold=fold,
            )
        )
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<{_PATTERN}>")
    country = F.col(country_code_col) if country_code_col else F.lit(None).cast("string")

    def step(done: Column, p: Column) -> Column:
        text = done["text"]
        applies = (p["scope"] == "global") | F.coalesce(country == p["scope"], F.lit(False))
        seen = F.when(p["fold"], F.lower(text)).otherwise(text)
        held = (F.size(p["literals"]) == 0) | F.exists(p["literals"], lambda x: F.contains(seen, x))
        found = F.when(applies & held, F.coalesce(F.regexp_count(text, p["regex"]), F.lit(0))).otherwise(0)
        return tx.let(
            found,
            lambda n: F.struct(
                F.when(n > 0, F.regexp_replace(text, p["regex"], p["replacement"])).otherwise(text).alias("text"),
                (done["n"] + n).alias("n"),
                F.when(n > 0, F.array_append(done["flags"], p["flag"])).otherwise(done["flags"]).alias("flags"),
            ),
        )

    start = F.struct(
        F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("flags")
    )
    out = settle(df, _redacted=F.aggregate(listed, start, step))
    return out.select(
        *df.columns,
        F.col("_redacted.text").alias(f"{prefix}_text"),
        F.col("_redacted.n").alias(f"{prefix}_count"),
        F.col("_redacted.flags").alias(f"{prefix}_flags"),
    )


def mark_tampered(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Adds whether a document's text is no longer the one that came in, where the guards ask for it.

    Intake keeps the digest of the text (``original_input_hash``); the text is compared once, and the mark goes with the
    document into all its prompts. Documents without a digest are not marked.
    """
    asked = cfg.guards["input_guards"].get("require_document_hash_match")
    if not asked or HASH not in docs.columns or TAMPERED in docs.columns:
        return docs
    return settle(docs, **{TAMPERED: tx.hash_tampered(F.coalesce("text_content", F.lit("")), F.col(HASH))})


def input_verdict(
    df: DataFrame,
    prompt_col: str,
    cfg: ReviewConfig,
    text_col: str | None = None,
    hash_col: str | None = None,
    country_code_col: str | None = None,
    prompt_length: Column | None = None,
    entropy: bool = True,
) -> DataFrame:
    """Screen a prompt: integrity, length, blocked phrases, role markers, entropy, personal data.

    The first block decides and its flag is the only one. Adds ``in_passed, in_flags, in_reason, in_text,
    in_pii_count``. ``prompt_length`` stands in for prompts that were never put together for being too long.
    ``entropy=False`` leaves out the entropy flag, which never blocks, for callers that keep no flags of
    passed prompts. Rows that were marked before they became prompts (``mark_tampered``) need no text and hash here.
    """
    guards, pii = cfg.guards["input_guards"], cfg.guards.get("pii", {})
    limit = guards.get("max_prompt_length", 32000)
    prompt = F.col(prompt_col)
    length = F.length(prompt) if prompt_length is None else prompt_length
    required = guards.get("require_document_hash_match")
    check_hash = required and text_col and hash_col
    tampered = tx.hash_tampered(F.col(text_col), F.col(hash_col)) if check_hash else F.lit(False)
    if required and TAMPERED in df.columns:
        tampered = tampered | F.coalesce(TAMPERED, F.lit(False))
    # Each stage runs once per row, cheap checks first; later stages skip what an earlier one blocked.
    out = settle(df.withColumnRenamed(prompt_col, "_given"), **{prompt_col: F.col("_given")}).drop("_given")
    out = settle(out, _early=F.when(tampered, "T").when(length > limit, "L"))
    phrases = tx.first_match(prompt, guards["blocked_content_patterns"])
    out = settle(out, _hit=F.when(F.col("_early").isNull(), phrases))
    out = settle(out, _role=F.col("_early").isNull() & F.col("_hit").isNull() & tx.role_structure(prompt))
    early = F.col("_early")
    blocked = early.isNotNull() | F.col("_hit").isNotNull() | F.coalesce(F.col("_role"), F.lit(False))
    out = out.withColumn("in_passed", ~blocked).withColumn(
        "in_reason",
        F.when(early == "T", fv.REASON_TAMPERED)
        .when(early == "L", F.format_string(fv.REASON_INPUT_TOO_LONG, length.cast("bigint"), F.lit(limit)))
        .when(F.col("_hit").isNotNull(), F.concat(F.lit(fv.REASON_INJECTION), "_hit"))
        .when(F.col("_role"), fv.REASON_ROLE),
    )
    # Blocked prompts go to the entropy function as null, which costs nothing there.
    noisy = tx.high_entropy(F.when(F.col("in_passed"), prompt)) if entropy else F.lit(False)
    out = out.withColumn("_entropy", noisy)
    if pii.get("scan_input"):
        out = redact(out, prompt_col, cfg.pii_patterns(), country_code_col, "_scan")
    else:
        out = (
            out.withColumn("_scan_text", prompt)
            .withColumn("_scan_count", F.lit(0).cast("bigint"))
            .withColumn("_scan_flags", F.array().cast("array<string>"))
        )
    block_flag = (
        F.when(early == "T", fv.FLAG_TAMPERED)
        .when(early == "L", fv.FLAG_INPUT_TOO_LONG)
        .when(F.col("_hit").isNotNull(), fv.FLAG_INJECTION)
        .otherwise(fv.FLAG_ROLE)
    )
    passed = F.col("in_passed")
    return out.select(
        *df.columns,
        "in_passed",
        F.when(passed, F.concat(_flags(F.when(F.col("_entropy"), fv.FLAG_ENTROPY)), F.col("_scan_flags")))
        .otherwise(F.array(block_flag))
        .alias("in_flags"),
        "in_reason",
        F.when(passed, F.col("_scan_text")).alias("in_text"),
        F.when(passed, F.col("_scan_count")).otherwise(0).alias("in_pii_count"),
    )


def output_verdict(
    df: DataFrame,
    reply_col: str,
    cfg: ReviewConfig,
    expected_col: str | None = None,
    country_code_col: str | None = None,
) -> DataFrame:
    """Screen a reply: length, JSON, blocked content, unexpected fields, personal data.

    Adds ``out_passed, out_flags, out_reason, out_text`` (the sanitised reply, null when blocked) and
    ``reply_text``, what the readers of the reply go on with: the sanitised text, or the raw reply when
    there is none. A blocked reply is still read; callers that must not can filter on ``out_passed``.
    """
    guards, pii = cfg.guards["output_guards"], cfg.guards.get("pii", {})
    limit = guards.get("max_response_length", 10000)
    reply = F.col(reply_col)
    out = df.withColumn("_long", tx.too_long(reply, limit))
    if guards.get("must_be_valid_json", False):
        out = out.withColumn("_block", tx.fenced_block(reply)).withColumn("_bad_json", ~is_json(F.col("_block")))
        inner = F.coalesce(F.when(F.col("_block") != "", F.col("_block")), reply)
    else:
        out = out.withColumn("_bad_json", F.lit(False))
        inner = reply
    out = out.withColumn("_inner", inner).withColumn("_hit", tx.first_match(reply, guards.get("block_if_contains", [])))
    if expected_col:
        odd = F.when(F.size(expected_col) > 0, unexpected_keys(reply, F.col(expected_col)))
        out = out.withColumn(
            "_odd", F.when(F.size(odd) > 0, F.concat(F.lit("HALLUCINATED_FIELDS:"), F.array_join(odd, ",")))
        )
    else:
        out = out.withColumn("_odd", F.lit(None).cast("string"))
    if pii.get("scan_output"):
        out = redact(out, "_inner", cfg.pii_patterns(), country_code_col, "_scan")
        stop = (F.size("_scan_flags") > 0) & F.lit(pii.get("action") == "block")
    else:
        out = out.withColumn("_scan_text", F.col("_inner")).withColumn("_scan_flags", F.array().cast("array<string>"))
        stop = F.lit(False)
    out = out.withColumn(
        "out_reason",
        F.when(F.col("_long"), F.format_string(fv.REASON_OUTPUT_TOO_LONG, F.length(reply), F.lit(limit)))
        .when(F.col("_bad_json"), fv.REASON_INVALID_JSON)
        .when(F.col("_hit").isNotNull(), F.concat(F.lit(fv.REASON_BLOCKED_CONTENT), "_hit"))
        .when(stop, fv.REASON_PII_OUTPUT),
    ).withColumn("out_passed", F.col("out_reason").isNull())
    flags = (
        F.when(F.col("_long"), F.array(F.lit(fv.FLAG_OUTPUT_TOO_LONG)))
        .when(F.col("_bad_json"), F.array(F.lit(fv.FLAG_INVALID_JSON)))
        .when(F.col("_hit").isNotNull(), F.array(F.lit(fv.FLAG_BLOCKED_CONTENT)))
        .when(stop, F.col("_scan_flags"))
        .otherwise(F.concat(_flags(F.col("_odd")), F.col("_scan_flags")))
    )
    text = F.when(F.col("out_passed"), F.col("_scan_text"))
    return out.select(
        *df.columns,
        "out_passed",
        flags.alias("out_flags"),
        "out_reason",
        text.alias("out_text"),
        F.coalesce(F.when(text != "", text), reply).alias("reply_text"),
    )
