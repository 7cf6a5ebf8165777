"""The model step: calls, attempts, retries, traces.

A model reply comes from a table of replies or from a user function that sees batches of prompts. All
attempts of a step over all documents run as one round of Spark jobs; each round is written to the shared
folder, so that a lost executor re-reads replies instead of asking again.
"""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry import fixed_values as fv
from casequarry.functions.jsonobj import missing_keys, parse_object
from casequarry.functions.values import RECORD, empty_record
from casequarry.operators.guards import TAMPERED, input_verdict, mark_tampered, output_verdict
from casequarry.operators.prompts import context_lines, extraction_prompts, reflection_prompt
from casequarry.operators.stepdata import flatten_last_wins, flatten_prefixed
from casequarry.scale import cut_lineage, lookup, settle
from casequarry.sources.config import ReviewConfig

log = logging.getLogger(__name__)

# Gets a pandas frame with prompt, temperature and backend_key; returns one reply text per row, in order.
ModelFunction = Callable[[pd.DataFrame], Sequence[str]]
_REPLY_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
]


def call_model(
    prompts: DataFrame,
    model_fn: ModelFunction,
    keys: Sequence[str],
    temperature: float = 0.0,
    backend_key: str = "default",
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``raw_response, error, duration_ms`` to prompts.

    Columns ``temperature`` and ``backend_key`` of the prompts go to the model with each row; the arguments stand in
    where they are missing. Rows without a prompt, or with a false ``in_passed``, pass by without being asked. Prompts are asked
    where they are; ``partitions`` shuffles them by their keys into that many tasks first, for models that
    want more (or fewer) callers than the input has partitions. When the function raises for a batch, or
    returns another number of replies, its halves are asked until only failing rows carry an error.
    """

    def ask(batch: pd.DataFrame) -> tuple[list, list]:
        try:
            replies = list(model_fn(batch))
            if len(replies) != len(batch):
                raise ValueError(f"{len(replies)} replies to {len(batch)} prompts")
            return replies, [None] * len(batch)
        except Exception as exc:  # noqa: BLE001 - any failure of the model is data here
            if len(batch) == 1:
                return [None], [str(exc)]
        half = len(batch) // 2
        (front, bad), (back, worse) = ask(batch.iloc[:half]), ask(batch.iloc[half:])
        return front + back, bad + worse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = time.monotonic()
            due = batch.column("prompt").is_valid().to_pylist()
            if "in_passed" in batch.schema.names:
                due = [d and p for d, p in zip(due, batch.column("in_passed").to_pylist(), strict=True)]
            places = [i for i, d in enumerate(due) if d]
            frame = pd.DataFrame({"prompt": batch.column("prompt").take(pa.array(places, pa.int64())).to_pylist()})
            for name, given in (("temperature", temperature), ("backend_key", backend_key)):
                own = batch.column(name).take(pa.array(places, pa.int64())).to_pylist() if name in batch.schema.names else []
                frame[name] = [given if v is None else v for v in own] if own else given
            replies, errors = [None] * len(due), [None] * len(due)
            for i, reply, error in zip(places, *(ask(frame) if places else ([], [])), strict=True):
                replies[i], errors[i] = reply, error
            spent = (time.monotonic() - start) * 1000 / max(len(places), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(replies, pa.string()),
                    pa.array(errors, pa.string()),
                    pa.array([spent if d else 0.0 for d in due], pa.float64()),
                ],
                names=[*batch.schema.names, "raw_response", "error", "duration_ms"],
            )

    schema = T.StructType([*prompts.schema.fields, *_REPLY_FIELDS])
    asked = prompts.repartition(partitions, *keys) if partitions else prompts
    return asked.mapInArrow(run, schema)


# Gets a prompt, its temperature and its backend; returns the reply's text.
OneCall = Callable[[str, float, str], str]


def call_in_flight(
    prompts: DataFrame,
    ask_one: OneCall,
    keys: Sequence[str],
    in_flight: int = 8,
    temperature: float = 0.0,
    backend_key: str = "default",
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``raw_response, error, duration_ms`` like ``call_model``, by single calls of which each task has several open.

    At most ``in_flight`` calls of a task are open at a time, across the borders of batches; rows leave in the order
    they came. A call that raises is its row's error.
    """

    def timed(prompt: str, heat: float, backend: str) -> tuple[str | None, str | None, float]:
        start = time.monotonic()
        try:
            reply, error = ask_one(prompt, heat, backend), None
        except Exception as exc:  # noqa: BLE001 - any failure of the model is data here
            reply, error = None, str(exc)
        return reply, error, (time.monotonic() - start) * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple[pa.RecordBatch, list[Future | None]]] = deque()
        open_calls: deque[Future] = deque()

        def finished(some: int) -> Iterator[pa.RecordBatch]:
            """Batches from the front, until ``some`` are left."""
            while len(waiting) > some:
                batch, calls = waiting.popleft()
                cells = [c.result() if c else (None, None, 0.0) for c in calls]
                columns = [pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "raw_response", "error", "duration_ms"])

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                column = lambda name, given, b=batch: b.column(name).to_pylist() if name in b.schema.names else [given] * len(b)
                calls: list[Future | None] = []
                rows = zip(column("prompt", None), column("in_passed", True), column("temperature", None), column("backend_key", None), strict=True)
                for prompt, passed, heat, backend in rows:
                    if prompt is None or not passed:
                        calls.append(None)
                        continue
                    while len(open_calls) >= in_flight:
                        open_calls.popleft().exception()
                    calls.append(pool.submit(timed, prompt, temperature if heat is None else heat, backend_key if backend is None else backend))
                    open_calls.append(calls[-1])
                waiting.append((batch, calls))
                # The calls of the newest batch go on while the next one is read.
                yield from finished(1)
            yield from finished(0)

    schema = T.StructType([*prompts.schema.fields, *_REPLY_FIELDS])
    asked = prompts.repartition(partitions, *keys) if partitions else prompts
    return asked.mapInArrow(run, schema)


def ask_each_once(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], temperature: float = 0.0, backend_key: str = "default") -> DataFrame:
    """Adds ``raw_response, error, duration_ms`` to prompts; rows with the same prompt, temperature and backend share a reply.

    ``ask`` sees each different prompt once, with the key ``prompt_hash``. Prompts are folded in every task before they
    are shuffled, replies are written before they are handed out, and a prompt that a third of all rows share takes its
    reply over salted partitions. Rows without a prompt, or with a false ``in_passed``, pass by without being asked.
    """
    heat = F.coalesce("temperature", F.lit(temperature)) if "temperature" in prompts.columns else F.lit(temperature)
    backend = F.coalesce("backend_key", F.lit(backend_key)) if "backend_key" in prompts.columns else F.lit(backend_key)
    due = F.col("prompt").isNotNull()
    if "in_passed" in prompts.columns:
        due = due & F.col("in_passed")
    own = F.sha2(F.concat_ws("\n", heat.cast("double").cast("string"), F.length(backend).cast("string"), backend, "prompt"), 256)
    marked = prompts.withColumn("prompt_hash", F.when(due, own))
    cells = marked.select("prompt_hash", "prompt", heat.cast("double").alias("temperature"), backend.alias("backend_key"))
    different = cells.where("prompt_hash IS NOT NULL").groupBy("prompt_hash").agg(
        *[F.first(c).alias(c) for c in ("prompt", "temperature", "backend_key")], F.count(F.lit(1)).alias("_rows")
    )
    made = ask(cut_lineage(different, "prompts").drop("_rows").withColumn("in_passed", F.lit(True)))
    if "duration_ms" not in made.columns:
        made = made.withColumn("duration_ms", F.lit(None).cast("double"))
    replies = cut_lineage(made.select("prompt_hash", "raw_response", "error", "duration_ms"), "replies")
    return lookup(marked, replies, ["prompt_hash"]).drop("prompt_hash")


def join_responses(prompts: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``raw_response, error`` from a table of replies; a prompt without one has an error.

    Rows without a prompt, or with a false ``in_passed``, were not asked and have neither.
    """
    due = F.col("prompt").isNotNull()
    if "in_passed" in prompts.columns:
        due = due & F.col("in_passed")
    found = responses.select(*keys, F.struct("raw_response", "error").alias("_reply"))
    error = F.when(F.col("_reply").isNull(), "no reply recorded").otherwise(F.col("_reply.error"))
    return prompts.join(found, list(keys), "left").select(
        *prompts.columns, F.when(due, F.col("_reply.raw_response")).alias("raw_response"), F.when(due, error).alias("error")
    )


def judge_attempts(
    attempts: DataFrame, cfg: ReviewConfig, required: list[str] | None, max_retries: int, strict: bool = False
) -> DataFrame:
    """Read each reply: adds ``record, problem, success, trace_status`` and the output guard's columns.

    A reply is a success when there was no error and its record lacks no required key; ``problem`` only says so for
    people, and may be empty for a failure without a text. A record that lacks keys is kept beside its problem.
    """
    screened = output_verdict(attempts, "raw_response", cfg)
    parsed = F.when(F.col("error").isNull() & F.col("reply_text").isNotNull(), parse_object(F.col("reply_text"), strict))
    read = settle(screened, _parsed=parsed)
    read = read.withColumn("record", F.col("_parsed.record")).withColumn(
        "_missing", missing_keys(F.col("record"), required or [])
    )
    quoted = F.array_join(F.transform("_missing", lambda k: F.concat(F.lit("'Missing key: "), k, F.lit("'"))), ", ")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("record").isNull(), F.concat(F.lit("JSON parse error: "), F.coalesce("_parsed.error", F.lit("no reply"))))
        .when(F.size("_missing") > 0, F.concat(F.lit("Schema validation errors: ["), quoted, F.lit("]")))
        .otherwise("")
    )
    success = F.col("error").isNull() & F.col("record").isNotNull() & (F.size("_missing") == 0)
    return (
        read.withColumn("problem", problem)
        .withColumn("success", success)
        .withColumn(
            "trace_status",
            F.when(F.col("success"), fv.TRACE_SUCCESS)
            .when(F.col("attempt") < max_retries, fv.TRACE_RETRYING)
            .otherwise(fv.TRACE_TERMINAL),
        )
        .drop("_parsed", "_missing")
    )


def resolve_attempts(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome of each step over its recorded attempts, as one aggregation.

    The first success ends the step. Without one, the record of the final attempt is kept if it is an
    object (a soft success); otherwise the step has failed, even if an earlier attempt had an object.
    """
    ended = judged.groupBy(*keys).agg(
        F.expr("min(attempt) FILTER (WHERE success)").alias("_first"),
        F.expr("min_by(record, attempt) FILTER (WHERE success)").alias("_good"),
        F.max("attempt").alias("_last"),
        F.max_by("record", "attempt").alias("_final"),
        F.max_by("problem", "attempt").alias("_problem"),
    )
    won = F.col("_first").isNotNull()
    return ended.select(
        *keys,
        F.when(won, "success").when(F.col("_final").isNotNull(), "soft_success").otherwise("failed").alias("outcome"),
        F.coalesce("_first", "_last").alias("attempts"),
        F.when(won, F.col("_good")).otherwise(F.col("_final")).alias("record"),
        F.when(won, "").otherwise(F.col("_problem")).alias("problem"),
    )


def to_traces(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Audit rows of the attempts that were really made: none after the first success.

    A group is one step of one document, so it holds at most ``max_retries`` rows.
    """
    earlier = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("success").over(earlier), F.lit(False))
    return judged.withColumn("_done", done).where(~F.col("_done")).drop("_done").withColumn(
        "validation_errors", F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array("problem"))
    )


def last_failed(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest failed attempt per key; traces are ordered by step position and attempt."""
    bad = traces.where(F.col("trace_status").isin(fv.TRACE_RETRYING, fv.TRACE_TERMINAL))
    kept = F.struct("step_name", "attempt", "problem", "trace_status")
    newest = bad.groupBy(*keys).agg(F.max_by(kept, F.struct("step_pos", "attempt")).alias("_t"))
    return newest.select(*keys, "_t.*")


_ROUND_COLUMNS = [
    "step_name", "step_pos", "attempt", "prompt_sent", "raw_response", "record", "problem", "success", "blocked",
    "model_failed", "guardrail_flags", "duration_ms", "trace_status",
]


def run_step(
    prompts: DataFrame,
    step: dict,
    ask: Callable[[DataFrame], DataFrame],
    cfg: ReviewConfig,
    keys: Sequence[str],
    keep_prompts: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Run one step for all prompts, round by round; returns (results, traces).

    ``ask`` adds ``raw_response, error`` (and optionally ``duration_ms``) to rows with ``prompt``; the
    attempt number is in ``attempt``. A blocked prompt ends its step at once; a failed attempt is retried
    up to ``max_retries`` times, with the failed answer and its errors in the prompt if the step reflects.
    Traces keep every prompt; ``keep_prompts=False`` writes only those of failed attempts, which for long
    documents saves a copy of their text.
    """
    keys, limit = list(keys), step["max_retries"]
    carried = [c for c in prompts.columns if c not in keys]
    pending = prompts.withColumn("_error", F.lit("")).withColumn("_reply", F.lit(""))
    rounds: list[DataFrame] = []
    context = context_lines(F.col("context")) if "context" in prompts.columns else None
    for attempt in range(1, limit + 1):
        sent = F.col("prompt")
        if attempt > 1 and step["use_reflection"]:
            again = reflection_prompt(F.lit(step["name"]), F.col("prompt"), F.col("_reply"), F.col("_error"), context)
            sent = F.when(F.col("_error") != "", again).otherwise(sent)
        screened = input_verdict(
            pending.withColumn("_original", F.col("prompt")).withColumn("prompt", sent), "prompt", cfg, entropy=False
        ).withColumn("attempt", F.lit(attempt))
        sent_as = {"temperature": F.lit(float(step.get("temperature") or 0.0)), "backend_key": F.lit(step.get("backend_key") or "default")}
        made = ask(screened.drop("in_text", "in_pii_count", "_error", "_reply").withColumns(sent_as))
        if "duration_ms" not in made.columns:
            made = made.withColumn("duration_ms", F.lit(None).cast("double"))
        blocked, failed, keep = ~F.col("in_passed"), F.col("error").isNotNull(), F.lit(keep_prompts)
        none = F.array().cast("array<string>")
        judged = judge_attempts(made, cfg, step["output_schema"], limit).select(
            *keys,
            *[c for c in carried if c != "prompt"],
            F.when(keep | ~(F.col("success") & ~blocked), F.col("_original")).alias("prompt"),
            F.lit(step["name"]).alias("step_name"),
            F.lit(step["pos"]).alias("step_pos"),
            "attempt",
            # The first attempt sends the prompt itself: it is written once.
            (F.col("prompt") if attempt > 1 else F.lit(None).cast("string")).alias("prompt_sent"),
            F.when(blocked | failed, "").otherwise(F.col("reply_text")).alias("raw_response"),
            F.when(~blocked, F.col("record")).alias("record"),
            F.when(blocked, F.concat(F.lit("Input blocked: "), "in_reason")).otherwise(F.col("problem")).alias("problem"),
            (F.col("success") & ~blocked).alias("success"),
            blocked.alias("blocked"),
            (failed & ~blocked).alias("model_failed"),
            F.when(blocked, F.col("in_flags")).when(failed, none).otherwise(F.col("out_flags")).alias("guardrail_flags"),
            F.when(blocked, 0.0).otherwise(F.col("duration_ms")).alias("duration_ms"),
            F.when(blocked, fv.TRACE_TERMINAL).otherwise(F.col("trace_status")).alias("trace_status"),
        )
        done = cut_lineage(judged, f"{step['name']}-{attempt}")
        rounds.append(done)
        if attempt == limit or not step["retry_on_failure"]:
            break
        pending = (
            done.where(~F.col("success") & ~F.col("blocked"))
            .select(*keys, *carried, F.col("problem").alias("_error"), F.col("raw_response").alias("_reply"))
        )
        if pending.isEmpty():
            break
    made = reduce(DataFrame.unionByName, rounds)
    last = len(rounds)
    final = made.where(F.col("success") | F.col("blocked") | (F.col("attempt") == last))
    outcome = (
        F.when(F.col("success"), "success")
        .when(F.col("blocked"), "blocked")
        .when(F.col("model_failed"), "model_error")
        .when(F.col("record").isNotNull(), "soft_success")
        .otherwise("failed")
    )
    results = final.select(
        *keys, "step_name", "step_pos", outcome.alias("outcome"), F.col("attempt").alias("attempts"), "record", "problem"
    )
    traces = made.withColumn("prompt_sent", F.coalesce("prompt_sent", "prompt")).select(
        *keys,
        *_ROUND_COLUMNS,
        F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array("problem")).alias("validation_errors"),
    )
    return results, traces


def run_steps(
    docs: DataFrame,
    steps: list[dict],
    ask: Callable[[DataFrame], DataFrame],
    cfg: ReviewConfig,
    key: str = "doc_id",
    keep_prompts: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the steps in order; returns (documents with status and extracted_data, step results, traces).

    ``docs`` are eligible documents (key, country, doc_type, text_content). A step that fails ends its
    document, unless the step is not retried and the model itself did not fail: then the document goes on. Without
    steps, as of a pipeline that does not exist, documents keep their status and have no data.
    """
    if not steps:
        spark = docs.sparkSession
        log.warning("no steps: extraction is skipped")
        none = T.StructType.fromDDL(f"step_name string, step_pos int, outcome string, attempts int, record {RECORD}, problem string")
        traces = T.StructType.fromDDL(
            "step_name string, step_pos int, attempt int, prompt_sent string, raw_response string, "
            f"record {RECORD}, problem string, success boolean, blocked boolean, model_failed boolean, "
            "guardrail_flags array<string>, duration_ms double, trace_status string, validation_errors array<string>"
        )
        keyed = lambda s: T.StructType([docs.schema[key], *s.fields])
        kept = docs.select(key, F.col("status") if "status" in docs.columns else F.lit(fv.DOC_PENDING).alias("status"), empty_record().alias("extracted_data"))
        return kept, spark.createDataFrame([], keyed(none)), spark.createDataFrame([], keyed(traces))
    docs = mark_tampered(docs, cfg)
    beside = [c for c in ("country_code", TAMPERED) if c in docs.columns]
    alive = docs.select(key, "country", "doc_type", "text_content", *beside)
    all_results: list[DataFrame] = []
    all_traces: list[DataFrame] = []
    for step in steps:
        so_far = reduce(DataFrame.unionByName, all_results) if all_results else None
        ready = alive
        if so_far is not None:
            kept = so_far.where(F.col("record").isNotNull()).select(key, F.col("step_name").alias("step"), "step_pos", F.col("record").alias("data"))
            ready = alive.join(flatten_prefixed(kept, [key]).select(key, F.col("data").alias("context")), key, "left")
        inject = "context" if so_far is not None and step["inject_previous_results"] else None
        prompts = extraction_prompts(ready, cfg, previous_col=inject)
        columns = [key, "prompt", *(["context"] if so_far is not None else [])]
        columns += beside
        results, traces = run_step(prompts.select(*columns), step, ask, cfg, [key], keep_prompts)
        all_results.append(results)
        all_traces.append(traces)
        ended = F.col("outcome").isin("blocked", "failed") if step["retry_on_failure"] else F.lit(False)
        dropped = results.where(ended | (F.col("outcome") == "model_error")).select(key)
        alive = alive.join(dropped, key, "left_anti")
    results = reduce(DataFrame.unionByName, all_results)
    data = flatten_last_wins(
        results.where(F.col("record").isNotNull()).select(key, "step_pos", F.col("record").alias("data")), [key]
    )
    empty = empty_record()
    finished = alive.select(key, F.lit(True).alias("_ok")).join(data, key, "left")
    status = (
        docs.select(key)
        .join(finished, key, "left")
        .select(
            key,
            F.when(F.col("_ok"), fv.DOC_EXTRACTED).otherwise(fv.DOC_FAILED).alias("status"),
            F.when(F.col("_ok"), F.coalesce("data", empty)).otherwise(empty).alias("extracted_data"),
        )
    )
    return status, results, reduce(DataFrame.unionByName, all_traces)
