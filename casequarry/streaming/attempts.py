"""Retries on a stream: replies arrive, the next attempts go out, and the result of a step leaves once.

Reading and judging replies is a projection, the same as for tables. What is kept per document and step is small: the
attempt that is awaited, replies that came before their turn, and whether the step has ended. A reply that lacks something
asks for the next attempt; one that does not come in time counts as a failed attempt. State lies in the state store, by
buckets of steps, so a restart goes on where it was, and a reply that is repeated, or comes after the end, changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from casequarry.functions.values import record_json
from casequarry.operators.model import judge_attempts
from casequarry.sources.config import ReviewConfig

ASK, RESULT = "ask", "result"
TIMEOUT = "timeout"
#: Steps lie in so many buckets of the state; a checkpoint is read with the number it was written with.
BUCKETS = 4096


class Retries(StatefulProcessor):
    """The steps of one bucket of keys: each waits for attempt after attempt.

    A bucket's steps are one value of the state store, read and written once for all of the bucket's rows in a batch: a
    call of the store for every step and attempt takes far longer than judging the replies. ``steps`` holds, by the text
    of a step's keys, None when it has ended, else its keys, the awaited attempt, when that is overdue, and early replies.
    """

    def __init__(self, keys: StructType, max_retries: int, timeout_ms: int | None, output: StructType):
        self.names, self.limit, self.timeout_ms = [f.name for f in keys], max_retries, timeout_ms
        self.columns = [f.name for f in output]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getValueState("steps", "steps binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        steps, touched = self._stored(), set()
        for row in rows:
            own = tuple(row[n] for n in self.names)
            name = repr(own)
            if name not in steps:
                steps[name] = [own, 1, self._due(timerValues), {}]
            if steps[name] is not None and row.attempt >= steps[name][1]:
                steps[name][3][row.attempt] = (row.success, row.problem, row.record)
                touched.add(name)
        for name in touched:
            yield from self._go_on(steps, name, timerValues)
        self._store(steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        steps, now = self._stored(), timerValues.getCurrentProcessingTimeInMs()
        for name in [n for n, step in steps.items() if step is not None and step[2] is not None and step[2] <= now]:
            steps[name][3][steps[name][1]] = (False, TIMEOUT, None)
            yield from self._go_on(steps, name, timerValues)
        self._store(steps)

    def close(self) -> None:
        pass

    def _stored(self) -> dict[str, list | None]:
        held = self.steps.get()
        return pickle.loads(held[0]) if held is not None else {}

    def _store(self, steps: dict[str, list | None]) -> None:
        """Keep the steps, and one timer: that of the attempt that is overdue first."""
        self.steps.update((pickle.dumps(steps),))
        if self.timeout_ms:
            first = min((step[2] for step in steps.values() if step is not None and step[2] is not None), default=None)
            set_ = list(self.handle.listTimers())
            for timer in set_:
                if timer != first:
                    self.handle.deleteTimer(timer)
            if first is not None and first not in set_:
                self.handle.registerTimer(first)

    def _due(self, timers) -> int | None:
        return timers.getCurrentProcessingTimeInMs() + self.timeout_ms if self.timeout_ms else None

    def _go_on(self, steps: dict[str, list | None], name: str, timers) -> Iterator[Row]:
        """Take a step's replies in their turn, as far as they are there."""
        own, awaited, due, early = steps[name]
        while awaited <= self.limit and awaited in early:
            success, problem, record = early.pop(awaited)
            due = self._due(timers)
            if success or awaited == self.limit:
                outcome = "success" if success else "soft_success" if record is not None else "failed"
                yield self._row(own, RESULT, awaited, outcome, "" if success else problem, record)
                awaited = self.limit + 1
            else:
                awaited += 1
                yield self._row(own, ASK, awaited, None, problem, record)
        steps[name] = [own, awaited, due, early] if awaited <= self.limit else None

    def _row(self, own: tuple, kind: str, attempt: int, outcome: str | None, problem: str, record: str | None) -> Row:
        return Row(**dict(zip(self.columns, (*own, kind, attempt, outcome, problem, record), strict=True)))


def stream_attempts(
    replies: DataFrame, cfg: ReviewConfig, required: list[str] | None, max_retries: int, keys: list[str], timeout_ms: int | None = None
) -> DataFrame:
    """Steps over a stream of replies (keys, attempt, raw_response, error): (keys, kind, attempt, outcome, problem, record).

    ``ask`` rows name the attempt that is due, with what was wrong with the one before; ``result`` rows have the outcome,
    as ``resolve_attempts`` gives it for a table, and the record as JSON. With ``timeout_ms`` an attempt of a known step
    that has no reply after that time has failed; ``write_attempts`` looks at the time whenever it runs a batch.
    """
    judged = judge_attempts(replies, cfg, required, max_retries).select(
        *keys, F.col("attempt").cast("int"), "success", "problem", F.when(F.col("record").isNotNull(), record_json(F.col("record"))).alias("record")
    )
    own = StructType([judged.schema[k] for k in keys])
    output = StructType([*own, *StructType.fromDDL("kind string, attempt int, outcome string, problem string, record string")])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    return judged.select("*", bucket).groupBy("_bucket").transformWithState(
        statefulProcessor=Retries(own, max_retries, timeout_ms, output), outputStructType=output, outputMode="append",
        timeMode="ProcessingTime" if timeout_ms else "None",
    )


def write_attempts(steps: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a parquet table: once over what has arrived, or for good, in batches of ``every`` (such as ``1 minute``).

    Once means batches with replies only. Otherwise the engine would go on with empty ones for as long as it watches the
    time, and never end; what is overdue then is seen with the next replies.
    """
    conf, name = steps.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "true" if every else "false")
    try:
        writer = steps.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    finally:
        conf.set(name, before)
