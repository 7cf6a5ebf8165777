"""Steps of a bucket are read from the state store and written to it once in a batch, however many they are."""

from collections import Counter

from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casequarry.streaming import attempts as sa

KEYS = StructType().add("doc_id", LongType())
OUT = StructType([*KEYS, *[StructField(n, StringType()) for n in ("kind", "attempt", "outcome", "problem", "record")]])


class Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers, self.now = Counter(), None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def _processor(store, timeout_ms=None):
    processor = sa.Retries(KEYS, 3, timeout_ms, OUT)
    processor.init(store)
    return processor


def _reply(doc, attempt, success=False):
    return Row(doc_id=doc, attempt=attempt, success=success, problem="" if success else "bad", record=None)


def test_store_calls_do_not_grow_with_the_steps():
    store = Store()
    processor = _processor(store)
    first = list(processor.handleInputRows((7,), iter([_reply(d, 1, d % 2 == 0) for d in range(1000)]), store))
    assert Counter(r.kind for r in first) == {"ask": 500, "result": 500}
    assert store.calls == {"get": 1, "update": 1}
    again = list(processor.handleInputRows((7,), iter([_reply(d, 1, True) for d in range(1000)]), store))
    assert again == []  # repeats change nothing
    last = list(processor.handleInputRows((7,), iter([_reply(d, k) for d in range(1000) for k in (3, 2)]), store))
    assert Counter((r.kind, r.attempt) for r in last) == {("ask", 3): 500, ("result", 3): 500}


def test_one_timer_for_the_step_that_is_overdue_first():
    store = Store()
    processor = _processor(store, timeout_ms=100)
    list(processor.handleInputRows((7,), iter([_reply(1, 1)]), store))
    store.now = 50
    list(processor.handleInputRows((7,), iter([_reply(d, 1) for d in (2, 3)]), store))
    assert store.timers == {100}
    store.now = 120
    assert [(r.doc_id, r.attempt, r.problem) for r in processor.handleExpiredTimer((7,), store, None)] == [(1, 3, "timeout")]
    assert store.timers == {150}
