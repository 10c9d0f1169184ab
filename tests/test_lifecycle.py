"""Preparations of a session's index: coalesced, cancelled, failing."""

from __future__ import annotations

import threading
import time

import pytest

from strandline.history import History
from strandline.sources import sessions
from strandline.streaming.cadence import Cadence
from strandline.streaming.lifecycle import Closed, Prepared


class Source:
    """Builds one after the other, each when it is let through."""

    def __init__(self):
        self.gate, self.made, self.released = threading.Semaphore(0), 0, []

    def __call__(self):
        assert self.gate.acquire(timeout=20)
        self.made += 1
        return self.made


def until(what):
    for _ in range(400):
        if what():
            return
        time.sleep(0.02)
    raise AssertionError("nothing happened")


def test_requests_are_coalesced_and_the_old_one_serves(spark):
    source = Source()
    own = Prepared(spark, source, release=source.released.append)
    assert own.current() is None
    assert [own.request() for _ in range(4)] == [True, True, False, False]  # one runs, one waits for all others
    source.gate.release()
    until(lambda: own.current() == 1)
    source.gate.release()
    assert own.wait(20) == 2 and source.made == 2 and source.released == [1]
    own.close()
    own.close()
    assert source.released == [1, 2]
    with pytest.raises(Closed):
        own.request()


def test_a_reset_discards_what_runs(spark):
    source = Source()
    own = Prepared(spark, source, release=source.released.append)
    own.request()
    own.request()
    own.event("compact")
    source.gate.release()  # the old one comes to its end, for nobody
    until(lambda: source.released == [1])
    assert own.current() is None and own.generation == 1
    source.gate.release()
    assert own.wait(20) == 2 and source.made == 2  # what had waited was dropped
    with pytest.raises(TimeoutError):
        own.reset()
        own.wait(0.2)
    own.event("shutdown")
    with pytest.raises(Closed):
        own.current()


def test_events_ask_by_the_cadence(spark):
    source = Source()
    own = Prepared(spark, source, Cadence(every_cycles=2, every_batches=3))
    kinds = [("message_end", None), ("agent_end", None), ("turn_end", "a"), ("turn_end", "a"), ("other", None), ("message_end", None), ("agent_end", None)]
    assert [own.event(k, i) for k, i in kinds] == [None] * 6 + ["cycles"]
    source.gate.release()
    assert own.wait(20) == 1
    own.event("tree")
    assert [own.event("turn_end", i) for i in ("a", "b", "c")] == [None, None, "batches"]
    source.gate.release()
    assert own.wait(20) == 2
    own.close()


def test_failures_end_the_session(spark):
    calls = []

    def broken():
        calls.append(1)
        raise ValueError(f"no {len(calls)}")

    own = Prepared(spark, broken, failures=2)
    with pytest.raises(Closed) as caught:
        own.wait(20)
    assert len(calls) == 2 and str(caught.value.__cause__) == "no 2"


def test_an_index_is_prepared(spark):
    message = lambda i, text: {"type": "message", "id": i, "timestamp": "2026-10-06T00:00:00Z", "message": {"role": "user", "content": text}}
    log = [message("a", "silver orchard"), message("b", "tail"), {"type": "compaction", "id": "c", "timestamp": "x", "firstKeptEntryId": "b"}]
    history = History(sessions.entries(spark, {"s": log}))
    own = Prepared(spark, lambda: history.index, release=lambda index: index.released())
    assert own.wait(60).documents.count() == 1
    own.close()
