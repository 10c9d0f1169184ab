"""The index of one live session: prepared in the background, one preparation at a time, thrown away on a reset.

Events of a session (kind, ok) come one by one.  Those that may change the branch
(``session_start``, ``compact``, ``tree``) reset what is prepared; messages, turns and
answers' ends drive the :class:`~strandline.streaming.cadence.Cadence`, and when it
is due an index is asked for; ``shutdown`` closes the session.

A preparation runs as a Spark job group of its own.  While one runs, further requests
wait as one, the latest.  A reset begins a new generation: what runs is cancelled,
what waits is dropped, and what an older generation still brings is discarded.  Until
a newer one is there the last index of this generation is served.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import SparkSession

from strandline.streaming.cadence import Cadence

T = TypeVar("T")
#: Kinds of events that begin a new generation.
RESETS = ("session_start", "compact", "tree")
#: What the cadence calls the other kinds: a user's message, an answer's end, a batch of tool results.
CADENCE = {"message_end": "user", "agent_end": "end", "turn_end": "batch"}


class Closed(RuntimeError):
    """The session was closed, or its preparation failed for good."""


class Prepared(Generic[T]):
    """What ``build()`` makes for a session, prepared by events or on request.

    ``build`` runs in a thread.  After ``failures`` failures in a row the session is
    closed for good, with the last error as the cause.  ``release`` is called with
    what is no longer served.
    """

    def __init__(self, spark: SparkSession, build: Callable[[], T], cadence: Cadence | None = None, release: Callable[[T], None] = lambda x: None, failures: int = 3):
        self.spark, self.build, self.release, self.failures = spark, build, release, failures
        self.cadence = cadence or Cadence()
        self.generation = 0
        self.failed = 0
        self.error: BaseException | None = None
        self._served: T | None = None
        self._group: str | None = None
        self._waiting = False
        self._closed = False
        self._state = threading.Condition()

    # ------------------------------------------------------------ events

    def event(self, kind: str, event_id: str | None = None, ok: bool = True) -> str | None:
        """Take an event; why an index was asked for now, if it was."""
        if kind == "shutdown":
            self.close()
            return None
        if kind in RESETS:
            self.cadence.event("reset", None, True)
            self.reset()
            return None
        if kind not in CADENCE:
            return None
        reason = self.cadence.event(CADENCE[kind], event_id, ok)
        if reason:
            self.request()
        return reason

    def request(self) -> bool:
        """Ask for a new index; False if one is waited for already."""
        with self._state:
            self._check()
            if self._group is not None:
                first, self._waiting = not self._waiting, True
                return first
            self._start()
            return True

    def reset(self) -> None:
        """Begin a new generation without an index."""
        with self._state:
            self._check()
            self._drop()

    def close(self) -> None:
        """Cancel what runs and take no more requests; more than once does no harm."""
        with self._state:
            self._closed = True
            self._drop()

    # ------------------------------------------------------------ results

    def current(self) -> T | None:
        """What this generation has, without waiting."""
        with self._state:
            self._check()
            return self._served

    def wait(self, seconds: float | None = None) -> T:
        """What this generation has when nothing runs or waits; it is asked for if there is nothing."""
        with self._state:
            self._check()
            if self._served is None and self._group is None:
                self._start()
            if not self._state.wait_for(lambda: self._closed or (self._group is None and self._served is not None), seconds):
                raise TimeoutError(f"nothing was prepared within {seconds} s")
            self._check()
            return self._served

    # ------------------------------------------------------------ inside; the lock is held

    def _check(self) -> None:
        if self._closed:
            raise Closed("the session is closed") from self.error

    def _drop(self) -> None:
        self.generation += 1
        self._waiting = False
        if self._group is not None:
            self.spark.sparkContext.cancelJobGroup(self._group)
            self._group = None
        if self._served is not None:
            self.release(self._served)
            self._served = None
        self._state.notify_all()

    def _start(self) -> None:
        self._group = uuid.uuid4().hex
        threading.Thread(target=self._run, args=(self.generation, self._group), daemon=True).start()

    def _run(self, generation: int, group: str) -> None:
        made, error = None, None
        try:
            self.spark.sparkContext.setJobGroup(group, "an index in preparation", interruptOnCancel=True)
            made = self.build()
        except BaseException as caught:  # noqa: BLE001  it is kept, and raised where the result is asked for
            error = caught
        with self._state:
            if generation != self.generation:
                # Another generation has begun: nobody waits for this.
                if made is not None:
                    self.release(made)
                return
            self._group = None
            if error is None:
                if self._served is not None:
                    self.release(self._served)
                self._served, self.failed, self.error = made, 0, None
            else:
                self.failed, self.error = self.failed + 1, error
                if self.failed >= self.failures:
                    self._closed = True
                    self._drop()
                    return
            if self._waiting or (error is not None and self._served is None):
                self._waiting = False
                self._start()
            self._state.notify_all()
