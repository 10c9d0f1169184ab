"""Searches as they are made: a trace with one row for each, for :func:`strandline.sources.traces.correlated`."""

from __future__ import annotations

import copy
import itertools
import json
import os
from collections import defaultdict
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "type string, session_id string, call_index long, call_id string, parent_id string, input string, result string, error string, identical boolean"


@dataclass
class Call:
    """One search: what it was asked, and what came of it."""

    session_id: str
    call_index: int
    call_id: str
    input: Any
    parent_id: str | None = None
    arguments: Any = None
    result: Any = None
    error: str | None = None
    type: str = "history_recall_trace"


class Trace:
    """Collects searches of sessions; what can't be written as JSON is dropped, and never fails the search.

    ``requested`` and ``inside`` tell what the model asked for and which call another
    one was made in.  Rows are taken out with :meth:`rows` or :meth:`flush`; a call
    that is neither complete nor failed yet stays pending.
    """

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path else None
        self.numbers: dict[str, itertools.count] = defaultdict(lambda: itertools.count(1))
        self.asked: dict[tuple[str, str], Any] = {}
        self.parents: dict[tuple[str, str], str] = {}
        self.pending: list[Call] = []
        self.done: list[Call] = []

    @staticmethod
    def _plain(value: Any) -> Any:
        """A copy that later changes don't reach; raises TypeError or ValueError if it isn't JSON."""
        json.dumps(value)
        return copy.deepcopy(value)

    def requested(self, session_id: str, call_id: str, arguments: Any) -> None:
        self.asked[session_id, call_id] = arguments

    def inside(self, session_id: str, call_id: str, parent_id: str) -> None:
        self.parents[session_id, call_id] = parent_id

    def begin(self, session_id: str, call_id: str, asked: Any) -> Call | None:
        number = next(self.numbers[session_id])
        try:
            call = Call(session_id, number, call_id, self._plain(asked))
        except (TypeError, ValueError):
            return None
        self.pending.append(call)
        return call

    def _end(self, call: Call | None, **what) -> None:
        if call is None or call not in self.pending:
            return
        self.pending.remove(call)
        try:
            for name, value in what.items():
                setattr(call, name, self._plain(value))
        except (TypeError, ValueError):
            return
        self.done.append(call)

    def complete(self, call: Call | None, result: Any) -> None:
        self._end(call, result=result)

    def fail(self, call: Call | None, error: BaseException | str) -> None:
        self._end(call, error=str(error))

    def rows(self) -> list[dict]:
        """The finished calls, each with what its model had asked for; they leave the trace."""
        out = []
        for call in self.done:
            key = (call.session_id, call.call_id)
            call.parent_id = self.parents.pop(key, None)
            known = call.parent_id is None and key in self.asked
            call.arguments = self.asked.pop(key, None) if known else None
            out.append(asdict(call) | {"identical": call.arguments == call.input if known else None})
        self.done = []
        return out

    def flush(self) -> int:
        """Append the finished calls to the file, which only its owner may read; how many."""
        rows = self.rows()
        if rows and self.path is not None:
            with os.fdopen(os.open(self.path, os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o600), "a", encoding="utf-8") as file:
                file.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
        return len(rows)

    def table(self, spark: SparkSession) -> DataFrame:
        """The finished calls as a table, values as JSON text."""
        text = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows = [r | {"input": text(r["input"]), "result": text(r["result"])} for r in self.rows()]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def memory(spark: SparkSession) -> dict[str, int]:
    """Bytes that the driver's processes hold now: resident set, used and committed heap."""
    heap = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    with open("/proc/self/statm", encoding="ascii") as file:
        pages = int(file.read().split()[1])
    return {"rss": pages * os.sysconf("SC_PAGE_SIZE"), "heap_used": heap.getUsed(), "heap_committed": heap.getCommitted()}
